"""keyledger: bulk check / update of 64-bit keys, and the plans around it, on Spark DataFrames."""

from keyledger.engine import Engine
from keyledger.errors import LedgerClosed, LedgerError, NotAppendable
from keyledger.operators.merge import merge

__all__ = ["Engine", "LedgerClosed", "LedgerError", "NotAppendable", "merge"]
