import os

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_runs(spark):
    assert e.entry(spark).count() > 0
