"""Part of keyledger; see the modules."""
