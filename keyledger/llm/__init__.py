"""Operators for training-data pipelines. Nothing else in keyledger imports them."""
