"""Operators of a training-data pipeline on PySpark; nothing else in the package imports this one."""
