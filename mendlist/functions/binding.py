"""Naming a value inside an expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]
