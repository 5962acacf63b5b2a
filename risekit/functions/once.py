"""Evaluate an expression once per row where a lambda uses it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value as a lambda's variable: inside inner lambdas it is not computed anew."""
    return F.transform(F.array(value), body)[0]
