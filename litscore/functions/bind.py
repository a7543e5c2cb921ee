"""Naming the value of an expression inside a larger one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often body uses it.

    Spark shares common subexpressions between columns but not inside higher-order
    functions, where nested string work would otherwise be repeated at every level.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
