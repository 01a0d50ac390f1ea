"""Binding of a value to a name within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row.

    An expression that is used inside the function of transform() or filter() is computed again for
    each element; a variable of an outer function isn't.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
