"""Vector columns: length, unit form, and the check against a collection's dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    """Euclidean length, added up in double."""
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def unit(vector: Column, length: Column) -> Column:
    """The vector divided by its length; NULL for the zero vector."""
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


def is_valid(vector: Column, dim: int) -> Column:
    """Never NULL: the vector exists and has ``dim`` elements, none NULL or not a number.

    A search for NaN answers NULL when it meets a NULL element, so one native
    pass finds both.
    """
    odd = F.array_contains(vector, F.lit(float("nan")).cast("float"))
    return F.coalesce((F.size(vector) == dim) & ~odd, F.lit(False))
