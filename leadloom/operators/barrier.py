"""A place in a plan that filters stay above."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, made by a generator.

    The optimizer pushes a filter below the projection that computes its
    columns, which then runs a chain of patterns twice per row, once for the
    filter and once for the result.  It doesn't push through a generator.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
