"""Compute columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """As withColumns, but the optimizer does not copy the expressions into each place that reads them.

    Projections may be merged and an expression used five times then runs five times; a generator is never
    merged. Worth it for columns that many later expressions read.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
