"""Joins with rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a rule table that may be broadcast.
SMALL = 100_000


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """rows marked for broadcast if they are counted and at most `most`; as they are beyond that, so that Spark picks the join by size."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
