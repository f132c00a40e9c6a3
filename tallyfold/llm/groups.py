"""Joining rows with one row per group when a few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than one in so many rows is large; there are fewer than so many of them.
LARGE = 512


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with the row of ``groups`` that has the same ``key``, never null.

    ``size`` names the column of ``groups`` with a group's number of rows, ``total`` is the
    number of all rows. Large groups, fewer than ``LARGE``, are broadcast, so their rows stay
    where they are; the others' rows are shuffled and no task gets many of one key.
    """
    limit = total // LARGE
    large = F.broadcast(groups.where(F.col(size) > limit))
    others = groups.where(F.col(size) <= limit)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(others, key))
