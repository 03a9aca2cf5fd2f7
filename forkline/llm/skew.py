"""Joins of many rows with facts about their keys, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than one in so many rows have it; so there are fewer than that of them.
HOT = 1000


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """Inner join with ``facts``, one row a key, whose column ``count`` is the number of ``rows`` with the key.

    The facts of hot keys, fewer than ``HOT`` rows, are broadcast, and rows that have one are not shuffled; the others meet
    by key.  ``facts`` should be a written table, since it is read more than once.  Null keys match nothing.  ``total``
    is the sum of all counts or more, if it is known.
    """
    if total is None:
        total = facts.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(facts.where(F.col(count) * HOT > total))
    cold = facts.where(F.col(count) * HOT <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
