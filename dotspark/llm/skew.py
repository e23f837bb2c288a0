"""Joins of rows with one row per key, when one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it has more rows than this, and more than one in ``SHARE`` of all rows.
LEAST, SHARE = 1000, 20_000


def join_keyed(rows: DataFrame, groups: DataFrame, keys: list[str], many: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row per key and in ``many`` how many of the ``total`` rows it has.

    Groups of hot keys are broadcast, so the rows of a hot key stay where they are; there are at most ``SHARE``
    hot keys whatever the size. All other keys meet by a shuffle, in which none has more than its share.
    Keys are not null.
    """
    limit = max(LEAST, total // SHARE)
    hot = F.broadcast(groups.where(F.col(many) > limit))
    cold = rows.join(F.broadcast(groups.where(F.col(many) > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(groups.where(F.col(many) <= limit), keys))
