"""Unions, keyed appends, registries, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def keyed_append(first: DataFrame, second: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows of ``first`` and those of ``second`` whose key is new; one row per key, the first by ``order``."""
    both = first.withColumn("_rank", F.lit(0)).unionByName(second.withColumn("_rank", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_rank", *order))).where("_n = 1").drop("_n", "_rank")


def dedupe_exact(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def upsert(registry: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Per key the row with the greatest version; updates win ties."""
    both = registry.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)))
    row = F.struct(*registry.columns)
    return both.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(row, F.struct(version, "_u")).alias("r")).select("r.*")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, ``change``): added, removed or modified; equal rows are left out.

    Sizes are compared first, then hashes where both sides have one, else modification times. Bulk
    directories count as modified when their time changed.
    """
    side = lambda df, p: df.select("path", *(F.col(c).alias(p + c) for c in ("size", "mtime_ns", "sha256")), F.lit(1).alias(p + "is"))
    joined = side(before, "b_").join(side(after, "a_"), "path", "full_outer")
    hashed = F.col("b_sha256").isNotNull() & F.col("a_sha256").isNotNull()
    differs = ~F.col("b_size").eqNullSafe(F.col("a_size")) | F.when(hashed, F.col("b_sha256") != F.col("a_sha256")).otherwise(~F.col("b_mtime_ns").eqNullSafe(F.col("a_mtime_ns")))
    change = F.when(F.col("b_is").isNull(), "added").when(F.col("a_is").isNull(), "removed").when(differs, "modified")
    return joined.select("path", change.alias("change")).where("change IS NOT NULL")


def latest_version(names: DataFrame, group: list[str], version: str, name: str) -> DataFrame:
    """Per group the name with the greatest version number, then the greatest name."""
    return names.where(F.col(version).isNotNull()).groupBy(*group).agg(F.max_by(name, F.struct(version, name)).alias(name), F.max(version).alias(version))
