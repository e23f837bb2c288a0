"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a share of all words by its weight, at most ``MAX_REPEATS`` times its size. A source's
budget is some whole passes over it and a remainder; the remainder is the documents whose hash lies below
a threshold. The threshold comes from histograms: words by (source, leading hash bits), a running sum over
the buckets, and a refinement of the boundary bucket only, by the next bits. No row is sorted; the windows
run over buckets, of which a source has at most 2^16 per level.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from .scratch import materialise

MAX_REPEATS = 3
#: Bits of the 60-bit hash by level of refinement.
LEVELS = (12, 16, 16, 16)


@F.pandas_udf(LongType())
def _count_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: 0 if t is None else len(t.encode().split()))


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null has none. (bytes.split() splits at exactly these bytes.)"""
    return _count_words(text)


def mix_hash(row_id: Column) -> Column:
    """60 bits of the id's MD5: the same in any engine and any run."""
    return F.conv(F.substring(F.md5(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(``source``, ``source_size``) -> also ``target``: shares by weight under the cap, the excess shared again.

    Sources in order of code point, null last, take ``weights`` in turn. Sharing again and again until no
    target is above its cap has a closed form: with the sources in order of cap / weight, a source is at
    its cap if its cap / weight is at most (total - caps before it) / (weights from it on).
    """
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy("_ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(MAX_REPEATS)).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    rows = rows.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
    # Above the first source that is not at its cap, all share at that source's level.
    rows = rows.withColumn("_open", F.when(F.col("_ratio") > F.col("_level"), F.col("_level")))
    shared = F.first("_open", True).over(by_ratio.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("source", "source_size", F.coalesce(shared * F.col("_weight"), "_cap").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), also: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the columns of ``also``, id, ``size``, ``source_size``, ``target`` (its source's), ``taken`` (words, repeats counted).

    ``taken`` is ``size`` times the whole passes, once more below the source's threshold. The one document
    that straddles the remainder of the budget is taken in part, to the word; rows with the same id, which
    share a hash, share that part in proportion. Null sources are one source; a null text has size 0.
    Choices depend on ids alone, so reruns agree. An empty table gives no rows; other columns are not read.
    """
    rows = materialise(docs.select(*also, F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes").withColumn("_hash", mix_hash(F.col("_id")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    # Whole passes over a source, and the words that a part of a pass must give.
    budget, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    bounds = materialise(targets.withColumn("_passes", F.floor(budget / size).cast("long")).withColumn("_rest", F.pmod(budget, size)), "mix-targets")
    edge = bounds.select(F.col("source").alias("_source"), F.lit(0).cast("long").alias("_low"), F.col("_rest").alias("_left"))
    used = 0
    for bits in LEVELS:
        used += bits
        shift = sum(LEVELS) - used
        part = rows.join(edge, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("_hash", shift + bits) == F.shiftright("_low", shift + bits)))
        buckets = part.groupBy("_source", "_left", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("size").alias("_words"))
        running = F.sum("_words").over(W.partitionBy("_source").orderBy("_bucket"))
        # The first bucket at which the running sum passes what is left holds the threshold.
        crossed = buckets.withColumn("_sum", running).where(F.col("_sum") > F.col("_left")).groupBy("_source").agg(F.min(F.struct("_bucket", "_sum", "_words", "_left")).alias("b"))
        edge = materialise(crossed.select("_source", F.shiftleft("b._bucket", shift).alias("_low"), (F.col("b._left") - (F.col("b._sum") - F.col("b._words"))).alias("_left"), F.col("b._words").alias("_words")), "mix-edge")
    # No bucket is crossed where nothing is left over or the source is empty: then no document is below.
    final = bounds.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").select(F.col("source").alias("_s"), "source_size", "target", "_passes", "_low", "_left", "_words")
    extra = F.when(F.col("_hash") < F.col("_low"), F.col("size")).when(F.col("_hash") == F.col("_low"), F.floor(F.col("size") * F.col("_left") / F.col("_words")).cast("long")).otherwise(F.lit(0))
    out = rows.join(final, F.col("source").eqNullSafe(F.col("_s")))
    return out.select(*also, F.col("_id").alias(id_col), "size", "source_size", F.col("target"), (F.col("size") * F.col("_passes") + F.coalesce(extra, F.lit(0))).cast("long").alias("taken"))
