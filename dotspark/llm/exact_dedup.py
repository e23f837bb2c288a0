"""Exact dedup by content sort.

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Sampled
splitters range-partition the rows by a prefix of the normalised bytes, their digest and the id, each
partition is sorted by (prefix, digest, normalised text, id) with Spark's spilling sort, and a streaming
pass compares each text in full with its neighbour. The id in the splitter key lets a splitter fall
inside a group of equal texts, so that a group with a third of all rows spreads over partitions; the
runs it is cut into are put together again by digest, as counts and a best row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import keyed, materialise
from .skew import join_keyed

#: The characters that do not count: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"

#: Leading characters of the normalised text in the splitter key.
PREFIX = 24


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring full comparisons over one sorted partition; a run's digest is taken once."""
    last, digest = None, ""
    for batch in batches:
        digests = []
        for value in batch.column("_norm"):
            text = value.as_py()
            if text != last:
                last, digest = text, hashlib.sha256(text.encode()).hexdigest()
            digests.append(digest)
        names = [name for name in batch.schema.names if name != "_norm"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(digests, pa.string())], [*names, "_digest"])


def _found(rows: DataFrame, text_col: str, partitions: int | None) -> DataFrame:
    """The columns of ``rows`` but the text, with ``_points`` and the ``_digest`` of the normalised text."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*(c for c in rows.columns if c != text_col), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_points"), normalised(F.col(text_col)).alias("_norm"))
    key = [F.substring("_norm", 1, PREFIX), F.xxhash64("_norm")]
    ordered = rows.repartitionByRange(n, *key, F.col("_id")).sortWithinPartitions(*key, "_norm", "_id")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_norm")
    return materialise(ordered.mapInArrow(_runs, f"{shape}, _digest string"), "exact-runs")


def _best(*ids: str) -> Column:
    """Orders rows of a group: the most code points first, then known ids, then the smallest; ids of any type that sorts."""
    return F.struct((-F.col("_points")).alias("_less"), F.col(ids[0]).isNull().alias("_unknown"), *ids)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the normalised UTF-8).

    Of equal texts the row with the most code points in its original text stays, then the smallest id.
    A null text counts as empty, so null, empty and all-white texts are one group. Rows that repeat an id
    count in ``group_size`` and share its verdict. A null id loses every tie and has ``kept`` false unless
    all ids of its group are null. Ids may be of any type that sorts. Other columns are not read; an empty table gives no rows.
    """
    found = _found(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", partitions)
    groups = found.groupBy("_digest").agg(F.min(_best("_id")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    out = join_keyed(found, groups, ["_digest"], "group_size", found.count())
    keep = F.col("_best._id")
    return out.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), "group_size", F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_digest").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay as they are.

    The row is that of ``exact_duplicates``; of rows that repeat its id and length, the first as written. Ids
    may be null or repeat: rows are told apart by a number of their own.
    """
    docs, key = keyed(docs, "exact-rows")
    found = _found(docs.select(F.col(id_col).alias("_id"), F.col(key).alias("_row"), F.col(text_col).alias("_text")), "_text", None)
    kept = found.groupBy("_digest").agg(F.min(_best("_id", "_row")).alias("_best")).select(F.col("_best._row").alias(key))
    return docs.join(kept, key, "left_semi").drop(key)
