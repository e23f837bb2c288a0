"""Stupid-backoff scores of whole documents against the bigram counts of the whole corpus.

1. Words are counted: (word, count), one row a word.
2. Documents are exploded to rows (document, context, word, times), one for each distinct bigram of a document,
   dealt by a hash of the context. A context that is too frequent for one task is dealt by its word as
   well, and a bigram that is, by document. Rows travel in arrays, a few thousand to one, and are plain
   rows again behind the shuffle.
3. There the counts of the bigrams and of their contexts are sums over windows of one sort: the n-gram count
   table is joined to the exploded n-grams where it is made. Counts of frequent words come from a broadcast
   of bounded size, those of other words by a join.
4. Each row's score times its number in the document is summed per document.

S(w | v) = c(v w) / c(v) if the bigram was seen at least ``MIN_COUNT`` times in the corpus, else 0.4 c(w) / N; so
scores a document's first word, without the 0.4. The documents are the corpus, so a bigram of theirs is
seen once at least: with a bound of 1 nothing would ever back off.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import materialise
from .words import mix, text_slices, utf8, word_hashes

BACKOFF, MIN_COUNT = 0.4, 2
#: Most words whose counts are broadcast.
FREQUENT = 1 << 18
#: A context or bigram is split if it holds more than one part in so many of a task's share.
SPREAD = 4
#: Bytes of text counted, and exploded, at a time.
COUNTED, SLICE = 1 << 21, 1 << 22
#: Contexts of a first word, and words behind a last one.
START, END = np.uint64(0), np.uint64(1)


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the texts with fewer rows than a short integer counts."""
    for batch in text_slices(batches, most=most):
        for at in range(0, len(batch), 1 << 15):
            yield batch.slice(at, 1 << 15)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, most=COUNTED):
        words, counts = np.unique(word_hashes(*utf8(batch.column("_text")))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["_w", "_c"])


def exploded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, context, word) of every place of the texts, ends included, and the number of words of each text."""
    words, bounds = word_hashes(*utf8(column))
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    # A text of n words has n + 1 places: each word behind the one before it, and the end behind the last.
    starts = np.concatenate([[0], np.cumsum(sizes[some] + 1)])
    context, word = np.full(starts[-1], START), np.full(starts[-1], END)
    inner = np.ones(starts[-1], bool)
    inner[starts[1:] - 1] = False
    word[inner] = words
    context[1:] = word[:-1]
    context[starts[:-1]] = START
    return np.repeat(some, sizes[some] + 1), context, word, sizes


def _heavy(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Bigrams that make more than one row in ``share`` of a slice, and in how many of its documents they are."""
    for batch in _slices(batches, COUNTED):
        row, context, word, _ = exploded(batch.column("_text"))
        _, first = np.unique(mix(mix(context * np.uint64(0x9E3779B97F4A7C15) + word) ^ row.astype(np.uint64)), return_index=True)
        pair = mix(context[first] * np.uint64(0x9E3779B97F4A7C15) + word[first])
        _, at, counts = np.unique(pair, return_index=True, return_counts=True)
        keep = counts * share > len(first)
        at = first[at[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(context[at].view(np.int64)), pa.array(word[at].view(np.int64)), pa.array(counts[keep])], ["_a", "_b", "_k"])


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table; -1 where it is not."""
    at = np.minimum(np.searchsorted(table, values), max(len(table) - 1, 0))
    return np.where(table[at] == values, at, -1) if len(table) else np.full(len(values), -1)


def _pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


def _count_pairs(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Counts of the hot bigrams alone."""
    _, _, pairs = shared.value
    for batch in text_slices(batches, most=COUNTED):
        _, context, word, _ = exploded(batch.column("_text"))
        at = _find(pairs, _pair_keys(context, word))
        hit = np.flatnonzero(at >= 0)
        _, first, counts = np.unique(at[hit], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(x[hit[first]].view(np.int64)) for x in (context, word)] + [pa.array(counts)], ["_a", "_b", "_all"])


def _empty(rows: int, kind: pa.DataType) -> pa.ListArray:
    """Lists of nothing; zipped with longer ones they give nulls."""
    return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], kind))


_PACKED = "_part int, _slice long, _a array<long>, _b array<long>, _d array<smallint>, _k array<int>, _id array<{0}>, _n array<long>"


def _pack(batches: Iterator[pa.RecordBatch], shared: Broadcast, parts: int) -> Iterator[pa.RecordBatch]:
    """A slice's rows by part, in arrays, and its documents with their numbers of words in one more."""
    hot, splits, pairs = shared.value
    base = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(_slices(batches, SLICE)):
        row, context, word, sizes = exploded(batch.column("_text"))
        part = (context >> np.uint64(11)) % np.uint64(parts)
        at = _find(hot, context)
        many = at >= 0
        part[many] = mix(context[many] + word[many] % splits[at[many]]) % np.uint64(parts)
        part[_find(pairs, _pair_keys(context, word)) >= 0] = np.uint64((base + number) % parts)
        # By part, then context; equal rows come together.
        key = part << np.uint64(44) | (context >> np.uint64(40)) << np.uint64(20) | mix(word + row.astype(np.uint64)) >> np.uint64(44)
        order = np.argsort(key)
        del key, at, many
        row, part = row[order].astype(np.int16), part[order].astype(np.int32)
        context = context[order]
        word = word[order]
        del order
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(row)))
        part = part[first]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).astype(np.int32) if len(part) else np.zeros(1, np.int32)
        rows = len(cuts) - 1
        columns = [context[first].view(np.int64), word[first].view(np.int64), row[first], counts.astype(np.int32)]
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(c)) for c in columns]
        none = [_empty(rows, batch.column("_id").type), _empty(rows, pa.int64())]
        where = [pa.array(part[cuts[:-1]] if rows else part), pa.array(np.full(rows, base + number))]
        names = ["_part", "_slice", "_a", "_b", "_d", "_k", "_id", "_n"]
        yield pa.RecordBatch.from_arrays([*where, *lists, *none], names)
        n, ends = len(batch), pa.array(np.array([0, len(batch)], np.int32))
        documents = [pa.array([(base + number) % parts], pa.int32()), pa.array([base + number])]
        documents += [_empty(1, pa.int64())] * 2 + [pa.ListArray.from_arrays(ends, pa.array(np.arange(n, dtype=np.int16))), _empty(1, pa.int32())]
        documents += [pa.ListArray.from_arrays(ends, pa.concat_arrays([batch.column("_id")])), pa.ListArray.from_arrays(ends, pa.array(sizes.astype(np.int64)))]
        yield pa.RecordBatch.from_arrays(documents, names)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_backoff`` (words that backed off), ``log_score`` (sum of ln S), ``mean_log``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. All rows count for the n-gram table, repeated ones
    too. A null text counts as empty: no words, ``log_score`` 0 and ``mean_log`` null. Rows that repeat an id
    are scored each; a null id is an id. Other columns are not read; an empty table gives no rows. The rows
    of ``docs`` come in the same order when they are read again (a table does; write others first).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    words = materialise(rows.select("_text").mapInArrow(_count_words, "_w long, _c long").groupBy("_w").agg(F.sum("_c").alias("_c")), "lm-words")
    # How many words have a count of 2^i or more: 64 rows; the bound of what is broadcast follows.
    sizes = {r["_i"]: (r["n"], r["c"]) for r in words.groupBy(F.floor(F.log2("_c")).cast("int").alias("_i")).agg(F.count(F.lit(1)).alias("n"), F.sum("_c").alias("c")).collect()}
    total = sum(c for _, c in sizes.values())
    cut = min((i for i in range(65) if sum(n for j, (n, _) in sizes.items() if j >= i) <= FREQUENT), default=64)
    frequent = F.broadcast(words.where(F.col("_c") >= 2.0**cut))
    share = max(1, total // (SPREAD * parts))  # rows that one context or bigram may put into one task
    hot = words.where(F.col("_c") > share).orderBy("_c", ascending=False).toArrow()  # at most SPREAD * parts words
    heavy = rows.select("_text").mapInArrow(functools.partial(_heavy, share=2 * SPREAD * parts), "_a long, _b long, _k long").groupBy("_a", "_b").agg(F.sum("_k").alias("_k"))
    pairs = heavy.where(F.col("_k") > share // 2).select("_a", "_b").toArrow()  # at most 2 * SPREAD * parts bigrams
    hashes = [np.append(hot.column("_w").to_numpy(), 0).view(np.uint64)]  # the start is a context of every document
    counts = np.append(hot.column("_c").to_numpy(), total)
    order = np.argsort(hashes[0])
    splits = np.minimum(counts // share + 1, parts).astype(np.uint64)
    keys = np.sort(_pair_keys(*(pairs.column(c).to_numpy().view(np.uint64) for c in ("_a", "_b"))))
    shared = spark.sparkContext.broadcast((hashes[0][order], splits[order], keys))
    id_type = rows.schema["_id"].dataType.simpleString()
    packed = rows.mapInArrow(functools.partial(_pack, shared=shared, parts=parts), _PACKED.format(id_type)).repartitionById(parts, "_part")
    placed = packed.select("*", F.posexplode("_d").alias("_i", "_doc"))
    flat = placed.select("_part", "_slice", F.col("_doc").alias("_d"), *(F.get(c, F.col("_i")).alias(c) for c in ("_a", "_b", "_k", "_id", "_n")))
    # One sort, ordered alike, serves both windows; contexts come first in it, as the part is the same all along.
    by = W.partitionBy("_a", "_part").orderBy("_b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = flat.withColumn("_both", F.sum("_k").over(W.partitionBy("_a", "_part", "_b"))).withColumn("_of", F.sum("_k").over(by))
    split = F.broadcast(words.where(F.col("_c") > share).withColumnsRenamed({"_w": "_a", "_c": "_ca"}))
    known = counted.join(split, "_a", "left").join(frequent.withColumnsRenamed({"_w": "_b", "_c": "_cb"}), "_b", "left")
    if len(keys):
        whole = rows.select("_text").mapInArrow(functools.partial(_count_pairs, shared=shared), "_a long, _b long, _all long")
        known = known.join(F.broadcast(materialise(whole.groupBy("_a", "_b").agg(F.sum("_all").alias("_all")), "lm-hot")), ["_a", "_b"], "left")
    else:
        known = known.withColumn("_all", F.lit(None).cast("long"))
    both, context = F.coalesce("_all", "_both"), F.coalesce("_ca", "_of")
    first, last, pair = F.col("_a") == 0, F.col("_b") == 1, F.col("_a").isNotNull()
    hit = ~first & (both >= min_count)
    plain = pair & ~last & ~hit  # scored by the word alone
    value = F.when(~pair | last, 0.0).when(hit, F.log(both / context)).otherwise(F.when(first, 0.0).otherwise(F.log(F.lit(BACKOFF))) + F.coalesce(F.log("_cb"), F.lit(0.0)))
    each = known.select("_slice", "_d", F.when(plain & F.col("_cb").isNull(), F.col("_b")).alias("_rare"), (F.col("_k") * value).alias("_log"), F.when(plain, F.col("_k")).alias("_plain"), F.when(plain & ~first, F.col("_k")).alias("_backed"), "_id", "_n")
    sums = lambda df, *keys: df.groupBy("_slice", "_d", *keys).agg(F.sum("_log").alias("_log"), F.sum("_plain").alias("_plain"), F.sum("_backed").alias("_backed"), F.first("_id", True).alias("_id"), F.max("_n").alias("_n"))
    summed = materialise(sums(each, "_rare"), "lm-sums")
    rare = summed.where("_rare IS NOT NULL").join(words.withColumnsRenamed({"_w": "_rare"}), "_rare").withColumn("_log", F.col("_log") + F.col("_plain") * F.log("_c")).drop("_c")
    out = sums(summed.where("_rare IS NULL").unionByName(rare))
    log = F.coalesce("_log", F.lit(0.0)) - F.coalesce("_plain", F.lit(0)) * F.lit(float(np.log(max(total, 1))))
    mean = F.when(F.col("_n") > 0, F.round(F.col("_sum") / F.col("_n"), 6))
    named = out.withColumn("_sum", log)
    return named.select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.coalesce("_backed", F.lit(0)).cast("long").alias("n_backoff"), F.round("_sum", 3).alias("log_score"), mean.alias("mean_log"))
