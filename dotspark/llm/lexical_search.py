"""Ranked lexical search by scanning the documents with one automaton of all items' terms.

There is no index of documents. The terms of all items, each between two guards that stand for a separator,
make an Aho-Corasick automaton; separators of a text become that guard, so the automaton finds whole terms only
and their occurrences are the term frequencies. One scan sums the statistics (documents, terms, documents of each
term); another scores each document for every item that shares a term with it and keeps each task's best of
each item, of which the best overall are taken. Items beyond ``BLOCK_CHARS`` characters are worked in blocks, a
pair of scans each, so what is broadcast stays bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Row, Window as W, functions as F

from .words import LOWER, text_slices, utf8

#: Separators are the ASCII characters that are neither letters nor digits; a space stands for all of them.
GUARD = 32
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = GUARD

#: Characters of the items whose terms make one automaton, in expectation.
BLOCK_CHARS = 1 << 18
#: Cells of a block of scores (documents times items) and bytes of a long text that are worked at a time.
CELLS, WINDOW = 1 << 20, 1 << 20
TOP = 20


@dataclass
class Queries:
    """The terms of a block of items; ``members[t]`` are the items that hold term t, and how often."""

    terms: list[str]
    members: list[tuple[np.ndarray, np.ndarray]]
    size: int
    weights: np.ndarray | None = None
    documents: int = 0
    total: int = 0


def item_terms(text: str | None) -> list[str]:
    """The terms of a text, as strings of its UTF-8 bytes."""
    return FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().decode("latin-1").split(" ") if text else []


def _queries(items: list[Row]) -> Queries:
    held: dict[str, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        for term, times in Counter(filter(None, item_terms(item._text))).items():
            held.setdefault(term, []).append((i, times))
    members = [tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True)) for pairs in held.values()]
    return Queries(list(held), members, len(items))


_built: dict[int, ahocorasick.Automaton] = {}


def automaton(shared: Broadcast) -> ahocorasick.Automaton:
    """The automaton of the broadcast terms, built once in a Python worker."""
    if shared._path not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for i, term in enumerate(shared.value.terms):
            found.add_word(f" {term} ", i)
        found.make_automaton()
        _built[shared._path] = found
    return _built[shared._path]


def _pieces(low: bytes) -> Iterator[str]:
    """A folded text in stretches of about ``WINDOW`` bytes that end at a separator."""
    at = 0
    while at < len(low):
        end = len(low) if at + WINDOW >= len(low) else low.find(b" ", at + WINDOW)
        end = len(low) if end < 0 else end
        yield f" {low[at:end].decode('latin-1')} "
        at = end


def _frequencies(batch: pa.RecordBatch, found: ahocorasick.Automaton, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of terms of each row; then row, term and frequency of every term of the automaton that a row holds."""
    raw, offsets = utf8(batch.column("_text"))
    low = FOLD[raw]
    inside = low != GUARD
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = inside[starts]
    sizes = np.diff(np.searchsorted(np.flatnonzero(first), offsets))
    folded, keys = low.tobytes(), []
    for row in np.flatnonzero(sizes):
        for piece in _pieces(folded[offsets[row] : offsets[row + 1]]):
            keys.append(np.fromiter((term for _, term in found.iter(piece)), np.int64) + row * n_terms)
    if not keys:
        none = np.zeros(0, np.int64)
        return sizes, none, none, none
    keys, times = np.unique(np.concatenate(keys), return_counts=True)
    return sizes, keys // n_terms, keys % n_terms, times


def _statistics(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of a task: documents with a term (at -1), their terms (at -2), and the documents of each term."""
    n_terms, found = len(shared.value.terms), automaton(shared)
    holds, documents, total = np.zeros(n_terms, np.int64), 0, 0
    for batch in text_slices(batches):
        sizes, _, terms, _ = _frequencies(batch, found, n_terms)
        holds += np.bincount(terms, minlength=n_terms)
        documents += int(np.count_nonzero(sizes))
        total += int(sizes.sum())
    at = np.flatnonzero(holds)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[documents, total], holds[at]]))], ["_term", "_count"])


def _scores(rows: np.ndarray, terms: np.ndarray, gains: np.ndarray, n_rows: int, queries: Queries) -> np.ndarray:
    """Rows times items, the sum of the rows' ``gains`` over each item's terms."""
    out = np.zeros((n_rows, queries.size), np.int64)
    order = np.argsort(terms, kind="stable")
    rows, terms, gains = rows[order], terms[order], gains[order]
    ends = np.append(np.flatnonzero(np.diff(terms)) + 1, len(terms))
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        if a < b:
            items, times = queries.members[terms[a]]
            out[np.ix_(rows[a:b], items)] += gains[a:b, None] * times
    return out


def _best(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """The ``TOP`` documents of each item among a task's."""
    queries, found = shared.value, automaton(shared)
    n_terms, step = len(queries.terms), max(1, CELLS // max(queries.size, 1))
    least = np.ones(queries.size, np.int64)  # a document of a lower score is beaten by TOP others
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]  # item, score, id is null, id
    for batch in text_slices(batches):
        sizes, rows, terms, times = _frequencies(batch, found, n_terms)
        lengths = np.array([75 + 25 * int(n) * queries.documents // queries.total if n else 75 for n in sizes], np.int64)
        gains = queries.weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * lengths[rows]))
        ids = batch.column("_id")
        null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(batch), step):
            a, b = np.searchsorted(rows, [at, at + step])
            scores = _scores(rows[a:b] - at, terms[a:b], gains[a:b], min(step, len(batch) - at), queries)
            row, item = np.nonzero(scores >= least)
            if not len(row):
                continue
            new = [item, scores[row, item], null[row + at], ids[row + at]]
            kept = [np.concatenate(pair) for pair in zip(kept, new, strict=True)]
            order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
            kept = [x[order] for x in kept]
            place = np.arange(len(order)) - np.searchsorted(kept[0], kept[0])
            last = place == TOP - 1
            least[kept[0][last]] = kept[1][last]
            kept = [x[place < TOP] for x in kept]
    item, score, null, ids = kept
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=null), pa.array(score)], ["_item", "doc_id", "score"])


def _block(docs: DataFrame, items: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = items.collect()  # a block's items: bounded by BLOCK_CHARS
    queries, kind = _queries(rows), items.schema["_id"].dataType.simpleString()
    if not queries.terms:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    shared = spark.sparkContext.broadcast(queries)
    counted = docs.mapInArrow(lambda batches: _statistics(batches, shared), "_term long, _count long").groupBy("_term").agg(F.sum("_count").alias("_count"))
    counts = {r._term: r._count for r in counted.collect()}  # a row per term of the block
    queries.documents, queries.total = counts.get(-1, 0), counts.get(-2, 0)
    holds = (counts.get(t, 0) for t in range(len(queries.terms)))
    queries.weights = np.array([math.floor(1000 * math.log((2 * queries.documents + 2) / (2 * df + 1))) for df in holds], np.int64)
    weighed = spark.sparkContext.broadcast(queries)
    best = docs.mapInArrow(lambda batches: _best(batches, weighed), "_item long, doc_id long, score long")
    first = W.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= TOP)
    names = spark.createDataFrame([(i, r._id) for i, r in enumerate(rows)], f"_item long, item_id {kind}")
    return ranked.join(F.broadcast(names), "_item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``TOP`` documents with a score above 0 for every item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Document ids are whole numbers. A null or empty text has no terms; a document without terms counts nowhere and
    an item without terms, or with none that a document holds, has no rows. Equal scores go by id, a null id
    last; rows that repeat an id are documents of their own. Rows that repeat an item's id and text are one item;
    texts that share an id are ranked apart. Other columns are not read; empty tables give no rows.
    """
    items = items.select(F.col(item_col).alias("_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("_text")).distinct()
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("_text"))).first()[0] or 0) / BLOCK_CHARS))
    out = None
    for k in range(blocks):
        part = _block(docs, items.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)) == k))
        out = part if out is None else out.unionByName(part)
    return out
