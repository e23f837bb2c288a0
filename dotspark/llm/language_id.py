"""Language identification with bit-sliced Bloom filters of byte n-grams.

Each language has a Bloom filter of the n-grams typical of it. The filters are stored bit-sliced: a slot
holds one bit per language, so the AND of an n-gram's slots is the set of all languages that contain it. A
text's n-grams are counted per language, each count is corrected for the filter's false positives, and
the largest share decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import materialise
from .words import mix, text_slices, utf8

#: Bytes of an n-gram, with a space at a word's ends.
ORDERS = (2, 3, 4)
HASHES = 3
#: Labelled documents of each language that the filters are fitted on, in expectation.
TRAIN_DOCS = 3000
#: An n-gram is typical of a language if it is this frequent there against where it is most frequent.
TYPICAL = 0.3
#: Fewest occurrences in the sample.
SEEN = 3
WINDOW = 1 << 19

_SPACE = 32
#: ASCII letters and bytes of longer characters stand; digits, signs and white space are spaces.
_CLASS = np.array([b if b >= 128 or chr(b).isalpha() else _SPACE for b in range(256)], np.uint8)


def held_out(row_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    return _CLASS[raw], offsets


def _grams(data: np.ndarray, rows: np.ndarray, a: int, b: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that start in [a, b), and which are real: one row, spaces at the ends only."""
    stop = min(b, len(data) - order + 1)
    if stop <= a:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    code = data[a:stop].astype(np.uint64)
    real = rows[a:stop] == rows[a + order - 1 : stop + order - 1]
    for j in range(1, order):
        part = data[a + j : stop + j]
        code = code | (part.astype(np.uint64) << np.uint64(8 * j))
        if j < order - 1:
            real &= part != _SPACE
    if order == 2:
        real &= (data[a:stop] != _SPACE) | (data[a + 1 : stop + 1] != _SPACE)
    return code | np.uint64(order << 40), real


def _row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, n-gram, count) of a batch, summed over its documents."""
    for batch in text_slices(batches):
        langs = batch.column("_lang")
        for lang in pc.unique(langs):
            data, offsets = _lowered(batch.column("_text").filter(pc.equal(langs, lang)))
            rows = _row_of(offsets)
            for order in ORDERS:
                for a in range(0, len(data), WINDOW):
                    code, real = _grams(data, rows, a, a + WINDOW, order)
                    values, counts = np.unique(code[real], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)], ["_lang", "_gram", "_count"])


@dataclass
class Filters:
    """``slots``: one row per slot, a bit per language in 64-bit planes; ``fill``: share of each language's bits set."""

    langs: list[str]
    slots: np.ndarray
    fill: np.ndarray

    def masks(self, code: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as planes of bits."""
        hashed, most = mix(code), np.uint64(len(self.slots) - 1)
        found = self.slots[(hashed & most).astype(np.int64)]
        for i in range(1, HASHES):
            found = found & self.slots[((hashed >> np.uint64(20 * i)) & most).astype(np.int64)]
        return found


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = TRAIN_DOCS) -> Filters:
    """Filters from a sample of the labelled rows: by hash of the id, about ``docs_per_lang`` of each language.

    Only what a bounded sample gives comes to the driver: at most HASHES slots per typical n-gram.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], np.zeros((4, 1), np.uint64), np.zeros(0))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, docs_per_lang / sizes[lang])))])
    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share[F.col("_lang")] * (1 << 20)).select("_lang", "_text")
    counts = materialise(sample.mapInArrow(_count_grams, "_lang string, _gram long, _count long").groupBy("_lang", "_gram").agg(F.sum("_count").alias("_count")), "language-grams")
    totals = {r["_lang"]: r["n"] for r in counts.groupBy("_lang").agg(F.sum("_count").alias("n")).collect()}
    place, total = (F.create_map(*[x for lang in totals for x in (F.lit(lang), F.lit(v(lang)))]) for v in (lambda lang: langs.index(lang), lambda lang: float(totals[lang])))
    rates = counts.withColumn("_rate", F.col("_count") / total[F.col("_lang")]).withColumn("_place", place[F.col("_lang")])
    best = rates.groupBy("_gram").agg(F.max("_rate").alias("_best"), F.sum("_count").alias("_all"), F.collect_list(F.struct("_place", "_rate")).alias("_of"))
    typical = F.transform(F.filter("_of", lambda x: x["_rate"] >= TYPICAL * F.col("_best")), lambda x: x["_place"])
    table = best.where(F.col("_all") >= SEEN).select("_gram", typical.alias("_in")).toArrow()
    codes = table.column("_gram").to_numpy().view(np.uint64)
    slots = np.zeros((1 << max(10, int(len(codes) * 8).bit_length()), -(-len(langs) // 64)), np.uint64)
    inside = table.column("_in").combine_chunks()
    which, at = np.asarray(inside.flatten(), np.int64), np.repeat(np.arange(len(codes)), pc.list_value_length(inside).to_numpy())
    hashed, most = mix(codes), np.uint64(len(slots) - 1)
    for i in range(HASHES):
        spot = ((hashed >> np.uint64(20 * i)) & most).astype(np.int64)[at]
        np.bitwise_or.at(slots, (spot, which // 64), np.uint64(1) << (which % 64).astype(np.uint64))
    fill = np.array([float(((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))])
    return Filters(langs, slots, fill)


def shares(column: pa.Array, filters: Filters) -> np.ndarray:
    """For each text and language the share of n-grams that the language contains, corrected for false positives."""
    data, offsets = _lowered(column)
    rows = _row_of(offsets)
    n, k = len(offsets) - 1, len(filters.langs)
    hits, every = np.zeros((n, k)), np.zeros(n)
    for a in range(0, len(data), WINDOW):
        for order in ORDERS:
            code, real = _grams(data, rows, a, a + WINDOW, order)
            at = rows[a : a + len(code)][real]
            if not len(at):
                continue
            low, width = int(at[0]), int(at[-1]) - int(at[0]) + 1
            # Rows ascend: a row's sum is the difference of a running count at its ends.
            ends = np.searchsorted(at, np.arange(low, low + width + 1))
            found = filters.masks(code[real])
            every[low : low + width] += np.diff(ends)
            for i in range(k):
                bits = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                running = np.concatenate([[0], np.cumsum(bits.astype(np.uint8), dtype=np.int64)])
                hits[low : low + width, i] += np.diff(running[ends])
    wrong = filters.fill**HASHES
    return np.clip((hits / np.maximum(every, 1)[:, None] - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1)


def _predict(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    filters: Filters = shared.value
    for batch in text_slices(batches):
        column = batch.column("_text")
        # A text without a letter has no language.
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
        if filters.langs:
            found = shares(column, filters)
            best, total = found.argmax(axis=1), found.sum(axis=1)
            score = np.where(lettered, found.max(axis=1) / np.maximum(total, 1e-9), 0.0)
            # With one language there is none to be ahead of.
            lead = np.where(lettered, found.max(axis=1) - (np.partition(found, -2, axis=1)[:, -2] if len(filters.langs) > 1 else 0.0), 0.0)
            names = [filters.langs[i] if ok else "und" for i, ok in zip(best, lettered, strict=True)]
        else:
            score, lead, names = np.zeros(len(batch)), np.zeros(len(batch)), ["und"] * len(batch)
        yield pa.RecordBatch.from_arrays([*(c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_text"), pa.array(names, pa.string()), pa.array(score), pa.array(lead)], [*(n for n in batch.schema.names if n != "_text"), "lang_pred", "score", "lead"])


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (the best language's part of all corrected shares),
    ``lead`` (the best share less the next best).

    Only the text is looked at. ``und`` with score 0 for a null text, one without a letter, or if no language
    was learned; with letters but no known n-gram the first language, score 0. Ties go to the language first
    by code point. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_predict, shared=shared), f"_id {id_type}, lang_pred string, score double, lead double").withColumnRenamed("_id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out and predict all of them: also ``held_out``."""
    filters = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col, id_col)
    found = predict(docs, filters, id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
