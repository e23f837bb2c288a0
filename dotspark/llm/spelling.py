"""Spelling variants: words one inserted, deleted or replaced character apart, by permuterm rotations.

A word gets a terminator at its end and is rotated to every place. Two words that differ in one place share
the rotation that begins behind it, but for its last character: ``a x b`` has ``b $ a x``, ``a y b`` has
``b $ a y``, and ``a b`` has ``b $ a`` itself. Rotations are sorted by what stands before that character, so
the words of a range differ in it alone; a range holds one word per character of the alphabet at most and one
without it. A deletion out of a run of equal characters shows in several ranges and counts in that of
the run's first character.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import numpy as np
from pyspark.sql import DataFrame, functions as F

from .scratch import materialise
from .words import LOWER, text_slices, utf8

#: Stands at the end of a word; no word has it.
END = "$"
#: Least code points and occurrences of a word; how many times as frequent its form must be.
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One in so many runs of a document loses a character.
SLIP = 31
#: Different words that a task holds before it passes their counts on; characters of a long text worked at a time.
HELD, WINDOW = 1 << 17, 1 << 20

RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
OUTSIDE = re.compile("[^a-zÀ-ÿ]")


def runs(low: str) -> Iterator[tuple[str, int]]:
    """The maximal runs of letters of a lower-cased text that are long enough, and how often each comes in a stretch of it."""
    at = 0
    while at < len(low):
        cut = OUTSIDE.search(low, at + WINDOW)
        end = cut.start() if cut else len(low)
        yield from Counter(RUN.findall(low, at, end)).items()
        at = end


def slipped(run: str, seed: int) -> str:
    """The run, or what is left of it when its hash takes a character away; ``seed`` is the crc32 of what stands before it."""
    h = zlib.crc32(run.encode(), seed)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}
    for batch in text_slices(batches):
        raw, offsets = utf8(batch.column("_text"))
        low = LOWER[raw].tobytes()
        for row, name in enumerate(batch.column("_id").to_pylist()):
            seed = zlib.crc32(f"{name}:".encode())
            for run, n in runs(low[offsets[row] : offsets[row + 1]].decode()):
                word = slipped(run, seed)
                held[word] = held.get(word, 0) + n
        if len(held) > HELD:
            yield _counts(held)
            held = {}
    yield _counts(held)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: the words of whole texts that are long and frequent enough, with their occurrences."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_text"))
    counted = texts.mapInArrow(_count, "word string, n long").where(F.length("word") >= MIN_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """(_key, _last, n): every rotation without its last character and that character, and every rotation whole."""
    marked = words.select("n", F.concat("word", F.lit(END)).alias("_m"))
    turned = marked.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("_m")), lambda i: F.concat(F.col("_m").substr(i, F.length("_m")), F.col("_m").substr(F.lit(1), i - 1)))).alias("_r"))
    last = F.substring("_r", -1, 1)
    cut = F.struct(F.col("_r").substr(F.lit(1), F.length("_r") - 1).alias("key"), last.alias("last"))
    whole = F.struct(F.col("_r").alias("key"), F.lit("").alias("last"))
    return turned.select("n", F.explode(F.when(last == END, F.array(whole)).otherwise(F.array(cut, whole))).alias("_e")).select(F.col("_e.key").alias("_key"), F.col("_e.last").alias("_last"), "n")


def near_in_range(key: str, lasts: list[str], ns: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """Of each word of a range: itself, how many words of the range are near it, and the most frequent of these.

    The two most frequent words serve all others, so no pairs are made.
    """
    behind, _, before = key.partition(END)
    words = [before + x + behind for x in lasts]
    rank = lambda i: (-ns[i], words[i])
    short = next((i for i, x in enumerate(lasts) if not x), None)
    long = [i for i in range(len(lasts)) if i != short]
    first = [i for i in long if lasts[i] != key[-1]]  # the first of a run of equal characters
    top = sorted(long, key=rank)[:2]
    for i in long:
        others = [j for j in top if j != i][:1] + ([short] if short is not None and lasts[i] != key[-1] else [])
        if others:
            best = min(others, key=rank)
            yield words[i], len(long) - 1 + (short in others), ns[best], words[best]
    if short is not None and first:
        best = min(first, key=rank)
        yield words[short], len(first), ns[best], words[best]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of equal keys of sorted rotations; a range may go on in the next batch."""
    open_key, open_rows = None, ([], [])
    for batch in batches:
        if not len(batch):
            continue
        keys, lasts, ns = batch.columns
        new = np.flatnonzero(~pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1
        starts, ends = np.append(0, new), np.append(new, len(keys))
        out = []
        for a, b in zip(starts, ends, strict=True) if len(starts) < 3 else [(0, ends[0]), *((a, b) for a, b in zip(starts[1:-1], ends[1:-1], strict=True) if b - a > 1), (starts[-1], ends[-1])]:
            key, own = keys[int(a)].as_py(), (lasts.slice(a, b - a).to_pylist(), ns.slice(a, b - a).to_pylist())
            if key == open_key:
                open_rows[0].extend(own[0])
                open_rows[1].extend(own[1])
                continue
            if len(open_rows[0]) > 1:
                out += near_in_range(open_key, *open_rows)
            open_key, open_rows = key, own
        yield _near(out)
    if len(open_rows[0]) > 1:
        yield _near(list(near_in_range(open_key, *open_rows)))


def _near(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["word", "_near", "_n", "_best"])


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and the most frequent near word ``best`` with its ``best_n``, of words that have one."""
    ordered = rotations(words).repartitionByRange("_key").sortWithinPartitions("_key", "_last")
    found = ordered.mapInArrow(_scan, "word string, _near long, _n long, _best string")
    top = F.min(F.struct((-F.col("_n")).alias("less"), F.col("_best").alias("best")))
    return found.groupBy("word").agg(F.sum("_near").alias("n_near"), top.alias("_top")).select("word", "n_near", (-F.col("_top.less")).alias("best_n"), F.col("_top.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends. Each round doubles the steps; a step multiplies n by ``RATIO``, so rounds are few."""
    reached = materialise(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialise(reached.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        reached = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return reached


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of the documents: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    A word's form is its most frequent near word (then the smallest) if that is ``RATIO`` times as frequent; its
    root is where the forms lead. A null text has no words; a null id counts as an empty one. Rows that repeat an
    id each count. Other columns are not read; an empty table gives no rows.
    """
    words = materialise(vocabulary(docs, id_col, text_col), "spelling-words")
    near = materialise(neighbours(words), "spelling-near")
    strong = F.col("best_n") >= RATIO * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))
    formed = materialise(formed, "spelling-forms")
    return formed.join(roots(formed.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
