"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presence bits of hashed words, word pairs and pairs with one word skipped. Each coordinate has
its own rate, and the L1 term keeps a weight at zero until its gradients add up, so the fitted weights are
few and small enough to broadcast. Shards of the sample are passed over apart; after each round the
shards' states are averaged coordinate by coordinate. Features are not kept: each round takes them anew from
the sample's texts, which are written once, a folder a shard, so that a round shuffles no document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from .language_id import held_out
from .scratch import materialise
from .words import LOOSE, mix, ngram_hashes, text_slices, utf8, word_hashes

#: Coordinates; the last stands for the constant.
BITS = 20
#: Labelled documents that are learned from, in expectation.
TRAIN_DOCS = 16_000
SHARDS, ROUNDS = 4, 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 2.0, 0.01


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all texts' features, repeats included, and the row of each."""
    raw, offsets = utf8(column)
    words, bounds = word_hashes(raw, offsets, LOOSE)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs, pair_bounds = ngram_hashes(words, bounds, 2)
    skip = np.flatnonzero(np.arange(len(words)) + 2 < ends)
    skips = mix(words[skip] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[skip + 2]))
    every = np.concatenate([words, pairs, skips])
    where = np.concatenate([rows, np.repeat(np.arange(len(bounds) - 1), np.diff(pair_bounds)), rows[skip]])
    return (every % np.uint64((1 << BITS) - 1)).astype(np.int32), where


@dataclass
class State:
    """Per coordinate the sums that FTRL keeps; weights follow from them."""

    z: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    n: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on a document with feature coordinates ``at`` (distinct, the constant among them)."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _pass(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """One pass over a shard, in order, from the common state; how the coordinates it touched moved."""
    state = shared.value
    new, constant = State(state.z.copy(), state.n.copy()), (1 << BITS) - 1
    for batch in text_slices(batches):
        at, rows = features(batch.column("_text"))
        pairs = np.unique(np.concatenate([rows.astype(np.int64) << 32 | at, np.arange(len(batch), dtype=np.int64) << 32 | constant]))
        ends = np.searchsorted(pairs, np.arange(len(batch) + 1, dtype=np.int64) << 32)
        for row, label in enumerate(batch.column("_label").to_pylist()):
            new.learn(pairs[ends[row] : ends[row + 1]] & 0xFFFFFFFF, label)
    moved = np.flatnonzero(new.n != state.n)
    for i in range(0, len(moved), 1 << 16):
        part = moved[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(a[part] - b[part]) for a, b in ((new.z, state.z), (new.n, state.n)))], ["_at", "_z", "_n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Weights by coordinate, from labelled rows that are not held out: by hash of the id, about ``train_docs``.

    What comes to the driver each round is at most one row per coordinate and shard. A document with several labelled rows
    is learned from as often, one with a null id or label never; rows that repeat an id are each a document.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    many = known.count()
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 20)) < int(min(1.0, train_docs / max(many, 1)) * (1 << 20)))
    order = F.xxhash64("_id", F.lit(11))
    # The sample's ids are bounded by ``train_docs``, so they may go to every task; the texts stay where they are.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select(F.pmod(order, F.lit(SHARDS)).cast("int").alias("_shard"), order.alias("_order"), "_label", "_text")
    train = materialise(rows.repartitionByRange(SHARDS, "_shard"), "toxicity-train", ["_shard"])
    # A shard reads its folder alone, in one task: FTRL is a sequence.
    shards = [train.where(F.col("_shard") == i).select("_order", "_label", "_text").coalesce(1).sortWithinPartitions("_order", "_text").select("_label", "_text") for i in range(SHARDS)]
    state = State()
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(state)
        step = functools.partial(_pass, shared=shared)
        # A job for each shard, side by side; one job over a union of single partitions would be one task.
        with ThreadPoolExecutor(SHARDS) as jobs:
            tables = list(jobs.map(lambda shard: shard.mapInArrow(step, "_at int, _z double, _n double").toArrow(), shards))
        for table in tables:
            at = table.column("_at").to_numpy()
            state.z[at] += table.column("_z").to_numpy() / SHARDS
            state.n[at] += table.column("_n").to_numpy() / SHARDS
        shared.destroy()
    return state.weights().astype(np.float32)


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    places, values = shared.value
    weights = np.zeros(1 << BITS, np.float32)
    weights[places] = values
    for batch in text_slices(batches):
        at, rows = features(batch.column("_text"))
        heavy = np.flatnonzero(weights[at])
        pairs = np.unique(rows[heavy].astype(np.int64) << 32 | at[heavy])
        sums = np.bincount(pairs >> 32, weights[pairs & 0xFFFFFFFF].astype(np.float64), minlength=len(batch)) + float(weights[-1])
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["_id", "score"])


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` in (0, 1), ``predicted`` (1 from 0.5 on).

    Only the text is looked at; a null or empty text has the constant's score. The broadcast holds the
    weights that are not zero, at most 2^20. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    places = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((places, weights[places]))
    id_type = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(functools.partial(_score, shared=shared), f"_id {id_type}, score double")
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learn from the labelled rows that are not held out and score all of ``docs``: also ``held_out``."""
    out = score(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
