"""Near-duplicate components: MinHash bands for candidates, odd sketches to verify, full sets to confirm.

1. One pass over the texts gives each document its set's size and fingerprint, ``BANDS`` band keys of
   ``ROWS`` MinHash values each, and an odd sketch: the MinHash samples folded into a parity bitmap. Two
   sketches differ in few bits when the sets are similar: a sample in which they differ flips two bits.
2. Equal sets (equal size and 128-bit fingerprint) become one class; only its smallest id goes on.
3. A bucket is a band key shared by two classes or more. Within a bucket, pairs whose sketches pass (XOR
   population count) belong together; a spanning forest of them is kept, never the pairs. The forests of
   all buckets join to clusters.
4. Within a cluster, full sets are compared through an inverted index, and a spanning forest of the links is
   kept: a member that is already linked to the cluster's largest part is compared no more, all others are
   compared with every member. The forests join to components.

Buckets and clusters that are too large for a task are cut into blocks, and each pair of blocks is a tile
of its own. With 48 bands of 5 rows a pair at similarity 0.8 shares no bucket with probability
(1 - 0.8^5)^48 < 1e-8; the sketch bound, ``SLACK`` standard deviations off, loses fewer than 1e-6 there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .scratch import keyed, materialise
from .skew import join_keyed
from .words import mix, ngram_hashes, text_slices, utf8, word_hashes

BANDS, ROWS = 48, 5
#: Bits of an odd sketch, in 64-bit words.
WORDS = 8
SLACK = 5.0
#: Members of a bucket, and shingles of a cluster's sets, that one block holds.
BUCKET_BLOCK, CLUSTER_BLOCK = 4096, 1 << 20


def sketch_limit(similarity: float, samples: int = BANDS * ROWS, bits: int = 64 * WORDS) -> int:
    """The most differing bits that a pair of at least this similarity shows, ``SLACK`` deviations allowed.

    About samples * (1 - J) samples differ, give or take their binomial deviation; each flips two parity
    bits, and flips that meet cancel, which adds the deviation of a parity count.
    """
    differ = samples * (1 - similarity)
    fade = float(np.exp(-4 * differ / bits))
    spread = (2 * fade) ** 2 * differ * similarity + bits / 4 * (1 - fade * fade)
    return int(bits / 2 * (1 - fade) + SLACK * spread**0.5)


_rng = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BLOCK = 256


def minhash(grams: np.ndarray) -> np.ndarray:
    """One value per hash function over the set's 64-bit hashes."""
    low = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    best = np.full(len(_FACTORS), 2**32 - 1, np.uint32)
    for at in range(0, len(low), _BLOCK):
        part = low[at : at + _BLOCK, None] * _FACTORS[None, :]
        part ^= part >> np.uint32(15)
        part += _SHIFTS
        np.minimum(best, part.min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Rows of MinHash samples -> rows of ``WORDS`` 64-bit words of parities."""
    n, k = samples.shape
    bits = 64 * WORDS
    spot = (mix(samples.astype(np.uint64) ^ (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((spot + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1).view(np.int64)


def _print(unique: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (unique, mix(unique))) if len(unique) else (0, 0)


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        raw, offsets = utf8(batch.column("_text"))
        grams, bounds = ngram_hashes(*word_hashes(raw, offsets), shingle, short_rows=True)
        n = len(batch)
        sizes, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
        samples = np.zeros((n, BANDS * ROWS), np.uint32)
        for row in range(n):
            unique = np.unique(grams[bounds[row] : bounds[row + 1]])
            sizes[row] = len(unique)
            if len(unique):
                prints[row] = _print(unique)
                samples[row] = minhash(unique)
        keys = np.zeros((n, BANDS), np.uint64)
        for j in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, j::ROWS][:, :BANDS] + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(1 << 40))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
        sketch = odd_sketch(samples) if n else np.zeros((0, WORDS), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes), pa.array(prints[:, 0]), pa.array(prints[:, 1]), bands, *(pa.array(sketch[:, i]) for i in range(WORDS))], ["_id", "_n", "_p", "_q", "_bands", *(f"_s{i}" for i in range(WORDS))])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The sorted distinct shingle hashes of each text, as bytes, with their number and fingerprint."""
    for batch in text_slices(batches):
        raw, offsets = utf8(batch.column("_text"))
        grams, bounds = ngram_hashes(*word_hashes(raw, offsets), shingle, short_rows=True)
        sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        prints = np.array([_print(s) for s in sets], np.int64).reshape(-1, 2)
        sizes = np.array([len(s) for s in sets], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["_id", "_n", "_p", "_q", "_set"])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from batches sorted by them, across batch ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        same = np.ones(len(batch) - 1, bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            same &= column[1:] == column[:-1]
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(batch)]])
        for i, (x, y) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _forest(ids: np.ndarray, sketches: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Edges that connect all pairs of a bucket whose sketches pass."""
    n = len(ids)
    root = np.arange(n)
    for at in range(n):
        # The first member is compared with all; then only those that are not yet with it.
        if at and root[at] == root[0]:
            continue
        near = np.bitwise_count(sketches ^ sketches[at]).sum(axis=1) <= limit
        for other in np.unique(root[near]):
            if other != root[at]:
                to = int(np.flatnonzero(near & (root == other))[0])
                yield int(ids[at]), int(ids[to])
                root[root == other] = root[at]


def _bucket_edges(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    names = [f"_s{i}" for i in range(WORDS)]
    for tile in grouped(batches, ["_key", "_i", "_j"]):
        ids = tile.column("_id").to_numpy()
        sketches = np.column_stack([tile.column(c).to_numpy() for c in names]).view(np.uint64)
        edges = list(_forest(ids, sketches, limit))
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges]), pa.array([b for _, b in edges])], ["a", "b"])


def links_of(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, as places in ``sets``."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(codes, kind="stable")
    holders = owners[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    ends = np.cumsum(sizes)
    root, tested, out = np.arange(len(sets)), np.zeros(len(sets), bool), []
    while True:
        main = np.bincount(root).argmax()
        # What is with the largest part needs no test of its own: all others are tested against it.
        open_ = np.flatnonzero(~tested & (root != main))
        if not len(open_):
            return out
        if not tested.any():
            open_ = open_[:1] if len(sets) > 2 else open_
        for at in open_:
            if root[at] == main and len(open_) > 1:
                continue
            mine = codes[ends[at] - sizes[at] : ends[at]]
            n = first[mine + 1] - first[mine]
            spots = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(holders[spots], minlength=len(sets))
            near = 100 * shared >= percent * (sizes + sizes[at] - shared)
            tested[at] = True
            own, joined = root[at], np.unique(root[near])
            out += [(int(at), int(np.flatnonzero(near & (root == other))[0])) for other in joined if other != own]
            # The main part keeps its name, so that members joined to it are passed over.
            root[np.isin(root, joined)] = main if main in joined else own


def _cluster_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for tile in grouped(batches, ["_cluster", "_i", "_j"]):
        ids = tile.column("_id").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in tile.column("_set")]
        links = links_of(sets, percent)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(ids[[a for a, _ in links]]), pa.array(ids[[b for _, b in links]])], ["a", "b"])


def tiled(rows: DataFrame, key: str, blocks: Column, id_col: str = "_id") -> DataFrame:
    """``rows`` with tile numbers ``_i`` <= ``_j``: each row goes to the tiles of its block with every block of its key."""
    own = F.pmod(F.xxhash64(id_col, F.lit(5)), blocks).cast("int")
    cut = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return cut.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_own", "_other")


def _linked(docs: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(``id``, ``component``) of all representatives that link with another one."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["_id"].dataType.simpleString()
    banded = reps.select("_id", F.explode("_bands").alias("_key"))
    shared = banded.groupBy("_key").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1")
    bucketed = join_keyed(banded, shared, ["_key"], "_many", BANDS * reps.count())
    members = tiled(bucketed, "_key", F.ceil(F.col("_many") / BUCKET_BLOCK)).drop("_many")
    sketched = members.join(reps.select("_id", *(f"_s{i}" for i in range(WORDS))), "_id")
    tiles = sketched.repartition(parts, "_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j")
    edges = tiles.mapInArrow(functools.partial(_bucket_edges, limit=sketch_limit(similarity)), f"a {id_type}, b {id_type}")
    clusters = connected_components(edges)
    clusters = materialise(clusters.select(F.col("id").alias("_id"), F.col("component").alias("_cluster")), "near-clusters")
    sizes = clusters.join(reps.select("_id", "_n"), "_id").groupBy("_cluster").agg(F.ceil(F.sum("_n") / CLUSTER_BLOCK).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_many"))
    placed = tiled(join_keyed(clusters, sizes, ["_cluster"], "_many", clusters.count()), "_cluster", F.col("_blocks")).drop("_blocks", "_many")
    wanted = clusters.select("_id")
    sets = docs.join(wanted, "_id", "left_semi").mapInArrow(functools.partial(_sets, shingle=shingle), f"_id {id_type}, _n long, _p long, _q long, _set binary")
    # Of rows that repeat an id only those of the representative's set: these are equal.
    own = sets.join(reps.select("_id", "_n", "_p", "_q"), ["_id", "_n", "_p", "_q"], "left_semi").select("_id", "_set").dropDuplicates(["_id"])
    spread = placed.join(own, "_id").repartition(parts, "_cluster", "_i", "_j").sortWithinPartitions("_cluster", "_i", "_j")
    links = spread.mapInArrow(functools.partial(_cluster_links, percent=round(100 * similarity)), f"a {id_type}, b {id_type}")
    return materialise(connected_components(links), "near-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    A-Z is lowered and words are ``[^\\x20\\x09-\\x0D]+``; a document's set is its distinct ``shingle``-word
    sequences, or its whole sequence if it has fewer words. Documents link when 100 * intersection >=
    100 * similarity * union, confirmed on the full sets (as 64-bit hashes); ``component_id`` is the smallest
    id reachable. A document without words or text has size 0 and links with nothing, its component being
    itself. Rows that repeat an id are one document: the row with the greatest set counts for links, of equally
    great ones that with the greatest fingerprint, and all share its component. A null id gets a null component and ``kept`` false. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    words = ", ".join(f"_s{i} long" for i in range(WORDS))
    signed = materialise(rows.mapInArrow(functools.partial(_signatures, shingle=shingle), f"_id {id_type}, _n long, _p long, _q long, _bands array<long>, {words}"), "near-signatures")
    real = signed.where("_n > 0 AND _id IS NOT NULL")
    tops = real.groupBy("_id").agg(F.max(F.struct("_n", "_p", "_q")).alias("_top")).select("_id", "_top.*")
    tops = materialise(tops, "near-tops")
    classes = materialise(tops.groupBy("_n", "_p", "_q").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_many")), "near-classes")
    # One row per representative, which has one class: rows that remain of its id have the class's set.
    reps = signed.join(classes.select("_n", "_p", "_q", F.col("_rep").alias("_id")), ["_id", "_n", "_p", "_q"], "left_semi")
    reps = materialise(reps.dropDuplicates(["_id"]), "near-reps")
    labels = _linked(rows.where(F.col("_id").isNotNull()), reps, shingle, similarity)
    of_class = classes.join(labels, classes["_rep"] == labels["id"], "left").select("_n", "_p", "_q", "_many", F.coalesce("component", "_rep").alias("_component"))
    of_id = join_keyed(tops, of_class, ["_n", "_p", "_q"], "_many", tops.count()).select("_id", "_component")
    out = signed.select("_id", "_n").join(of_id, "_id", "left")
    out = out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_component", "_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component; all columns stay as they are.

    Each row is a document of its own here, also where its id is null or repeated, with a number of its own as
    vertex. The smallest id of a component stays, a null id only if all of its ids are null; of rows that
    repeat the id the first as written. A row without words is a component.
    """
    docs, key = keyed(docs, "near-rows")
    found = near_duplicates(docs.select(F.col(key).alias("_row"), F.col(text_col).alias("_text")), "_row", "_text", shingle, similarity).select("_row", "component_id")
    named = found.join(docs.select(F.col(key).alias("_row"), F.col(id_col).alias("_id")), "_row")
    best = F.min(F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id"), F.col("_row")))
    kept = named.groupBy("component_id").agg(best.alias("_best")).select(F.col("_best._row").alias(key))
    return docs.join(kept, key, "left_semi").drop(key)
