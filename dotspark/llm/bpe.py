"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A text is cut into units (a run of white space and the non-white run behind it), which never share a
token. A unit seen for the first time is merged; its tokens are then kept in a flat store and later texts
gather them by index. Merging holds, for each unit, an array of part boundaries with the rank of the two
adjacent parts: the minimum is looked for again and again, its boundary deleted and the two neighbouring
ranks refreshed. Units of one length class are merged together, one row of a matrix each.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .token_count import PATTERN, WHITE, byte_letters

#: Units kept by a task before it begins anew; with their tokens some 60 MB.
KEPT = 300_000
#: Bytes of matrix cells merged at a time.
CELLS = 1 << 19
NONE = np.int32(2**31 - 1)


class Merges:
    """Rank of each mergeable pair of tokens and the token it makes, in an open-addressed table."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, made = (np.array([vocab[x] for x in column], np.int64) for column in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for word, i in vocab.items():
            self.bytes[i] = word.encode() if word in self.special else bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.made = np.append(made, 0).astype(np.int32)
        # Four slots to a pair; the few that share a slot go to the next free one.
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.full((1 << self.bits) + 64, NONE, np.int32)
        self.probes = 1
        keys = (left << 32) | right
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            step = 0
            while self.keys[slot + step] not in (-1, key):
                step += 1
            if self.keys[slot + step] == -1:
                self.keys[slot + step], self.ranks[slot + step] = key, rank
            self.probes = max(self.probes, step + 1)
        self.words = regex.compile(PATTERN)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token ids; ``NONE`` where they do not merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            there = self.keys[slot[open_] + step]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]] + step]
            open_ = open_[~hit & (there != -1)]
        return out

    def merge(self, ids: np.ndarray, bounds: np.ndarray, barrier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of one batch. ``ids`` (rows x width): first tokens, -1 behind the end; ``bounds``: row sizes.

        ``barrier`` (rows x width): no merge over the boundary behind this place. Returns the ids with
        deleted places as -1, and the row sizes then.
        """
        rows, width = ids.shape
        place = np.arange(width)
        after = np.broadcast_to(place + 1, ids.shape).copy()  # the next part's place
        before = np.broadcast_to(place - 1, ids.shape).copy()
        ranks = np.full(ids.shape, NONE, np.int32)
        if width > 1:
            inner = (place[1:] < bounds[:, None]) & ~barrier[:, :-1]
            r, c = np.nonzero(inner)
            ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        live = np.arange(rows)
        while len(live):
            at = ranks[live].argmin(axis=1)
            least = ranks[live, at]
            go = least != NONE
            live, at, least = live[go], at[go], least[go]
            if not len(live):
                break
            gone = after[live, at]
            ids[live, at] = self.made[least]
            ids[live, gone] = -1
            # Delete the boundary: the part at ``gone`` belongs to the one at ``at`` now.
            blocked = barrier[live, gone]
            barrier[live, at] = blocked
            nxt = after[live, gone]
            after[live, at] = nxt
            ranks[live, gone] = NONE
            inside = nxt < bounds[live]
            before[live[inside], nxt[inside]] = at[inside]
            fresh = np.full(len(live), NONE, np.int32)
            ok = inside & ~blocked
            fresh[ok] = self.rank(ids[live[ok], at[ok]], ids[live[ok], nxt[ok]])
            ranks[live, at] = fresh
            prev = before[live, at]
            ok = prev >= 0
            ok[ok] &= ~barrier[live[ok], prev[ok]]
            ranks[live[ok], prev[ok]] = self.rank(ids[live[ok], prev[ok]], ids[live[ok], at[ok]])
        return ids, (ids >= 0).sum(axis=1)

    @functools.cached_property
    def merged(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and made token of each pair, for words that are merged pair by pair."""
        full = self.keys >= 0
        return {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(self.made[r])) for k, r in zip(self.keys[full], self.ranks[full], strict=True)}

    def long_word(self, ids: list[int]) -> list[int]:
        """The same merging for one long word: a heap gives the minimum instead of a scan."""
        import heapq

        n, merged = len(ids), self.merged
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        stamp = [0] * n

        def push(i: int) -> None:
            stamp[i] += 1
            found = merged.get((ids[i], ids[after[i]])) if after[i] < n else None
            if found:
                heapq.heappush(heap, (found[0], i, stamp[i]))

        first = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)) if n > 1 else []
        heap = [(int(r), i, 0) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, mark = heapq.heappop(heap)
            if mark != stamp[i]:
                continue
            gone = after[i]
            ids[i], ids[gone] = int(self.made[rank]), -1
            stamp[gone] += 1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [i for i in ids if i >= 0]


#: Bytes from which on a unit is merged with a heap; below it, by scans of its ranks.
LONG = 96


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Merges with a store of the units met so far."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        self.merges, self.kept = merges(path), kept
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def _special_unit(self, unit: str) -> np.ndarray:
        """A unit with special strings: each is one token, and what stands between is merged by itself."""
        m = self.merges
        words = [[p] if p in m.special else m.words.findall(p) for p in m.split.split(unit)]
        ids = [[m.special[w]] if w in m.special else m.long_word(m.byte_ids[np.frombuffer(w.encode(), np.uint8)].tolist()) for ws in words for w in ws]
        return np.array([x for part in ids for x in part], np.int32)

    def _add(self, units: list[str]) -> None:
        """Merge units and store their tokens."""
        m, base = self.merges, len(self.index)
        words = list(map(m.words.findall, units))
        data = [w.encode() for ws in words for w in ws]
        flat = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        unit_ends = ends[np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1]
        sizes = np.diff(unit_ends, prepend=0)
        starts = unit_ends - sizes
        # No merge over the end of a pre-token.
        wall = np.zeros(len(flat), bool)
        wall[ends - 1] = True
        slow = sizes > LONG
        if m.split:
            slow |= np.fromiter((m.split.search(u) is not None for u in units), bool, len(units))
        first, count, pieces, total = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [], len(self.tokens)
        for i in np.flatnonzero(slow):
            if m.split and m.split.search(units[i]):
                tokens = self._special_unit(units[i])
            else:
                tokens = np.array([x for w in words[i] for x in m.long_word(m.byte_ids[np.frombuffer(w.encode(), np.uint8)].tolist())], np.int32)
            first[i], count[i] = total, len(tokens)
            total += len(tokens)
            pieces.append(tokens)
        order = np.flatnonzero(~slow)
        order = order[np.argsort(sizes[order], kind="stable")]
        spot = 0
        while spot < len(order):
            width = int(sizes[order[spot]]) + 2
            chosen = order[spot : spot + max(1, CELLS // width)]
            chosen = chosen[sizes[chosen] <= width]
            spot += len(chosen)
            n = sizes[chosen]
            inside = np.arange(width) < n[:, None]
            source = (starts[chosen][:, None] + np.arange(width))[inside]
            ids = np.full(inside.shape, -1, np.int32)
            ids[inside] = m.byte_ids[flat[source]]
            barrier = np.zeros(inside.shape, bool)
            barrier[inside] = wall[source]
            ids, counts = m.merge(ids, n, barrier)
            pieces.append(ids[ids >= 0])
            first[chosen], count[chosen] = total + np.cumsum(counts) - counts, counts
            total += len(pieces[-1])
        self.index.update(zip(units, range(base, base + len(units)), strict=True))
        self.first, self.count, self.tokens = np.concatenate([self.first, first]), np.concatenate([self.count, count]), np.concatenate([self.tokens, *pieces])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and the n+1 offsets of each text's."""
        lists = list(map(self.units.findall, texts))
        units = list(itertools.chain.from_iterable(lists))
        fresh = set(units) - self.index.keys()
        if len(self.index) + len(fresh) > self.kept and self.index:
            self._clear()
            fresh = set(units)
        if fresh:
            self._add(list(fresh))
        which = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        counts = self.count[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.tokens[np.repeat(self.first[which] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` characters, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tool = Encoder(path)  # its store goes with the task
    for batch in batches:
        texts = pc.fill_null(batch.column("_text"), "").to_pylist()
        for a, b in _slices([len(t) for t in texts], 1 << 20):
            ids, ends = tool.encode(texts[a:b])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), lists], [*batch.schema.names[:-1], "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = merges(path)
    for batch in batches:
        lists = batch.column("ids")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
        for a, b in _slices(sizes, 1 << 18):
            part = lists.slice(a, b - a)
            ids = np.asarray(part.flatten(), np.int64)
            n = m.size[ids]
            ends = np.concatenate([[0], np.cumsum(n)])
            data = m.flat[np.repeat(m.start[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
            cuts = ends[np.concatenate([[0], np.cumsum(sizes[a:b])])]
            # Bytes that are no UTF-8 become replacement characters, as in the library.
            texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array of int): the tokens of each whole text, no special token added.

    A special string inside a text is its one token. A null text counts as empty and has no tokens. One
    row per input row, repeated ids included; other columns are not read. An empty table gives no rows. A text
    is worked as a whole; a run of a million characters without white space, or of it, takes seconds.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_encode, path=path), f"_id {id_type}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, ``ids`` and ``decoded``: the text of each token list, special tokens kept. Null ids give an empty text."""
    rows = encoded.select(F.col(id_col).alias("_id"), "ids")
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_decode, path=path), f"_id {id_type}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    yield from _decode(_encode(batches, path), path)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one pass: a task has one Python worker, and token lists do not cross over in between."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_coded, path=path), f"_id {id_type}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)
