"""Token counts with overlap resynchronisation for huge documents.

Documents of at most ``CHUNK`` characters are encoded whole. Longer ones are cut into chunks that overlap
the next one; the chunks are dealt over all tasks and encoded with offsets. Two neighbours are spliced at
the first place in their overlap that both encodings have as a token boundary and that is proven stable,
whatever stands farther off:

* a non-white character followed by white space: no pre-token of the byte-level pattern holds that,
  look-ahead only sees white space runs, and the special string has no white space;
* between two white or two non-white characters whose adjoining bytes no token of the vocabulary holds side by
  side, so that no merge ever crosses, and with no apostrophe near, which could begin a contraction: the parts
  of a pre-token cut there are pre-tokens themselves. This is what splices runs of blanks.

Chunks whose overlap has no such place go round again as one stretch of text, from the stable place before
them to the one behind them, with longer chunks and wider overlaps; all others are done.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import materialise

#: Characters of a chunk without its overlap, and of the first overlap.
CHUNK, OVERLAP = 1 << 15, 512
#: Unicode's White_Space characters (fixed values).
WHITE = "\t\n\x0b\x0c\r\x20\x85\xa0                　"


#: The pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


#: Characters of a run without, or of, white space from which on the library encodes it: the fast encoder is
#: quadratic in a pre-token, and its pattern runs out of stack on white space.
LONG_RUN = 2048


class ByteBPE:
    """The vocabulary of a byte-level tokenizers file behind tiktoken's encoder, which is three times as fast.

    Both split by the same pattern and merge by the same ranks; a test compares them over all of Unicode.
    Units (white space and the run behind it) that hold a very long run are left to the tokenizers library: a
    unit begins at a stable place, so units can be encoded apart.
    """

    def __init__(self, path: str) -> None:
        import json
        from pathlib import Path

        import tiktoken

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.path = path
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for word, i in [*ranks.items(), *((k.encode(), i) for k, i in special.items())]:
            self.sizes[i] = len(word)
        #: Whether some token holds the two bytes side by side.
        self.joined = np.zeros((256, 256), bool)
        for word in [*ranks, *map(str.encode, special)]:
            pair = np.frombuffer(word, np.uint8)
            self.joined[pair[:-1], pair[1:]] = True
        self.long = re.compile(f"[{WHITE}]{{{LONG_RUN},}}|[^{WHITE}]{{{LONG_RUN},}}")
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

    @functools.cached_property
    def library(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or not self.long.search(text):
            return self.fast.encode(text, allowed_special=self.special)
        ids: list[int] = []
        start = 0
        for unit in self.units.finditer(text):
            if len(unit[0]) >= LONG_RUN and self.long.search(unit[0]):
                ids += self.fast.encode(text[start : unit.start()], allowed_special=self.special)
                ids += self.library.encode(unit[0], add_special_tokens=False).ids
                start = unit.end()
        return ids + self.fast.encode(text[start:], allowed_special=self.special)

    def ends(self, text: str) -> tuple[int, np.ndarray]:
        """How many tokens, and the byte offset behind each."""
        ids = self.encode(text)
        return len(ids), np.cumsum(self.sizes[ids])


@functools.cache
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


_WHITE_CODES = np.array([ord(c) for c in WHITE], np.uint32)


def stable_places(text: str, encoder: ByteBPE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``text`` (before which character) where no pre-token and no merge can cross, and their byte offsets."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    raw = np.frombuffer(text.encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64) + (codes > 0xFFFF))])
    white = np.isin(codes, _WHITE_CODES)
    inner = np.arange(1, len(codes))
    stable = ~white[:-1] & white[1:]
    apart = (white[:-1] == white[1:]) & ~encoder.joined[raw[offsets[inner] - 1], raw[offsets[inner]]]
    quote = codes == ord("'")
    apart &= ~quote[:-1] & ~quote[1:]
    apart[1:] &= ~quote[:-2]
    for name in encoder.special:
        at = text.find(name)
        while at >= 0:
            apart[at : at + len(name) - 1] = False
            at = text.find(name, at + 1)
    places = inner[stable | apart]
    return places, offsets[places]


def stable_counts(text: str, encoder: ByteBPE, spans: list[tuple[int, int]]) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """How many tokens, and for each span [low, high) the stable token boundaries in it: offsets and tokens before them."""
    total, ends = encoder.ends(text)
    places, at_byte = stable_places(text, encoder)
    k = np.searchsorted(ends, at_byte)
    there = (k < len(ends)) & (ends[np.minimum(k, max(len(ends) - 1, 0))] == at_byte) if len(ends) else np.zeros(len(places), bool)
    places, before = places[there], k[there] + 1
    cuts = [np.searchsorted(places, span) for span in spans]
    return total, [(places[a:b], before[a:b]) for a, b in cuts]


_CHUNKS = "_row long, _part long, _start long, _overlap long, _last boolean, _text string"
_PARTS = "_row long, _part long, _start long, _n long, _head array<long>, _head_n array<long>, _tail array<long>, _tail_n array<long>"


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, value in zip(batch.column("_row").to_pylist(), batch.column("_text"), strict=True):
            text = value.as_py()
            n = max(1, -(-len(text) // chunk))
            for part in range(n):
                start = part * chunk
                piece = text[start : start + chunk + overlap]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (row, part, start, overlap, part == n - 1, piece)], ["_row", "_part", "_start", "_overlap", "_last", "_text"])


def _encode_parts(batches: Iterator[pa.RecordBatch], path: str, chunk: int) -> Iterator[pa.RecordBatch]:
    encoder, longs = byte_bpe(path), pa.list_(pa.int64())
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for start, overlap, last, value in zip(*(batch.column(c).to_pylist() for c in ("_start", "_overlap", "_last", "_text")), strict=True):
            # Where the document begins and ends there is nothing to splice.
            spans = [(1, overlap) if start else (0, 0), (0, 0) if last else (chunk, chunk + overlap)]
            total, found = stable_counts(value, encoder, spans)
            for column, x in zip(out, [total, *(y for at, n in found for y in (at + start, n))], strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_part", "_start")), pa.array(out[0], pa.int64()), *(pa.array(x, longs) for x in out[1:])], ["_row", "_part", "_start", "_n", "_head", "_head_n", "_tail", "_tail_n"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text that go round again, one row each."""
    for batch in batches:
        for row, value, spans in zip(batch.column("_doc").to_pylist(), batch.column("_text"), batch.column("_spans").to_pylist(), strict=True):
            text = value.as_py()
            for a, b in ((s["a"], s["b"]) for s in spans):
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([text[a : len(text) if b is None else b]])], ["_doc", "_text"])


def _encode_whole(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = byte_bpe(path)
    for batch in batches:
        counts = [len(encoder.encode(t)) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"])


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(``_row``, ``n``, ``a``, ``b``): tokens of the stretches that are done, and the others as spans of the text (``n`` null)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = texts.select("_row", "_text").mapInArrow(functools.partial(_cut, chunk=chunk, overlap=overlap), _CHUNKS)
    coded = cut.repartition(parts, "_row", "_part").mapInArrow(functools.partial(_encode_parts, path=path, chunk=chunk), _PARTS)
    order = W.partitionBy("_row").orderBy("_part")
    # The place that both sides of a cut have; each side knows how many of its tokens stand before it.
    nxt = coded.withColumn("_at", F.get(F.array_intersect("_tail", F.lead("_head").over(order)), F.lit(0)))
    count = lambda places, counts, at: F.get(F.col(counts), (F.array_position(places, at) - 1).cast("int"))
    sided = nxt.withColumn("_until", count("_tail", "_tail_n", F.col("_at"))).withColumn("_from", F.lag("_at").over(order))
    sided = sided.withColumn("_skip", F.coalesce(count("_head", "_head_n", F.col("_from")), F.lit(0))).drop("_head", "_head_n", "_tail", "_tail_n")
    # Parts between two places found make a stretch; one of a single part is done.
    opened = F.when((F.col("_part") > 0) & F.col("_from").isNull(), 0).otherwise(1)
    marked = sided.withColumn("_stretch", F.sum(opened).over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = marked.groupBy("_row", "_stretch").agg(F.count(F.lit(1)).alias("_parts"), F.max(F.coalesce("_until", "_n") - F.col("_skip")).alias("_n"), F.min_by("_from", "_part").alias("_a"), F.max_by("_at", "_part").alias("b"))
    return whole.select("_row", F.when(F.col("_parts") == 1, F.col("_n")).alias("n"), F.coalesce("_a", F.lit(0)).alias("a"), "b")


def _huge_counts(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(``_row``, ``n_tokens``) of long texts: round by round the stretches that were not spliced, ever wider."""
    texts = huge.select(F.col("_row").alias("_doc"), "_row", "_text")
    done = None
    while True:
        found = materialise(_spliced(texts, path, chunk, overlap), "token-splices")
        docs = texts.select("_row", "_doc")
        counted = found.where("n IS NOT NULL").join(docs, "_row").select("_doc", "n")
        done = counted if done is None else done.unionByName(counted)
        again = found.where("n IS NULL").groupBy("_row").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
        if again.isEmpty():
            return done.groupBy(F.col("_doc").alias("_row")).agg(F.sum("n").alias("n_tokens"))
        cut = texts.join(again, "_row").select("_doc", "_text", "_spans").mapInArrow(_stretches, "_doc long, _text string")
        texts = materialise(cut.withColumn("_row", F.monotonically_increasing_id()), "token-stretches")
        chunk, overlap = chunk * 4, overlap * 16


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 512) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more tokens than ``limit``).

    Counts are those of the tokenizers file at ``path`` without added special tokens, truncation or padding;
    a special string inside a text is one token. A null text counts as empty: 0 bytes, 0 tokens. Rows that
    repeat an id are counted each. Other columns are not read; an empty table gives no rows. Texts may be as long
    as a string value gets, of one word or of white space alone too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    short = rows.where(F.length("_text") <= chunk).mapInArrow(functools.partial(_encode_whole, path=path), f"_id {id_type}, n_bytes long, n_tokens long")
    long = materialise(rows.where(F.length("_text") > chunk).withColumn("_row", F.monotonically_increasing_id()), "token-huge")
    counted = short
    if not long.isEmpty():
        spliced = long.drop("_text").join(_huge_counts(long, path, chunk, overlap), "_row")
        counted = short.unionByName(spliced.select("_id", "n_bytes", "n_tokens"))
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
