"""Media columns: store bytes as audio samples, and sniff signatures in binary columns.

``store`` wraps a text's bytes in a RIFF/WAVE container of 8-bit samples with a declared type that need
not be right. ``sniff`` reads the stored bytes: an Aho-Corasick automaton finds every magic number at
once, a validator per format confirms structure and lengths, the declared type is corrected to the one
confirmed at offset 0, and what else is confirmed is carved as (type, offset, length).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Payloads are padded with spaces to a positive multiple of this.
BLOCK = 192
#: Samples per second in the stored form.
RATE = 8000

#: Magic numbers by format (fixed values of the public format descriptions).
SIGNATURES = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"OggS": "audio/ogg",
    b"fLaC": "audio/flac",
}


class Bytes:
    """The bytes of one medium with what several signatures ask for, each found once: the work stays linear.

    A repeated magic word without its end mark costs a look into a list and no search to the end.
    """

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.chains: dict[tuple[str, int], int] = {}

    def places(self, mark: bytes) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(mark), self.data)]

    @functools.cached_property
    def scan_ends(self) -> list[int]:
        """Markers that end JPEG scan data: no stuffed byte, no restart, no fill."""
        return [m.start() for m in re.finditer(rb"\xff[\x01-\xcf\xd8-\xfe]", self.data)]

    @functools.cached_property
    def zeros(self) -> list[int]:
        return self.places(b"\0")

    @functools.cached_property
    def archives(self) -> dict[int, int]:
        """Start of each ZIP archive -> its end: the end record tells the start, and the directory must be there. The last end wins."""
        out = {}
        for end in self.places(b"PK\x05\x06"):
            if end + 22 <= len(self.data):
                size, start, note = struct.unpack_from("<IIH", self.data, end + 12)
                at = end - start - size
                if at >= 0 and self.data[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(self.data):
                    out[at] = end + 22 + note
        return out

    @functools.cached_property
    def documents(self) -> dict[int, int]:
        """Start of each PDF -> its end. An end mark names the place of the cross-reference that it belongs to, counted
        from the document's start; so it tells the start, and a document that was updated ends at its last mark."""
        heads = [m.start() for m in re.finditer(rb"%PDF-[12]\.", self.data)]
        known, out, fallback = set(heads), {}, {}
        tables = [m.start() for m in re.finditer(rb"(?<!start)xref\b|\b\d+ \d+ obj\b", self.data)]
        for m in re.finditer(rb"startxref\s+(\d{1,12})\s+%%EOF", self.data):
            offset, before = int(m[1]), bisect.bisect_left(tables, m.start())
            head = heads[bisect.bisect_left(heads, m.start()) - 1] if heads and heads[0] < m.start() else None
            if offset and before and tables[before - 1] - offset in known:
                out[tables[before - 1] - offset] = m.end()
            elif head is not None and offset and re.match(rb"xref\b|\d+ \d+ obj\b", self.data[head + offset : head + offset + 40]):
                out[head] = m.end()
            elif head is not None:
                fallback.setdefault(head, m.end())
        return fallback | out


def _chain(b: Bytes, kind: str, at: int, step: Callable[[int], tuple[int, bool]]) -> int:
    """End of a chain of parts from ``at`` on, 0 if it breaks; ``step`` gives a part's end and whether it is the last.

    Where a chain ends does not depend on where it began, so every place is walked once.
    """
    seen = []
    while (kind, at) not in b.chains:
        seen.append(at)
        stop, last = step(at)
        if last or not stop:
            b.chains[kind, at] = stop
            break
        at = stop
    end = b.chains[kind, at]
    b.chains.update({(kind, spot): end for spot in seen})
    return end


def _wav(b: Bytes, at: int) -> int:
    """Length of a RIFF/WAVE file of PCM samples at ``at``; 0 if its chunks do not add up."""
    data = b.data
    if len(data) < at + 44 or data[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data):
        return 0
    spot, seen = at + 12, set()
    while spot + 8 <= end:
        name, size = data[spot : spot + 4], int.from_bytes(data[spot + 4 : spot + 8], "little")
        spot += 8 + size + (size & 1)
        seen.add(name)
    return end - at if spot in (end, end + 1) and {b"fmt ", b"data"} <= seen else 0


def _png(b: Bytes, at: int) -> int:
    """IHDR first, chunks up to IEND, and then every chunk's checksum."""
    data = b.data

    def step(spot: int) -> tuple[int, bool]:
        stop = spot + 12 + int.from_bytes(data[spot : spot + 4], "big")
        return (stop, data[spot + 4 : spot + 8] == b"IEND") if spot + 12 <= len(data) and stop <= len(data) else (0, True)

    end = _chain(b, "png", at + 8, step) if data[at + 8 : at + 16] == b"\0\0\0\rIHDR" else 0
    spot = at + 8
    while 0 < spot < end:
        stop = step(spot)[0]
        if zlib.crc32(data[spot + 4 : stop - 4]) != int.from_bytes(data[stop - 4 : stop], "big"):
            return 0
        spot = stop
    return end - at if end else 0


def _gif(b: Bytes, at: int) -> int:
    """Screen descriptor, colour tables and blocks up to the trailer."""
    data = b.data

    def step(spot: int) -> tuple[int, bool]:
        kind = data[spot]
        if kind == 0x3B:
            return spot + 1, True
        if kind == 0x21:
            spot += 2
        elif kind == 0x2C:
            flags = data[spot + 9]
            spot += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return 0, True
        while data[spot]:
            spot += data[spot] + 1
        return spot + 1, False

    try:
        flags = data[at + 10]
        end = _chain(b, "gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), step)
    except IndexError:
        return 0
    return end - at if end else 0


def _jpeg(b: Bytes, at: int) -> int:
    """Marker segments with lengths and scans between them, up to the end marker; a picture has a scan."""
    data = b.data

    def step(spot: int) -> tuple[int, bool]:
        if spot + 2 > len(data) or data[spot] != 0xFF:
            return 0, True
        if data[spot + 1] == 0xD9:
            return spot + 2, True
        size = int.from_bytes(data[spot + 2 : spot + 4], "big")
        if size < 2 or spot + 2 + size > len(data):
            return 0, True
        stop = spot + 2 + size
        if data[spot + 1] == 0xDA:
            place = bisect.bisect_left(b.scan_ends, stop)
            stop = b.scan_ends[place] if place < len(b.scan_ends) else 0
        return stop, False

    end = _chain(b, "jpeg", at + 2, step)
    return end - at if end and b"\xff\xda" in data[at:end] else 0


def _pdf(b: Bytes, at: int) -> int:
    return b.documents.get(at, at) - at


def _zip(b: Bytes, at: int) -> int:
    return b.archives.get(at, at) - at


def _gzip(b: Bytes, at: int) -> int:
    """Header fields by the flags, then deflate data whose checksum and size are right."""
    data = b.data
    flags, spot = data[at + 3] if at + 10 <= len(data) else 0xFF, at + 10
    if flags & 0xE0:
        return 0
    if flags & 4:
        spot += 2 + int.from_bytes(data[spot : spot + 2], "little")
    for _ in range(bool(flags & 8) + bool(flags & 16)):  # a name and a comment, each up to a zero
        place = bisect.bisect_left(b.zeros, spot)
        spot = b.zeros[place] + 1 if place < len(b.zeros) else len(data)
    spot += 2 if flags & 2 else 0

    def inflate(start: int) -> tuple[int, bool]:
        tool, check, size = zlib.decompressobj(-15), 0, 0
        feed = memoryview(data)
        try:
            for x in range(start, len(data), 1 << 16):
                out = tool.decompress(feed[x : x + (1 << 16)])
                check, size = zlib.crc32(out, check), size + len(out)
                if tool.eof:
                    end = min(len(data), x + (1 << 16)) - len(tool.unused_data)
                    return (end + 8 if data[end : end + 8] == struct.pack("<II", check, size & 0xFFFFFFFF) else 0), True
        except zlib.error:
            pass
        return 0, True

    end = _chain(b, "gzip", spot, inflate)
    return end - at if end else 0


@functools.cache
def _crc_table(bits: int, polynomial: int) -> list[int]:
    """Bytewise table of a checksum that takes the high bit first: one shift-and-subtract for each entry."""
    top, full = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for value in range(256):
        rest = value << (bits - 8)
        for _ in range(8):
            rest = (rest << 1 ^ polynomial) & full if rest & top else rest << 1 & full
        table.append(rest)
    return table


def crc(data: bytes, bits: int, polynomial: int, rest: int = 0) -> int:
    table, shift, full = _crc_table(bits, polynomial), bits - 8, (1 << bits) - 1
    for byte in data:
        rest = rest << 8 & full ^ table[rest >> shift ^ byte]
    return rest


#: Each byte with its bits in reverse.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """Checksum of an Ogg page: that of zlib, high bit first, nothing inverted."""
    return int(f"{zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _ogg(b: Bytes, at: int) -> int:
    """Consecutive pages of one stream with right checksums; their segment tables give the lengths."""
    data, serial = b.data, b.data[at + 14 : at + 18]

    def step(spot: int) -> tuple[int, bool]:
        if spot + 27 > len(data) or data[spot : spot + 5] != b"OggS\x00":
            return 0, True
        lacing = data[spot + 27 : spot + 27 + data[spot + 26]]
        stop = spot + 27 + data[spot + 26] + sum(lacing)
        if stop > len(data) or ogg_crc(data[spot : spot + 22] + b"\0\0\0\0" + data[spot + 26 : stop]) != int.from_bytes(data[spot + 22 : spot + 26], "little"):
            return 0, True
        # The next page belongs to the stream if it has its serial number and this one is not the last.
        more = not data[spot + 5] & 4 and data[stop : stop + 5] == b"OggS\x00" and data[stop + 14 : stop + 18] == serial
        return (stop, not more)

    end = _chain(b, "ogg", at, step)
    return end - at if end else 0


#: Block sizes by code in a FLAC frame header (fixed values); 6 and 7: given behind the frame's number.
FLAC_BLOCKS = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {8 + i: 256 << i for i in range(8)}


def _flac_frame(data: bytes, at: int) -> tuple[int, int]:
    """(samples, header length) of a frame header with a right checksum; (0, 0) if there is none."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        return 0, 0
    block, rate = head[2] >> 4, head[2] & 15
    lead = head[4]
    size = 5 + (0 if lead < 0x80 else max(0, 7 - (lead ^ 0xFF).bit_length()))
    samples = FLAC_BLOCKS.get(block, 0)
    if block in (6, 7):
        samples = int.from_bytes(head[size : size + block - 5], "big") + 1
        size += block - 5
    size += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return (samples, size + 1) if samples and size < len(head) and crc(head[:size], 8, 0x07) == head[size] else (0, 0)


def _flac(b: Bytes, at: int) -> int:
    """STREAMINFO of 34 bytes, metadata blocks, then frames until its number of samples is reached.

    A frame ends where its 16-bit checksum comes out and, but for the last, another frame header begins.
    """
    data = b.data
    if data[at + 4 : at + 8] not in (b"\x00\x00\x00\x22", b"\x80\x00\x00\x22"):
        return 0
    total = int.from_bytes(data[at + 21 : at + 26], "big") & (1 << 36) - 1
    spot, last = at + 4, False
    while not last and spot + 4 <= len(data):
        last = data[spot] >= 0x80
        spot += 4 + int.from_bytes(data[spot + 1 : spot + 4], "big")
    if not last or spot > len(data):
        return 0
    done, table = 0, _crc_table(16, 0x8005)
    while done < total or not total:
        samples, size = _flac_frame(data, spot)
        if not samples:
            return spot - at if not total and done else 0
        rest, end, place = 0, 0, spot
        for byte in memoryview(data)[spot:]:
            rest = rest << 8 & 0xFFFF ^ table[rest >> 8 ^ byte]
            place += 1
            if not rest and place - spot > size + 2 and (done + samples >= total > 0 or place == len(data) or _flac_frame(data, place)[0]):
                end = place
                break
        if not end:
            return 0
        done, spot = done + samples, end
    return spot - at


VALIDATORS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    tree = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        tree.add_word(magic.decode("latin-1"), (len(magic), kind))
    tree.make_automaton()
    return tree


def confirmed(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every confirmed medium, in order of offset, those inside others as well.

    Only what a format repeats by itself is passed over: the pages of one Ogg stream.
    """
    found: list[tuple[str, int, int]] = []
    held, pages = Bytes(data), 0
    for last, (size, kind) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - size
        if kind == "audio/ogg" and at < pages:
            continue
        length = VALIDATORS[kind](held, at)
        if length:
            found.append((kind, at, length))
            pages = at + length if kind == "audio/ogg" else pages
    return sorted(found, key=lambda f: f[1])


def wav_payload(data: bytes) -> bytes:
    """The sample bytes of a RIFF/WAVE file."""
    spot = 12
    while spot + 8 <= len(data):
        size = int.from_bytes(data[spot + 4 : spot + 8], "little")
        if data[spot : spot + 4] == b"data":
            return data[spot + 8 : spot + 8 + size]
        spot += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _little(value: Column, width: int) -> Column:
    """An integer column as ``width`` little-endian bytes."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(width)])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """id, ``n_bytes``, ``media`` (a WAVE file of the padded UTF-8 bytes as 8-bit mono samples), ``declared_type``.

    A null text counts as empty; equal texts give equal media. Only the id and the text are read. A text
    may have up to 2^31 - 1 - 44 bytes, the most that one binary value holds.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    padded = F.greatest(F.ceil(size / F.lit(BLOCK)), F.lit(1)).cast("int") * F.lit(BLOCK)
    rows = docs.select(F.col(id_col).alias("_id"), size.cast("long").alias("n_bytes"), padded.alias("_size"), raw.alias("_raw"))
    # The payload's length is even, so the data chunk needs no pad byte.
    fixed = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data"
    header = F.concat(F.encode(F.lit("RIFF"), "UTF-8"), _little(F.col("_size") + 36, 4), F.encode(F.lit("WAVE"), "UTF-8"), F.unhex(F.lit(fixed.hex())), _little(F.col("_size"), 4))
    fill = F.expr("cast(repeat(' ', _size - cast(n_bytes as int)) as binary)")
    return rows.select(F.col("_id").alias(id_col), "n_bytes", F.concat(header, F.col("_raw"), fill).alias("media"), F.lit(declared).alias("declared_type"))


_CARVED = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
_FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "type": pa.string(), "carved": _CARVED, "feature": pa.string()}
_SQL_TYPES = {pa.int64(): "long", pa.string(): "string", _CARVED: "array<struct<type:string,offset:long,length:long>>"}


def _features(size: int, data: bytes, declared: str) -> tuple:
    found = confirmed(data)
    kind = next((k for k, at, _ in found if at == 0), declared)
    payload = wav_payload(data) if kind == "audio/wav" else data
    rest = [{"type": k, "offset": at, "length": n} for k, at, n in found if at]
    mean = float(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) / len(payload) if payload else 0.0
    feature = f"{kind};n={len(payload)};mean={mean:.4f};carved={','.join(r['type'] for r in rest)}"
    return size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), kind, rest, feature


def sniff(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Features read back from ``store``'s media column, one row per row.

    ``type`` is the confirmed type at offset 0 (the declared one if none is confirmed), ``carved`` lists all
    other confirmed media, ``feature`` is type, sample count, mean sample and the carved types in short.
    A null medium has no payload: lengths 0, digests of nothing. Rows that repeat an id are read each; an empty
    table gives no rows.
    """
    id_type = media.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(size.as_py(), value.as_py() or b"", declared.as_py()) for size, value, declared in zip(*batch.columns[1:], strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True))], ["_id", *_FIELDS])

    picked = media.select(F.col(id_col).alias("_id"), "n_bytes", "media", "declared_type")
    shape = ", ".join(f"{name} {_SQL_TYPES[kind]}" for name, kind in _FIELDS.items())
    return picked.mapInArrow(read, f"_id {id_type}, {shape}").withColumnRenamed("_id", id_col)
