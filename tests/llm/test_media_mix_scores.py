import gzip
import hashlib
import io
import math
import re
import struct
import time
import zipfile
import zlib
from collections import Counter, defaultdict

import pytest

from dotspark.llm import lm_score, media, mixing


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
SAMPLES = {"image/png": png(), "application/zip": zipped(), "image/gif": GIF, "application/gzip": gzip.compress(b"text"), "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF", "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02scan\xff\xd9"}


@pytest.mark.parametrize("kind", SAMPLES)
def test_signatures_are_confirmed_and_carved(kind):
    data = SAMPLES[kind]
    assert media.confirmed(data) == [(kind, 0, len(data))]
    assert media.confirmed(b"junk" + data + b"tail") == [(kind, 4, len(data))]
    assert media.confirmed(data[: len(data) - 3]) == []


def page(serial, number, body, last=False):
    head = b"OggS\x00" + bytes([4 if last else 0]) + struct.pack("<QII", 0, serial, number)
    rest = bytes([1, len(body)]) + body
    return head + struct.pack("<I", media.ogg_crc(head + b"\0\0\0\0" + rest)) + rest


def flac(blocks=2):
    """Constant frames of 192 samples, one channel of 16 bits."""
    info = struct.pack(">HH", 192, 192) + bytes(6) + (44100 << 44 | 15 << 36 | 192 * blocks).to_bytes(8, "big") + bytes(16)
    out = b"fLaC\x80\x00\x00\x22" + info
    for i in range(blocks):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, i])
        frame = head + bytes([media.crc(head, 8, 0x07), 0x00]) + struct.pack(">h", 7 + i)
        out += frame + media.crc(frame, 16, 0x8005).to_bytes(2, "big")
    return out


def wav(payload):
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def pdf(extra=b""):
    body = b"%PDF-1.4\n1 0 obj\n" + extra + b"endobj\n"
    return body + b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(body)


def test_checksums():
    assert media.crc(b"123456789", 16, 0x8005) == 0xFEE8 and media.crc(b"123456789", 32, 0x04C11DB7) == media.ogg_crc(b"123456789") == 0x89A1897F and media.crc(b"123456789", 8, 0x07) == 0xF4


def test_streams_end_where_they_end():
    ogg = page(1, 0, b"abc") + page(1, 1, b"de", last=True)
    assert media.confirmed(b"x" + ogg + page(2, 0, b"f", last=True) + b"tail") == [("audio/ogg", 1, len(ogg)), ("audio/ogg", 1 + len(ogg), len(page(2, 0, b"f")))]
    assert media.confirmed(ogg[:30] + b"?" + ogg[31:]) == [("audio/ogg", len(page(1, 0, b"abc")), len(page(1, 1, b"de")))]  # a bad page
    for blocks in (1, 2, 5):
        assert media.confirmed(b"junk" + flac(blocks) + b"tail") == [("audio/flac", 4, len(flac(blocks)))]
    assert media.confirmed(flac()[:-1]) == []


def test_media_inside_media():
    inner = wav(b"ab" * 20)
    assert media.confirmed(wav(b"  " + inner)) == [("audio/wav", 0, 46 + len(inner)), ("audio/wav", 46, len(inner))]
    thumb = SAMPLES["image/jpeg"]
    outer = b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + len(thumb)) + thumb + b"\xff\xda\x00\x02a\xff\x00b\xff\xd0c\xff\xc4\x00\x04\xff\xd9\xff\xda\x00\x02d\xff\xd9"
    assert media.confirmed(outer) == [("image/jpeg", 0, len(outer)), ("image/jpeg", 6, len(thumb))]
    nested = io.BytesIO()
    with zipfile.ZipFile(nested, "w") as z:
        z.writestr("in.zip", zipped())
    found = media.confirmed(nested.getvalue())
    assert found[0] == ("application/zip", 0, len(nested.getvalue())) and found[1][2] == len(zipped()) and len(found) == 2
    one, embedding = pdf(), pdf(b"stream\n" + pdf() + b"\nendstream\n")
    assert media.confirmed(one + one) == [("application/pdf", 0, len(one)), ("application/pdf", len(one), len(one))]
    assert media.confirmed(embedding) == [("application/pdf", 0, len(embedding)), ("application/pdf", embedding.index(b"stream") + 7, len(one))]
    updated = one + b"\n2 0 obj\nendobj\n"
    updated += b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(updated)
    assert media.confirmed(updated) == [("application/pdf", 0, len(updated))]


@pytest.mark.parametrize("word", [b"%PDF-1.", b"PK\x03\x04", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02", b"GIF89a", b"OggS\x00", SAMPLES["image/png"][:41], b"RIFF", b"\x1f\x8b\x08", b"fLaC\x80\x00\x00\x22"])
def test_repeated_magic_words_take_linear_time(word):
    start = time.process_time()
    assert media.confirmed(word * (1_000_000 // len(word))) == []
    assert time.process_time() - start < 10  # a search to the end from each word takes minutes


def test_magic_words_in_text_are_no_media():
    assert media.confirmed(b"RIFF and GIF89a and %PDF- and PK\x03\x04 and OggS in a text fLaC") == []


def test_stored_texts_come_back(edge, edge_docs, empty):
    rows = media.sniff(media.store(edge)).collect()
    assert len(rows) == len(edge_docs)
    texts = {d[0]: d[1] or "" for d in edge_docs}
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(payload) + 44 and r.type == "audio/wav"
    assert media.sniff(media.store(empty)).count() == 0


def test_embedded_media_in_a_column(spark):
    rows = [(1, 3, SAMPLES["image/png"], "image/gif"), (2, 0, None, "x/y"), (3, 5, b"plain", "text/plain"), (4, 9, b"ab" + GIF, "application/octet-stream")]
    out = {r.doc_id: r for r in media.sniff(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, declared_type string")).collect()}
    assert [out[i].type for i in (1, 2, 3, 4)] == ["image/png", "x/y", "text/plain", "application/octet-stream"]
    assert [(c.type, c.offset, c.length) for c in out[4].carved] == [("image/gif", 2, len(GIF))]


def brute_mix(docs):
    size = lambda t: len((t or "").encode().split())
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(size(t) for _, t, x in docs if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total, capped = sum(sizes.values()), set()
    while True:  # share, cap, and share the excess again
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in sources if s not in capped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        if not over:
            break
        capped |= over
    return sizes, {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in sources}, size


@pytest.mark.parametrize("shape", ["even", "skewed", "tiny", "nulls"])
def test_mix(spark, shape):
    text = lambda n: "w " * n
    docs = {
        "even": [(i, text(i % 50 + 1), f"s{i % 5}") for i in range(500)],
        "skewed": [(i, text(i % 9), "big" if i % 3 else f"s{i % 11}") for i in range(600)] + [(9999, text(5000), "s1")],
        "tiny": [(1, text(3), "a"), (2, text(100), "b"), (2, text(100), "b"), (3, "", "c")],
        "nulls": [(i, None if i % 4 == 0 else text(7), None if i % 5 == 0 else "é" if i % 2 else "z") for i in range(200)],
    }[shape]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)).collect()
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(docs)
    sizes, targets, size = brute_mix(docs)
    by_id = {(i, size(t)): s for i, t, s in docs}
    taken = defaultdict(int)
    for r in got:
        source = by_id[(r.doc_id, r.size)]
        assert r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 2 for s in targets)


def test_mix_edges(edge, edge_docs, empty):
    assert mixing.mix(edge).count() == len(edge_docs)
    assert mixing.mix(empty).count() == 0


def brute_scores(docs, order, min_count):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for _, t in docs]
    counts = [Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(counts[0].values())

    def score(context, word):
        gram = (*context, word)
        if not context:
            return counts[0][gram] / total
        if counts[len(gram) - 1][gram] >= min_count:
            return counts[len(gram) - 1][gram] / counts[len(context) - 1][context]
        return 0.4 * score(context[1:], word)

    return {i: (len(w), sum(math.log(score(tuple(w[max(0, k - order + 1) : k]), x)) for k, x in enumerate(w))) for (i, _), w in zip(docs, words, strict=True)}


@pytest.mark.parametrize("frequent", [lm_score.FREQUENT, 100, 0])
@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_stupid_backoff(edge, edge_docs, monkeypatch, frequent, min_count):
    """Whether a word's count comes from the broadcast or from the join."""
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    docs = [(d[0], d[1]) for d in edge_docs]
    got = lm_score.lm_scores(edge, min_count=min_count).collect()
    want = brute_scores(docs, 2, min_count)
    assert len(got) == len(docs)
    for r in got:
        assert r.n_words == want[r.doc_id][0] and abs(r.log_score - want[r.doc_id][1]) < 2e-3


def test_hot_words_and_bigrams(spark):
    """One word in every place, one bigram in every document, and all documents begin alike."""
    docs = [(i, f"the end {'the ' * (i % 7)}w{i} the end") for i in range(400)] + [(None, "the end"), (None, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute_scores(docs[:-2] + [(-1, "the end"), (-2, None)], 2, 2)
    got = lm_score.lm_scores(rows).collect()
    assert len(got) == len(docs)
    for r in got:
        n, log = want[r.doc_id if r.doc_id is not None else -1 if r.n_words else -2]
        assert r.n_words == n and abs(r.log_score - log) < 2e-3


def test_scores_of_an_empty_table(empty):
    assert lm_score.lm_scores(empty).count() == 0
