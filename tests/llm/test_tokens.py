import hashlib
import random
import time

import pytest
from tokenizers import Tokenizer

from dotspark.llm import bpe, token_count
from dotspark.llm.queries import tokenizer_path
from dotspark.llm.scratch import materialise

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(token_count.CHUNK, token_count.OVERLAP), (200, 20), (37, 5), (10, 1)])
def test_counts_with_any_chunks(edge, edge_docs, library, chunk, overlap):
    """Small chunks force splices, overlaps without a stable boundary, and widening up to the whole text."""
    docs = edge if chunk > 1000 else edge.where("length(text) < 20000 OR text IS NULL")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs, PATH, chunk=chunk, overlap=overlap).collect())
    want = sorted((i, len((t or "").encode()), len(ids(library, t)), len(ids(library, t)) > 512) for i, t, *_ in edge_docs if chunk > 1000 or t is None or len(t) < 20000)
    assert got == want


def test_very_long_texts(spark, library):
    """A million characters of blanks, of line ends, of one word, and of words between blobs without a space."""
    r = random.Random(5)
    blob = lambda: "".join(r.choice("abcdefghij0123456789+/'") for _ in range(40_000))
    texts = ["a" + " " * 1_000_000 + "b", "\n" * 600_001 + "b", "ab" * 400_000, "".join("the cat sat on it " * 3000 + blob() for _ in range(10)), " \t\u00a0\u3000" * 100_000, "x<|endoftext|>'s " * 60_000]
    start = time.monotonic()
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    assert time.monotonic() - start < 120
    assert got == {i: len(ids(library, t)) for i, t in enumerate(texts)}


def test_only_what_fails_goes_round_again(spark, monkeypatch):
    """Of a text with one blob the stretch around it alone is encoded a second time."""
    seen = []
    monkeypatch.setattr(token_count, "materialise", lambda df, label: seen.append((label, materialise(df, label))) or seen[-1][1])
    text = "some words to cut " * 20_000 + "ab" * 40_000 + " and more of them " * 20_000
    assert token_count.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).count() == 1
    again = [df for label, df in seen if label == "token-stretches"]
    assert again and sum(len(r._text) for r in again[0].collect()) < 80_000 + 4 * token_count.CHUNK


def test_places_are_stable(library):
    """Texts cut at any of their stable places have the same tokens."""
    tool = token_count.ByteBPE(PATH)
    text = "don't  we'll\n\n\r\n 'tis!!'s  it's\u00a0 \u3000x 12 345 ab<|endoftext|>'re é日本 \t end  "
    places, _ = token_count.stable_places(text, tool)
    assert len(places) > 10
    for i in places:
        assert ids(library, text[:i]) + ids(library, text[i:]) == ids(library, text)


def test_long_words_encode_as_the_library(library):
    mine, r = bpe.Encoder(PATH), random.Random(6)
    for text in ("ab" * 50_000, " " * 60_000 + "b", "\n" * 50_001, "".join(r.choice("abcdefgh") for _ in range(60_000))):
        assert mine.encode([text])[0].tolist() == ids(library, text)


def test_encode_and_decode_as_the_library(edge, edge_docs, library):
    rows = bpe.decode(bpe.encode(edge, PATH), PATH).collect()
    got = sorted((r.doc_id, hashlib.sha256(str(list(r.ids)).encode()).hexdigest(), r.decoded) for r in rows)
    want = sorted((i, hashlib.sha256(str(ids(library, t)).encode()).hexdigest(), library.decode(ids(library, t), skip_special_tokens=False)) for i, t, *_ in edge_docs)
    assert got == want


def test_empty_tables(empty):
    assert token_count.token_counts(empty, PATH).count() == 0
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_parts_of_characters_decode_as_the_library(spark, library):
    rows = [(1, [128, 250, 11]), (2, ids(library, "日")[:1]), (3, [])]
    out = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()
    assert {r.doc_id: r.decoded for r in out} == {i: library.decode(x, skip_special_tokens=False) for i, x in rows}


def test_all_of_unicode(library):
    """The two encoders class every character alike: each stands between letters, digits, signs and white space."""
    fast, mine = token_count.ByteBPE(PATH), bpe.Encoder(PATH)
    for start in range(0x80, 0x110000, 8192):
        chars = [chr(c) for c in range(start, min(start + 8192, 0x110000), 1 if start < 0x30000 else 16) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}a 1{c}1 !{c}! \n" for c in chars)
        want = ids(library, text)
        assert fast.encode(text) == want
        assert mine.encode([text])[0].tolist() == want


def test_a_small_store_changes_nothing(library):
    small = bpe.Encoder(PATH, kept=3)
    for text in ("one two three", "three four two one", "one two three four five"):
        assert small.encode([text])[0].tolist() == ids(library, text)


def test_round_trip_is_decode_of_encode(edge, empty):
    path = tokenizer_path()
    rows = lambda df: sorted((r.doc_id or 0, r.ids, r.decoded) for r in df.collect())
    assert rows(bpe.round_trip(edge, path)) == rows(bpe.decode(bpe.encode(edge, path), path))
    assert bpe.round_trip(empty, path).collect() == []
