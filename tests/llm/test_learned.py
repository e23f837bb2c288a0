"""Language identification and toxicity: edge cases, held-out accuracy, nothing learned from what is held out."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dotspark.llm import language_id, toxicity

SYLLABLES = {"de": "sch ung keit ein ver lich ach".split(), "en": "the ing tion and ea ou th".split(), "fr": "eau tion elle ou ai eux que".split()}


def corpus(n=600, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en" if i % 3 == 1 else "fr"
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(8, 60))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["awful", "rotten", "nasty"])
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, toxic int").repartition(4)


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_languages_of_held_out_documents(docs):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [row for row in corpus() if is_held_out(row[0])]
    assert all(got[i].held_out == is_held_out(i) for i in got)
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_is_learned_from_held_out_rows(spark):
    """A language that only held-out rows have is never predicted."""
    rows = [(i, t, "xx" if is_held_out(i) else lang) for i, t, lang, _ in corpus(200)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"de", "en", "fr"}


def test_edge_documents(edge, edge_docs, empty):
    rows = language_id.identify(edge).collect()
    assert len(rows) == len(edge_docs)
    und = {i for i, t, *_ in edge_docs if t is None or not any(c.isalpha() for c in t)}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == und
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(edge.withColumn("lang", edge.lang.substr(9, 1)).where("doc_id < 5")).collect()} <= {"und", ""}


def test_shares_do_not_depend_on_windows(monkeypatch, docs):
    filters = language_id.fit(docs)
    texts = pa.array([t for _, t, _, _ in corpus(40)] + [None, "", "ab", "ein " * 4000])
    whole = language_id.shares(texts, filters)
    monkeypatch.setattr(language_id, "WINDOW", 7)
    assert np.allclose(language_id.shares(texts, filters), whole)


def test_filters_contain_all_typical_grams(docs):
    """Bloom filters have no false negatives, and few false positives at their size."""
    filters = language_id.fit(docs)
    data, offsets = language_id._lowered(pa.array(["keit sch ung"]))
    code, real = language_id._grams(data, language_id._row_of(offsets), 0, len(data), 3)
    masks = filters.masks(code[real])[:, 0]
    assert ((masks >> np.uint64(filters.langs.index("de"))) & np.uint64(1)).mean() > 0.7
    noise = language_id.mix(np.arange(20000, dtype=np.uint64)) | np.uint64(1 << 63)
    assert all(((filters.masks(noise)[:, 0] >> np.uint64(i)) & np.uint64(1)).mean() < 0.05 for i in range(len(filters.langs)))


def test_toxic_held_out_documents(docs):
    got = {r.doc_id: r for r in toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).collect()}
    held = [row for row in corpus() if is_held_out(row[0])]
    assert sum(got[i].predicted == y for i, _, _, y in held) >= 0.9 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_edges(spark, edge, edge_docs, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 25)] + [(None, 1, None), (3, None, None)], "doc_id long, toxic int, text string")
    assert toxicity.toxicity(edge, labels).count() == len(edge_docs)
    none = labels.where("toxic > 5")
    assert {r.score for r in toxicity.toxicity(edge, none).collect()} == {0.5}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_weights_are_sparse(docs):
    weights = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert 0 < np.count_nonzero(weights) < 500


def test_a_rare_toxic_word_is_learned(spark):
    """A word in a dozen of the sample's 12,000 or so documents, three of a shard, is enough."""
    rare = {i for i in range(16000) if i % 1000 == 1}
    rows = [(i, f"plain {i % 7} words {i % 11}" + (" zyxw" if i in rare else ""), int(i in rare)) for i in range(16000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    weights = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert weights[toxicity.features(pa.array(["zyxw"]))[0][0]] > 0


def test_one_shard_is_plain_ftrl(spark, monkeypatch):
    """Coordinate by coordinate as the algorithm is written down, document after document, round after round."""
    monkeypatch.setattr(toxicity, "SHARDS", 1)
    rows = corpus(120)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    got = toxicity.fit(docs, labels)
    keys = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 11) AS k").collect()}
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.ROUNDS):
        for i, t, _, y in sorted((r for r in rows if not is_held_out(r[0])), key=lambda r: keys[r[0]]):
            at = sorted({int(x) for x in toxicity.features(pa.array([t]))[0]} | {(1 << toxicity.BITS) - 1})
            w = {k: weight(k) for k in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for k in at:
                old = n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (n[k] ** 0.5 - old**0.5) / toxicity.ALPHA * w[k]
    want = {k: weight(k) for k in z if weight(k)}
    assert set(np.flatnonzero(got)) == set(want)
    assert all(abs(got[k] - w) < 1e-4 for k, w in want.items())


def test_repeated_and_null_labels(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(None, "x"), (5, rows[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] * 2 + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 62 and sum(r.doc_id is None for r in got) == 1


def test_language_shares_against_sets(docs):
    """The filters' corrected counts against plain sets of each language's n-grams, looked up one by one."""
    filters = language_id.fit(docs)
    texts = [t for i, t, *_ in corpus(60)]
    got = language_id.shares(pa.array(texts), filters)
    for text, mine in zip(texts, got, strict=True):
        data, offsets = language_id._lowered(pa.array([text]))
        rows = language_id._row_of(offsets)
        hits, every = np.zeros(len(filters.langs)), 0
        for order in language_id.ORDERS:
            code, real = language_id._grams(data, rows, 0, len(data), order)
            for gram in code[real]:
                every += 1
                hashed = int(language_id.mix(np.array([gram], np.uint64))[0])
                slots = [(hashed >> 20 * i) & (len(filters.slots) - 1) for i in range(language_id.HASHES)]
                for k in range(len(filters.langs)):
                    hits[k] += all(int(filters.slots[s, 0]) >> k & 1 for s in slots)
        wrong = filters.fill**language_id.HASHES
        assert np.allclose(mine, np.clip((hits / every - wrong) / (1 - wrong), 0, 1))
