import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dotspark.llm import exact_dedup, near_dedup, skew
from dotspark.llm.components import connected_components


def brute_exact(docs):
    norm = lambda t: re.sub("[ \t\n\x0b\x0c\r]", "", t or "")
    groups = {}
    for i, t, *_ in docs:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    out = []
    for i, t, *_ in docs:
        g = groups[norm(t)]
        keep = min(g)[1]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


def columns(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_exact(edge, edge_docs, parts):
    got = exact_dedup.exact_duplicates(edge, partitions=parts)
    assert columns(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(edge_docs)


def test_exact_group_over_many_partitions(spark):
    """One text makes most rows: splitters fall inside its group."""
    docs = [(i, "same text " + " " * (i % 5)) for i in range(400)] + [(1000 + i, f"other {i % 40}") for i in range(100)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), partitions=9)
    assert columns(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(docs)


def test_exact_ids_of_any_type(spark):
    low = -(2**63)
    for rows, want in (([("b", "x y"), ("a", "xy "), ("c", "z")], {("b", "a"), ("a", "a"), ("c", "c")}), ([(low, "xy"), (5, "x y"), (low + 1, "xy")], {(low, 5), (5, 5), (low + 1, 5)})):
        got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id string, text string" if isinstance(rows[0][0], str) else "doc_id long, text string"))
        assert got.schema["keep_id"].dataType == got.schema["doc_id"].dataType
        assert {(r.doc_id, r.keep_id) for r in got.collect()} == want


def test_hot_keys_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 3)
    monkeypatch.setattr(skew, "SHARE", 5)
    rows = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(60)], "k long, v long")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("many"), F.min("v").alias("low"))
    got = skew.join_keyed(rows, groups, ["k"], "many", 60).select("k", "v", "many", "low")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(groups, "k").select("k", "v", "many", "low").collect()))
    edges = [(0, i) for i in range(1, 40)] + [(40 + i, 41 + i) for i in range(9)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(40)} | {40 + i: 40 for i in range(10)}


def test_exact_drop(edge, edge_docs):
    got = exact_dedup.drop_exact_duplicates(edge)
    assert got.columns == edge.columns
    assert {r.doc_id for r in got.collect()} == {i for i, keep, _, kept, _ in brute_exact(edge_docs) if kept}


def test_exact_drop_keeps_one_row(spark):
    """Repeated rows of the winner, an id with two texts, and null ids: one row of each text."""
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (3, "c d"), (3, "e"), (4, "c  d"), (None, "f"), (None, "f"), (None, "e"), (None, "g")]
    got = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a b"), (3, "e"), (4, "c  d"), (None, "f"), (None, "g")]))


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute_near(docs, n, percent):
    sets = {}
    for i, t in docs:
        sets[i] = max(sets.get(i, frozenset()), shingles(t, n), key=len)
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({(i, len(sets[i]), find(i), find(i) == i) for i, _ in docs})


@pytest.mark.parametrize("n", [2, 5])
def test_near(edge, edge_docs, n):
    got = near_dedup.near_duplicates(edge, shingle=n)
    assert sorted(set(columns(got, "doc_id", "n_shingles", "component_id", "kept"))) == brute_near([(d[0], d[1]) for d in edge_docs], n, 80)


@pytest.mark.parametrize("blocks", [None, 8])
def test_near_group_with_chains(spark, monkeypatch, blocks):
    """Copies of copies: many pairs lie just above or below the bound, and small blocks tile the group."""
    if blocks:
        monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", blocks)
        monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 60 * blocks)
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    docs = []
    for i in range(150):
        words = list(base if i < 5 else docs[r.randrange(len(docs))][1].split())
        for _ in range(r.randrange(1, 5)):
            words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shingle=2)
    assert columns(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(docs, 2, 80)


def test_null_ids(spark):
    rows = [(None, "a b c"), (None, None), (3, "a b c"), (4, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = sorted(map(str, near_dedup.near_duplicates(docs, shingle=2).select("doc_id", "component_id", "kept").collect()))
    assert near == sorted(["Row(doc_id=None, component_id=None, kept=False)"] * 2 + ["Row(doc_id=3, component_id=3, kept=True)", "Row(doc_id=4, component_id=3, kept=False)"])
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()} == {(None, 3, False), (None, None, True), (3, 3, True), (4, 3, False)}


def test_near_drop_keeps_null_ids(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [(None, "one two three"), (None, "four five six"), (None, " ".join(near)), (5, " ".join(near[:-1])), (6, "seven eight nine"), (6, "ten eleven twelve")]
    got = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=2).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in (rows[i] for i in (0, 1, 3, 4, 5)))


def test_near_repeated_id_with_two_texts(spark):
    """Id 1 has two texts: its greater set counts for links, and the others' links do not hang on it."""
    words = [f"w{i}" for i in range(80)]
    small = [f"v{i}" for i in range(40)]
    docs = [(1, " ".join(words)), (1, " ".join(small)), (2, " ".join(small)), (3, " ".join(small[:-1])), (4, " ".join(words[:-1]))]
    for parts in (1, 2, 5):
        got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), shingle=2)
        assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 2), (3, 2), (4, 1)}


def test_empty_tables(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_sketch_counts_follow_similarity():
    r = np.random.default_rng(1)
    shared = r.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = (np.concatenate([shared, r.integers(0, 2**63, 100, dtype=np.uint64)]) for _ in range(2))
    far = r.integers(0, 2**63, 900, dtype=np.uint64)
    sketches = near_dedup.odd_sketch(np.stack([near_dedup.minhash(x) for x in (a, b, far)])).view(np.uint64)
    apart = lambda i, j: int(np.bitwise_count(sketches[i] ^ sketches[j]).sum())
    assert apart(0, 1) <= near_dedup.sketch_limit(0.8) < apart(0, 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 150), (150, 120), (7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 120: 100, 200: 200, 201: 200}
