import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dotspark.llm import mixing
from dotspark.llm.scratch import keyed
from tests.llm.test_dedup import brute_near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(spark):
    base = "der schnelle braune fuchs springt über den faulen hund und läuft dann weiter durch den dunklen wald nach haus".split()
    near = lambda k: " ".join(base[:k] + ["neu"] + base[k + 1 :])
    texts = [" ".join(base), " ".join(base) + " ", near(18), near(9), "12 34 !!", None, "", "the cat and the dog are in the house with the others", "the  cat and the dog are in the house with the others"]
    texts += [f"a sentence number {i} about the thing that is said here again and again in word{i} and word{i * 7}" for i in range(30)]
    rows = [(i, t, "de" if i < 4 else "en", f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_stages_against_plain_versions(spark):
    docs, rows = make(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact_dedup", "near_dedup", "mix", "bpe"]
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, "").columns == COLUMNS
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(stages["language"](spark, docs, "")) == [i for i, t, *_ in rows if t and re.search("[a-z]", t)]
    norm = lambda t: re.sub(r"[ \t-\r]", "", t or "")
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0])):
        first.setdefault(norm(t), i)
    assert ids(stages["exact_dedup"](spark, docs, "")) == sorted(first.values())
    assert ids(stages["near_dedup"](spark, docs, "")) == [i for i, _, _, kept in brute_near([(r[0], r[1]) for r in rows], 5, 80) if kept]
    taken = {r.doc_id: r.taken / r.size if r.size else 0 for r in mixing.mix(docs).collect()}
    want = Counter({i: int(x + 0.5) for i, x in taken.items() if int(x + 0.5)})
    assert Counter(ids(stages["mix"](spark, docs, ""))) == want


def test_run_is_its_stages(spark, tmp_path):
    docs, rows = make(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {r[0] for r in rows} - {4, 5, 6}
    assert all(r.decoded_sha256 and r.n_tokens > 0 for r in out)


def test_empty_documents(spark, tmp_path):
    docs, _ = make(spark)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_stay(spark):
    docs, _ = make(spark)
    wide = docs.selectExpr("*", "doc_id AS size", "text AS ids", "1 AS kept", "2 AS _id", "3 AS _kept_id", "4 AS _times", "5 AS component")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns and out.count() > 0


def test_language_judges_each_row(spark):
    docs, rows = make(spark)
    twice = docs.unionByName(docs.where("doc_id = 7").selectExpr("doc_id", "'12 34' AS text", "lang", "source", "n_chars"))
    got = corpus_pipeline.language(spark, twice, "").where("doc_id = 7").collect()
    assert [r.text for r in got] == [rows[7][1]]


@pytest.mark.parametrize("many", [2, 4, 12])
def test_related_languages(spark, many):
    """A clean document has most n-grams in common with all languages; one that has only these is rejected."""
    shared = "the quick brown fox jumps over lazy dogs and runs far away from home today"
    own = ["baka", "ciki", "dodo", "fufu", "gegi", "haho", "jiju", "keko", "lalu", "mimo", "nuna", "popi"]
    rows = [(i, f"{shared} {own[i % many]} {own[i % many]}", f"l{i % many}") for i in range(30 * many)]
    rows += [(10_000, "the quick brown fox", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == list(range(30 * many))


def test_rows_of_a_table_are_numbered_without_a_copy(spark, tmp_path):
    """A scanned table's numbers differ by row and stay; joined or made rows are copied; clashing names do no harm."""
    path = str(tmp_path / "docs")
    spark.range(1000).selectExpr("id % 7 AS doc_id", "CAST(id AS string) AS text").repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    rows, key = keyed(table, "test-rows")
    assert rows.columns == ["doc_id", "text", key]
    assert not [f for f in rows.inputFiles() if "/test-rows-" in f and "/test-rows-files-" not in f]
    first = {r["text"]: r[key] for r in rows.collect()}
    assert len(set(first.values())) == len(first) == 1000
    assert first == {r["text"]: r[key] for r in rows.repartition(5).collect()}
    twice = table.withColumn("_twice", F.explode(F.sequence(F.lit(1), F.lit(2))))
    for other in (twice, twice.withColumnRenamed("_twice", "_metadata"), spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")):
        rows, key = keyed(other, "test-rows")
        assert rows.select(key).distinct().count() == other.count()
    clash = str(tmp_path / "clash")
    table.withColumn("_metadata", F.lit(1)).write.parquet(clash)
    rows, key = keyed(spark.read.parquet(clash), "test-rows")
    assert rows.select(key).distinct().count() == 1000 and "_metadata" in rows.columns
    spark.read.parquet(path).limit(0).write.parquet(str(tmp_path / "empty"))
    assert keyed(spark.read.parquet(str(tmp_path / "empty")), "test-rows")[0].count() == 0


def test_a_table_read_twice_is_numbered_by_row(spark, tmp_path):
    """Rows of a path that is given twice are rows of their own, and one of each group of equal texts stays."""
    path, single = str(tmp_path / "docs"), str(tmp_path / "more")
    spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string").coalesce(1).write.parquet(path)
    spark.createDataFrame([(4, "d")], "doc_id long, text string").write.parquet(single)
    for paths, rows_in, texts in (((path, path), 6, 2), ((path, single), 4, 3), ((path, single, path), 7, 3)):
        rows, key = keyed(spark.read.parquet(*paths), "test-rows")
        assert rows.count() == rows.select(key).distinct().count() == rows_in
        assert corpus_pipeline.exact(spark, spark.read.parquet(*paths), "").count() == texts
