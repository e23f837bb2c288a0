"""Versioned tables and line logs: concurrent writers, jobs that fail, lines over block borders, offsets of streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from dotspark.sources import versions


@pytest.fixture(autouse=True)
def known(spark):
    versions.register(spark)


def load(spark, root, version=None):
    reader = spark.read.format("versioned")
    return sorted(r.id for r in (reader.option("version", version) if version else reader).load(root).collect())


def save(rows, root, mode="append"):
    rows.write.format("versioned").mode(mode).save(root)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    save(spark.range(10).repartition(3), root)
    save(spark.range(5, 15).repartition(2), root)
    save(spark.range(3), root, "overwrite")
    assert [load(spark, root, v) for v in (1, 2, 3, None)] == [list(range(10)), sorted([*range(10), *range(5, 15)]), [0, 1, 2], [0, 1, 2]]
    # What is read may be overwritten: the new version is made of the old one.
    save(spark.read.format("versioned").load(root).where("id > 0"), root, "overwrite")
    assert load(spark, root) == [1, 2]
    save(spark.range(0), root, "overwrite")
    assert load(spark, root) == [] and load(spark, root, 1) == list(range(10))


def test_the_second_of_two_writers_fails(spark, tmp_path):
    root = str(tmp_path / "table")
    save(spark.range(2), root)
    schema = spark.range(1).schema
    first, second = (versions.VersionWriter(root, schema, overwrite=True) for _ in range(2))
    batch = lambda n: iter(spark.range(n).toArrow().to_batches())
    written = [first.write(batch(3)), second.write(batch(4))]
    second.commit(written[1:])
    with pytest.raises(RuntimeError, match="another writer"):
        first.commit(written[:1])
    first.abort(written[:1])
    assert load(spark, root) == [0, 1, 2, 3] and not os.path.exists(written[0].path)
    assert sorted(os.listdir(f"{root}/manifests")) == ["v0000000001.json", "v0000000002.json"]


def test_a_job_that_fails_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "table")
    save(spark.range(4), root)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        save(bad, root, "overwrite")
    assert load(spark, root) == [0, 1, 2, 3] and len(os.listdir(f"{root}/manifests")) == 1
    with pytest.raises(Exception, match="no version"):
        load(spark, str(tmp_path / "none"))


def test_lines_over_block_borders(spark, tmp_path, monkeypatch):
    """However a file is cut to blocks, every line comes once, whole and with its place."""
    root = str(tmp_path / "log")
    os.makedirs(root)
    lines = ["", "é" * 7, "a", " b", "x" * 50, "{}", "last without an end"]
    data = "\n".join(lines).encode() + b"\nbad \xff\r\n"
    with open(f"{root}/a.jsonl", "wb") as f:
        f.write(data)
    open(f"{root}/empty.jsonl", "w").close()
    for block in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(versions, "BLOCK", block)
        reader = versions.LogReader(root)
        got = [x for p in reader.partitions() for x in reader.read(p)]
        assert [x[2] for x in got] == [*lines, "bad �"]
        assert all(data[x[1] :].startswith(x[2].encode()) for x in got[:-1])
    assert spark.read.format("linelog").load(root).count() == 8
    assert spark.read.format("linelog").load(str(tmp_path / "none")).count() == 0


def test_streams_read_what_is_new(spark, tmp_path):
    """Appended files and grown files: each line once, and a line that is not whole yet only when it is."""
    root, target, checkpoint = (str(tmp_path / p) for p in ("log", "out", "cp"))
    log = lambda values: spark.createDataFrame([(v,) for v in values], "value string").write.format("linelog").mode("append").save(root)

    def run():
        stream = spark.readStream.format("linelog").load(root)
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.value for r in spark.read.parquet(target).collect())

    log(["a", "b", "with\nbreak", None])
    assert run() == ["", "a", "b", "with break"]
    log(["c"])
    with open(f"{root}/grows.jsonl", "w") as f:
        f.write("d\nhal")
    assert run() == ["", "a", "b", "c", "d", "with break"]
    with open(f"{root}/grows.jsonl", "a") as f:
        f.write("f\n")
    assert run() == ["", "a", "b", "c", "d", "half", "with break"] == run()
    with pytest.raises(Exception, match="never overwritten"):
        spark.createDataFrame([("z",)], "value string").write.format("linelog").mode("overwrite").save(root)
    assert not [n for n in os.listdir(root) if n.startswith(".")]
    json.dumps(versions.LogStream(root).latestOffset())
