"""Total orders, curves, splits and draws over several partitions, against numpy."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dotspark.operators import datasets, metrics, ranking

N = 400_000


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Rows with further columns: scores of which a third is one value, and ids in another order."""
    path = str(tmp_path_factory.mktemp("ranking") / "rows")
    score = F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(172_911)) / 172_911.0)
    rows = spark.range(N, numPartitions=7).select(F.pmod(F.col("id") * 7919, F.lit(N)).alias("key"), score.alias("score"), F.pmod(F.hash("id"), F.lit(2)).alias("label"), F.concat(F.lit("some further text "), F.col("id").cast("string")).alias("more"))
    rows.write.parquet(path)
    frame = spark.read.parquet(path)
    return frame, frame.toPandas()


@pytest.fixture(params=[(32, "true")], ids=str)
def partitions(request, spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param[0])
    spark.conf.set("spark.sql.adaptive.enabled", request.param[1])
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("partitions", [(8, "true"), (32, "false"), (200, "true")], indirect=True, ids=str)
def test_positions(table, partitions):
    frame, rows = table
    for order in (["key"], ["score", "key"]):
        got = ranking.positions(frame, order).toPandas()
        assert len(got) == N and sorted(got.columns) == sorted([*rows.columns, "position"])
        want = rows.sort_values(order).key.to_numpy()
        assert (got.sort_values("position").key.to_numpy() == want).all() and (np.sort(got.position) == np.arange(1, N + 1)).all()


def test_positions_of_ties(table, partitions):
    """Two thirds of the rows share two values; the order leaves them where they are, side by side."""
    frame, _ = table
    got = ranking.positions(frame.withColumn("few", F.when(F.col("key") % 3 > 0, F.col("key") % 3).otherwise(F.col("key"))), ["few"]).toPandas().sort_values("position")
    assert (np.sort(got.position) == np.arange(1, N + 1)).all() and (np.diff(got.few) >= 0).all() and got.key.is_unique


def test_curves(table, partitions):
    frame, rows = table
    steps = metrics.score_steps(frame)
    per = rows.groupby("score").label.agg(["sum", "count"]).sort_index(ascending=False)
    tp, fp = per["sum"].cumsum().to_numpy(), (per["count"] - per["sum"]).cumsum().to_numpy()
    got = steps.toPandas().sort_values("score", ascending=False)
    assert (got.tp.to_numpy() == tp).all() and (got.fp.to_numpy() == fp).all()
    pr = metrics.pr_curve(steps).toPandas().sort_values("score", ascending=False)
    assert np.allclose(pr.precision, tp / (tp + fp)) and np.allclose(pr.recall, tp / tp[-1])
    roc = metrics.roc_curve(steps).toPandas().sort_values("score", ascending=False)
    assert np.allclose(roc.fpr, fp / fp[-1]) and np.allclose(roc.tpr, tp / tp[-1])
    area = np.trapezoid(np.append(0, tp / tp[-1]), np.append(0, fp / fp[-1]))
    assert metrics.roc_auc(steps).first()[0] == pytest.approx(area) and abs(area - 0.5) < 0.01
    mean = (np.diff(tp / tp[-1], prepend=0) * tp / (tp + fp)).sum()
    assert metrics.average_precision(steps).first()[0] == pytest.approx(mean)


def digests(keys, seed="s"):
    return np.array([hashlib.md5(f"{seed}:{k}".encode()).hexdigest() for k in keys])


@pytest.mark.parametrize("ranked", [100, 10**9])
def test_splits(table, ranked, monkeypatch):
    """Boundaries by histogram and by plain rank agree with a sort."""
    monkeypatch.setattr(ranking.first_by_hash, "__defaults__", (ranking.DIGITS, ranked))
    frame, rows = table
    place = np.argsort(np.argsort(digests(rows.key)))
    got = datasets.split_annotations(frame, "key", 0.8).toPandas()
    assert len(got) == N and set(got.key[got.split == "train"]) == set(rows.key[place < int(N * 0.8)])
    place = rows.assign(d=digests(rows.key)).groupby("label").d.rank(method="first").to_numpy()
    n = rows.groupby("label").key.transform("count").to_numpy()
    train, val = np.floor(n * 0.8), np.floor(n * 0.15)
    got = datasets.split_stratified(frame, "key", "label").toPandas()
    for name, want in (("train", place <= train), ("val", (place > train) & (place <= train + val)), ("test", place > train + val)):
        assert set(got.key[got.split == name]) == set(rows.key[want])


def test_splits_of_repeated_keys_and_small_groups(spark):
    """One key on most rows: every hash digit is the boundary's; sizes stay exact."""
    rows = spark.createDataFrame([(1, "a", i) for i in range(900)] + [(i, "a", i) for i in range(2, 102)] + [(5, "b", 0), (6, None, 0), (7, None, 1), (8, None, 2)], "key long, grp string, v long")
    got = ranking.first_by_hash(rows, ["grp"], datasets.hash_order("s", "key"), [F.floor(F.col("n") * 0.5)], ["train", "test"], ranked=10).collect()
    assert len({(r.key, r.grp, r.v) for r in got}) == len(got) == 1004
    assert Counter((r.grp, r.split) for r in got) == {("a", "train"): 500, ("a", "test"): 500, ("b", "test"): 1, (None, "train"): 1, (None, "test"): 2}
    assert ranking.first_by_hash(rows.where("false"), ["grp"], datasets.hash_order("s", "key"), [F.floor(F.col("n") * 0.5)], ["train", "test"]).collect() == []


def test_draws(spark):
    """Exactly n draws; classes come equally often, and rows of a class, within five deviations."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("label"))
    got = datasets.draw_resample(rows, "id", "label").toPandas()
    assert sorted(got.draw) == list(range(3000))
    rare = (got.label == "rare").sum()
    assert abs(rare - 1500) < 5 * np.sqrt(3000 / 4)
    assert abs(got[got.label == "rare"].groupby("id").draw.count() - 50).max() < 5 * np.sqrt(50) + 1
    again = datasets.draw_resample(rows.repartition(5), "id", "label").toPandas()
    assert sorted(map(tuple, again[["draw", "id"]].values)) == sorted(map(tuple, got[["draw", "id"]].values))
    few = spark.createDataFrame([(1, 0), (2, 5), (3, None), (4, 1_000_000)], "id long, w long")
    drawn = ranking.draws(few, "w", ["id"], 40).toPandas()
    assert len(drawn) == 40 and set(drawn.id) <= {2, 4}
    assert ranking.draws(few.where("id = 1"), "w", ["id"], 5).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "k long, v double")
    assert ranking.positions(none, ["k"]).collect() == [] and ranking.running(none, ["k"], {"v": "s"}).collect() == []
    nulls = spark.createDataFrame([(None, 1.0), (3, 2.0), (1, 4.0), (None, 8.0)], "k long, v double")
    assert sorted(r.position for r in ranking.positions(nulls, ["k"]).collect() if r.k is None) == [1, 2]
    assert {r.k: r.s for r in ranking.running(nulls.where("k IS NOT NULL"), ["k"], {"v": "s"}, descending=True).collect()} == {3: 2.0, 1: 6.0}
