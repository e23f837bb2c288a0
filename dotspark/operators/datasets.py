"""Training sets: splits, negatives, resampling, leave-one-out, versions, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranking import draws, first_by_hash
from .sequences import free_ranges


def hash_order(seed: str, *keys: str) -> Column:
    """A total order by hash that reruns and other engines share."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def split_annotations(rows: DataFrame, key: str, fraction: float, seed: str = "s", by: list[str] | None = None) -> DataFrame:
    """``split``: train for the first floor(n * fraction) rows by hash (within ``by``), else test."""
    return first_by_hash(rows, by or [], hash_order(seed, key), [F.floor(F.col("n") * fraction)], ["train", "test"])


def split_stratified(rows: DataFrame, key: str, label: str, shares: tuple[float, float] = (0.8, 0.15), seed: str = "s") -> DataFrame:
    """train / val / test within each label: floors of the shares, the remainder is test."""
    train, val = (F.floor(F.col("n") * share) for share in shares)
    return first_by_hash(rows, [label], hash_order(seed, key), [train, train + val], ["train", "val", "test"])


def split_pairs(rows: DataFrame, name: str, fraction: float, by: list[str]) -> DataFrame:
    """By name within ``by``: train first; with two or more, each side gets one at least."""
    group = W.partitionBy(*by)
    place, n = F.row_number().over(group.orderBy(name)), F.count(F.lit(1)).over(group)
    cut = F.when(n >= 2, F.least(F.greatest(F.floor(n * fraction), F.lit(1)), n - 1)).otherwise(n)
    return rows.withColumn("split", F.when(place <= cut, "train").otherwise("test"))


def sample_frames(rows: DataFrame, spans: DataFrame, n: int, seed: str = "s") -> DataFrame:
    """(video_id, k, t): ``n`` frames of each video from its free ranges, longer ranges as often as they are long.

    The k-th pick is a hash modulo the free frames; the range that holds it is found by an equi-join on the
    ranges' running lengths in steps of a power of two, not by a scan of all ranges for each pick.
    """
    free = free_ranges(rows, spans).withColumn("_len", F.col("t_end") - F.col("t_start") + 1)
    upto = F.sum("_len").over(W.partitionBy("video_id").orderBy("t_start"))
    ranged = free.withColumn("_from", upto - F.col("_len")).withColumn("_to", upto)
    totals = free.groupBy("video_id").agg(F.sum("_len").alias("_total"))
    picks = totals.select("video_id", "_total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    picks = picks.withColumn("_at", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("video_id").cast("string"), F.col("k").cast("string"))), 1, 12), 16, 10).cast("long"), F.col("_total")))
    step = 64
    celled = ranged.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))))
    joined = picks.withColumn("_cell", F.floor(F.col("_at") / step)).join(celled, ["video_id", "_cell"]).where("_at >= _from AND _at < _to")
    return joined.select("video_id", "k", (F.col("t_start") + F.col("_at") - F.col("_from")).alias("t"))


def make_negatives(frames: DataFrame, per_frame: int, wanted: DataFrame, width: int, height: int, margin: int, seed: str = "n") -> DataFrame:
    """(video_id, t, x, y): up to ``per_frame`` distinct centers in each frame, inside the margins, and at most
    ``wanted`` (video_id, n) of them per video, the first by hash."""
    def place(c: str, low: int, size: int) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(seed + c), F.col("video_id").cast("string"), F.col("t").cast("string"), F.col("_k").cast("string")))
        return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(size)) + low

    tries = frames.select("video_id", "t").distinct().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(per_frame - 1))))
    points = tries.withColumn("x", place("x", margin, width - 2 * margin)).withColumn("y", place("y", margin, height - 2 * margin)).select("video_id", "t", "x", "y").distinct()
    order = W.partitionBy("video_id").orderBy(hash_order(seed, "video_id", "t", "x", "y"))
    return points.withColumn("_n", F.row_number().over(order)).join(wanted, "video_id").where("_n <= n").select("video_id", "t", "x", "y")


def weighted_resample(rows: DataFrame, key: str, weight: Column, seed: str = "r") -> DataFrame:
    """Each row as often as its weight says: the whole part, once more where the id's hash is below the fraction."""
    part = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = (F.floor(weight) + F.when(part < weight - F.floor(weight), 1).otherwise(0)).cast("int")
    return rows.withColumn("_times", times).where("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def draw_resample(rows: DataFrame, key: str, label: str, seed: str = "d") -> DataFrame:
    """As many draws with replacement as there are rows, each class as likely as the others: (draw, the row's columns).

    A row's weight is the inverse of its class's size, in whole millionths of the number of rows.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n = rows.count()
    weighed = rows.join(sizes, label).withColumn("_weight", F.expr(f"{n}L * 1000000 div _n"))
    return draws(weighed, "_weight", [key], n, seed).drop("_n", "_weight")


def combine_groups(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Union of groups with their name before each row's own."""
    frames = [df.withColumn("grp", F.lit(g)).withColumn(name, F.concat_ws("__", F.lit(g), F.col(name))) for g, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def leave_one_out(rows: DataFrame, group: str = "grp") -> DataFrame:
    """Rows by ``dataset``: ``global`` and one ``without_<group>`` for each group, of the others. Empty ones do not occur.

    The groups, one row each, are joined to every row: rows times groups is what these datasets hold.
    """
    left = rows.select(F.col(group).alias("_out")).distinct()
    some = rows.join(left, F.col(group) != F.col("_out")).withColumn("dataset", F.concat(F.lit("without_"), "_out")).drop("_out")
    return rows.withColumn("dataset", F.lit("global")).unionByName(some)


def trainable_check(rows: DataFrame, splits: list[str], labels: list[str]) -> DataFrame:
    """(split, label, n, ``ok``) for every cell, also those without a row."""
    cell = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, splits))).alias("split")).withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    counted = cell.join(rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")), ["split", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.withColumn("ok", F.col("n") > 0)


def extract_patches(rows: DataFrame, frames: DataFrame, existing: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """(name, patch) of annotations whose patch does not exist yet, cropped around their centers with zero padding."""
    from ..functions.geometry import gather

    name = F.concat_ws("_", *(F.col(c).cast("string") for c in ("x", "y", "t", "video_id")))
    joined = rows.withColumn("name", name).join(existing, "name", "left_anti").join(frames, ["video_id", "t"])
    x0, y0 = (F.bround(F.col(c) - size / 2.0).cast("int") for c in "xy")
    return joined.select("name", gather(F.col("pixels"), F.lit(width), F.lit(height), x0, y0, size, size, "pad").alias("patch"))


def next_version(names: DataFrame, version: Column) -> DataFrame:
    """One row: the greatest version and the next one's name."""
    return names.agg(F.coalesce(F.max(version), F.lit(0)).alias("latest")).select("latest", F.concat(F.lit("v"), (F.col("latest") + 1).cast("string")).alias("next_name"))


def work_list(catalog: DataFrame, held_out: DataFrame, files: DataFrame, done: DataFrame) -> DataFrame:
    """(path, ``status``) of catalog videos: held_out, missing, done or todo, in this order."""
    flag = lambda df, n: df.select("path").distinct().withColumn(n, F.lit(True))
    joined = catalog.join(flag(held_out, "_h"), "path", "left").join(flag(files, "_f"), "path", "left").join(flag(done, "_d"), "path", "left")
    return joined.select("path", F.when(F.col("_h"), "held_out").when(F.col("_f").isNull(), "missing").when(F.col("_d"), "done").otherwise("todo").alias("status"))
