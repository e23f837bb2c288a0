"""Evaluation metrics: counts by threshold, rollups, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scores import f1, ratio
from .matching import KEYS, greedy_counts, greedy_match, greedy_outcomes
from .ranking import running

THRESHOLDS = tuple(float(n) for n in range(1, 11))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")]


def _per_threshold(thresholds: tuple[float, ...]) -> Column:
    return F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")


def threshold_metrics(gt: DataFrame, preds: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold tp, fp, fn, precision, recall, f1 and the mean match error (null without a match).

    One matching at the largest threshold serves all (see ``greedy_match``); what follows is counting.
    """
    matches = greedy_match(gt, preds, max(thresholds)).select("d2", _per_threshold(thresholds)).where(F.col("d2") <= F.col("threshold") * F.col("threshold"))
    hits = matches.groupBy("threshold").agg(F.count(F.lit(1)).alias("tp"), F.avg(F.sqrt("d2")).alias("mean_err"))
    sizes = gt.select(F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(preds.select(F.lit(0).alias("g"), F.lit(1).alias("p"))).agg(F.coalesce(F.sum("g"), F.lit(0)).alias("n_gt"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"))
    spine = sizes.select("n_gt", "n_pred", _per_threshold(thresholds))
    counted = spine.join(hits, "threshold", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    counted = counted.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))
    return counted.select("threshold", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), "mean_err")


def frame_counts(gt: DataFrame, preds: DataFrame, radius: float) -> DataFrame:
    """Per frame: n_gt, n_pred, tp, fp, fn."""
    return greedy_counts(gt, preds, radius).withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))


def outcomes(gt: DataFrame, preds: DataFrame, radius: float) -> DataFrame:
    """TP, FP and FN rows with both ids and coordinates where they exist."""
    rows = greedy_outcomes(gt, preds, radius)
    return rows.select("outcome", *KEYS, "gt_id", "det_id", "gt_x", "gt_y", "pred_x", "pred_y", F.sqrt("d2").alias("distance"))


def best_threshold(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The row with the greatest f1, then the fewest fp, then the smallest threshold."""
    best = F.max_by(F.struct("threshold", "f1", "fp"), F.struct("f1", -F.col("fp"), -F.col("threshold"))).alias("b")
    return (metrics.groupBy(*keys) if keys else metrics).agg(best).select(*(keys or []), "b.*")


def group_rollup(results: DataFrame) -> DataFrame:
    """Micro-aggregate per group: videos, counts, status ok, partial, error or empty, the sorted error list, the rates."""
    total = results.groupBy("grp").agg(F.count(F.lit(1)).alias("videos_total"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") == "error", F.col("error")))), ";").alias("errors"))
    status = F.when((F.col("n_ok") > 0) & (F.col("n_error") > 0), "partial").when(F.col("n_ok") > 0, "ok").when(F.col("n_error") > 0, "error").otherwise("empty")
    accuracy = ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("accuracy")
    return total.select("grp", "videos_total", "tp", "fp", "fn", "n_ok", "n_error", "errors", status.alias("status"), *prf(F.col("tp"), F.col("fp"), F.col("fn")), accuracy)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: counts of the four cells, and precision, recall, f1."""
    cell = lambda a, b, n: F.count_if((F.col(truth) == a) & (F.col(predicted) == b)).alias(n)
    cells = rows.agg(cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn"))
    return cells.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def score_steps(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, its own positives and negatives ``p`` and ``n``, ``tp`` and ``fp`` at and above it, totals), one row per distinct score.

    Counts per score come first; the running sums go over range partitions and the partitions' totals, so that
    no task sees all scores.
    """
    per = rows.groupBy(F.col(score).alias("score")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    summed = running(per, ["score"], {"p": "tp", "n": "fp"}, descending=True)
    total = per.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))  # one row
    return summed.join(F.broadcast(total))


def pr_curve(steps: DataFrame) -> DataFrame:
    return steps.select("score", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("pos")).alias("recall"))


def roc_curve(steps: DataFrame) -> DataFrame:
    return steps.select("score", ratio(F.col("fp"), F.col("neg")).alias("fpr"), ratio(F.col("tp"), F.col("pos")).alias("tpr"))


def average_precision(steps: DataFrame) -> DataFrame:
    gain = ratio(F.col("p"), F.col("pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return steps.agg(F.sum(gain).alias("average_precision"))


def roc_auc(steps: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids from (0, 0): what each step adds in width, times its mean height."""
    height = (ratio(F.col("tp"), F.col("pos")) + ratio(F.col("tp") - F.col("p"), F.col("pos"))) / 2
    return steps.agg(F.sum(ratio(F.col("n"), F.col("neg")) * height).alias("roc_auc"))


def frame_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("t").alias("n_frames"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def infer_offset(gt: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, t_offset, frame_cap): annotations that start above 0 and end beyond the video are shifted by their start."""
    bounds = gt.groupBy("video_id").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    joined = bounds.join(frames, "video_id")
    offset = F.when((F.col("_lo") > 0) & (F.col("_hi") >= F.col("n_frames")), F.col("_lo")).otherwise(F.lit(0))
    return joined.select("video_id", offset.alias("t_offset"), (F.col("_hi") - offset + 1).alias("frame_cap"))


def distribution(column: str) -> list[Column]:
    """min, p25, p50, mean, p75, max with linear interpolation. (``percentile_approx`` instead, where exactness does not pay.)"""
    at = lambda q: F.percentile(column, q)
    return [F.min(column).alias("min"), at(0.25).alias("p25"), at(0.5).alias("p50"), F.avg(column).alias("mean"), at(0.75).alias("p75"), F.max(column).alias("max")]


#: Size of a quantile sketch.
SKETCH = 800


def sketch_error(k: int = SKETCH) -> float:
    """Rank error of a KLL sketch of size ``k`` that a query exceeds about once in a hundred times, as a part of the rows."""
    return 2.446 / k**0.9433


def sketched_distribution(rows: DataFrame, keys: list[str], column: str, k: int = SKETCH) -> DataFrame:
    """Per key min, p25, p50, p75 and max of a column by mergeable KLL sketches, and ``n``.

    Each task sketches its rows and the sketches are merged, so a key's rows need not meet; ranks are
    within ``sketch_error(k)``. ``distribution`` is the exact form. Nulls do not count.
    """
    value = F.col(column).cast("double")
    sketch = rows.groupBy(*keys).agg(F.expr(f"kll_sketch_agg_double(cast({column} AS double), {k})").alias("_s"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(column).alias("n"))
    at = lambda q, name: F.when(F.col("n") > 0, F.expr(f"kll_sketch_get_quantile_double(_s, {q}D)")).alias(name)
    return sketch.select(*keys, "n", "min", at(0.25, "p25"), at(0.5, "p50"), at(0.75, "p75"), "max")


def per_frame_distribution(rows: DataFrame, spine: DataFrame) -> DataFrame:
    """Distribution of rows per frame over all frames of the spine, empty ones as 0, with and without counts."""
    counts = spine.join(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.groupBy("video_id").agg(*distribution("n"), F.count_if(F.col("n") > 0).alias("with_rows"), F.count_if(F.col("n") == 0).alias("without_rows"))


def class_weights(rows: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """total / count of each class of ``labels``; 0 for one without rows. The total counts rows of these classes."""
    counts = labels.join(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.join(F.broadcast(total)).select(label, "n", F.when(F.col("n") > 0, F.col("_total") / F.col("n")).otherwise(0.0).alias("weight"))


def share_of_total(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.withColumn("share", ratio(F.col(value), F.sum(value).over(W.partitionBy(*keys))))
