"""Whole flows over detections, ground truth, frames and catalogs, as chains of the other operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry, pixels, scores
from ..sources import tables, versions
from ..sources.scratch import materialise
from . import datasets, dedupe, detectors, filters, joins, matching, metrics, regions, sets, tracks
from .matching import KEYS


def with_crop(rows: DataFrame, frames: DataFrame, width: int, height: int, size: int, name: str = "crop") -> DataFrame:
    """Rows (keys, x, y as centers) with the ``size`` by ``size`` crop of their frame around them, moved inside it, and its
    corner ``_x0``, ``_y0``. Rows beyond the video vanish."""
    w, h = min(size, width), min(size, height)
    box = geometry.crop_box(F.col("x"), F.col("y"), F.lit(w), F.lit(h), F.lit(width), F.lit(height))
    placed = rows.withColumn("_x0", box.x).withColumn("_y0", box.y)
    columns = [c for c in placed.columns if c not in KEYS]
    # All crops of a frame are cut where its pixels are.
    cut = F.transform("_points", lambda p: F.struct(*(p[c].alias(c) for c in columns), geometry.gather(F.col("pixels"), F.lit(width), F.lit(height), p["_x0"], p["_y0"], w, h, "pad").alias(name)))
    return regions.points_of_frames(placed, frames, columns).select(*KEYS, F.inline(cut))


def filter_gt(gt: DataFrame, frames: DataFrame, width: int, height: int, size: int, bright: int, floor: int, area: int) -> DataFrame:
    """Ground truth within the video with ``weight`` (its crop's sum) and ``kept``: the crop has a pixel of ``bright`` or
    more, and an 8-connected region of ``area`` pixels strictly above ``floor``."""
    cropped = with_crop(gt, frames, width, height, size)
    good = pixels.bright_enough(F.col("crop"), bright) & (regions.largest_in("crop", min(size, width), floor) >= area)
    return cropped.withColumn("weight", pixels.crop_weight(F.col("crop"))).withColumn("kept", good).drop("crop", "_x0", "_y0")


class Evaluation:
    """Evaluation against ground truth: shift, filter by crop, dedupe, match over thresholds.

    The sides are made once, when this is; ``metrics`` and ``rows`` match them.
    """

    def __init__(self, gt: DataFrame, preds: DataFrame, frames: DataFrame, width: int, height: int, *, size: int = 10, bright: int = 50, floor: int = 50, area: int = 4, offset: int = 0, max_frames: int | None = None, dedupe_radius: float = 2.0, thresholds: tuple[float, ...] = metrics.THRESHOLDS) -> None:
        self.thresholds = thresholds
        self.shifted = filters.shift_time(gt, offset, max_frames).select(*KEYS, "gt_id", "x", "y")
        self.tested = materialise(filter_gt(self.shifted, frames, width, height, size, bright, floor, area), "evaluate-gt")
        once = dedupe.keep_heaviest(self.tested.where("kept").withColumnRenamed("gt_id", "det_id"), dedupe_radius).withColumnRenamed("det_id", "gt_id")
        self.once = materialise(once, "evaluate-once")
        shown = filters.positive_only(preds)
        self.shown = shown if max_frames is None else shown.where(F.col("t") < max_frames)

    def metrics(self) -> DataFrame:
        """Per threshold with ``best``, and how much ground truth there was (``gt_total``), passed the filter
        (``gt_kept``) and was left after deduplication (``gt_final``)."""
        found = metrics.threshold_metrics(self.once, self.shown, self.thresholds)
        best = metrics.best_threshold(found).select(F.col("threshold").alias("_best"))
        count = lambda df, c, name: df.agg(c.alias(name))
        totals = count(self.shifted, F.count(F.lit(1)), "gt_total").join(count(self.tested, F.count_if("kept"), "gt_kept")).join(count(self.once, F.count(F.lit(1)), "gt_final"))  # one row
        return found.join(F.broadcast(best.join(totals))).withColumn("best", F.col("threshold") == F.col("_best")).drop("_best")

    def rows(self) -> DataFrame:
        """Hits, misses and false alarms at the largest threshold; misses with the nearest prediction of their frame,
        false alarms with the nearest hit."""
        rows = materialise(metrics.outcomes(self.once, self.shown, max(self.thresholds)), "evaluate-rows")
        miss = rows.where("outcome = 'fn'").select(*KEYS, "gt_id", F.col("gt_x").alias("x"), F.col("gt_y").alias("y"))
        alarm = rows.where("outcome = 'fp'").select(*KEYS, "det_id", F.col("pred_x").alias("x"), F.col("pred_y").alias("y"))
        hit = rows.where("outcome = 'tp'").select(*KEYS, F.col("det_id").alias("near_id"), F.col("pred_x").alias("x"), F.col("pred_y").alias("y"))
        shown = self.shown.select(*KEYS, F.col("det_id").alias("near_id"), "x", "y")
        near = matching.nearest(miss, shown, "gt_id", "near_id").select(F.lit("fn").alias("outcome"), F.col("gt_id").alias("id"), "near_id", F.col("distance").alias("near_distance"))
        near = near.unionByName(matching.nearest(alarm, hit, "det_id", "near_id").select(F.lit("fp").alias("outcome"), F.col("det_id").alias("id"), "near_id", F.col("distance").alias("near_distance")))
        named = rows.withColumn("id", F.when(F.col("outcome") == "fn", F.col("gt_id")).otherwise(F.col("det_id")))
        return named.join(near, ["outcome", "id"], "left").drop("id")


def bright_scorer(crop: Column) -> Column:
    """A scorer that stands where no model is given: the two-class confidence of the brightest pixel."""
    return scores.softmax_conf(F.lit(0.0), F.array_max(crop) / 64.0 - 2.0)


def refine(frames: DataFrame, width: int, height: int, *, level: int = 150, bright: int = 180, floor: int = 150, area: int = 2, radius: float = 2.0, size: int = 3, sigma: float = 2.0, rounds: int = 1, again_level: int = 120, grow: int = 190, min_side: int = 3, scorer: Callable[[Column], Column] = bright_scorer) -> DataFrame:
    """Detection refinement: (keys, x, y, weight), one row per key and rounded place.

    Detect; recenter by the crop's centroid if it is bright; gate by area; classify by ``scorer``, a function of the
    crop's column to a confidence (see ``detectors.in_batches`` for models); keep the heaviest of near ones; refine the center in a fixed patch; gate by a bright region. Then ``rounds`` of blacking out what
    is known and detecting again; regions grown from the detections replace those near them where they are
    large; the region gate again; rebuild the slim table.
    """

    def gated(rows: DataFrame) -> DataFrame:
        return with_crop(rows, frames, width, height, size).where(regions.largest_in("crop", size, floor) >= area).drop("crop", "_x0", "_y0")

    def refined(boxes: DataFrame) -> DataFrame:
        points = filters.area_filter(boxes, area).select(*KEYS, F.xxhash64(*KEYS, "x", "y", "w", "h").alias("det_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
        seen = with_crop(points, frames, width, height, size).where(pixels.bright_enough(F.col("crop"), bright)).withColumn("confidence", scorer(F.col("crop")))
        # The crop that is scored is the one whose centroid a kept row moves to: it is cut once.
        heavy = filters.classify(seen, 0.5, drop_negatives=True).withColumn("weight", pixels.crop_weight(F.col("crop"))).withColumn("c", pixels.centroid(F.col("crop"), size, size, sigma))
        kept = dedupe.keep_heaviest(heavy.select(*KEYS, "det_id", "x", "y", "weight", (F.col("_x0") + F.col("c.cx")).alias("_cx"), (F.col("_y0") + F.col("c.cy")).alias("_cy")), radius)
        return gated(kept.withColumn("x", F.col("_cx")).withColumn("y", F.col("_cy")).drop("_cx", "_cy"))

    boxes = materialise(detectors.detect(frames, "threshold", width=width, level=level), "refine-boxes")
    if rounds:
        boxes = detectors.redetect(frames, boxes, width, rounds, radius, "threshold", materialise, level=again_level)
    rows = materialise(refined(boxes).select(*KEYS, "det_id", "x", "y", "weight"), "refine-rows")
    seeds = rows.withColumn("sx", F.least(F.greatest(F.bround("x").cast("int"), F.lit(0)), F.lit(width - 1))).withColumn("sy", F.least(F.greatest(F.bround("y").cast("int"), F.lit(0)), F.lit(height - 1)))
    grown = regions.grow_region(seeds, frames, width, grow, keep=["det_id", "weight"])
    square = geometry.min_square(F.col("x") + (F.col("w") - 1) / 2.0, F.col("y") + (F.col("h") - 1) / 2.0, F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    large = grown.where("area > 0").withColumn("side", square["side"]).where(F.col("side") >= min_side)
    candidates = large.select(*KEYS, (-F.col("det_id") - 1).alias("det_id"), (F.col("x") + (F.col("w") - 1) / 2.0).alias("x"), (F.col("y") + (F.col("h") - 1) / 2.0).alias("y"), (F.col("weight") * F.col("area")).alias("weight"))
    replaced = dedupe.replace_regions(rows, candidates, radius)
    return joins.rebuild_slim(gated(replaced), "det_id", ["weight"])


def track_ranges(ranges: DataFrame, frames: DataFrame, width: int, height: int, *, size: int = 4, bright: int = 0, max_gap: int = 3, radius: float = 8.0, min_points: int = 3, min_range: float = 20.0, **hill: float) -> DataFrame:
    """Range detections to tracks: (track_id, x, y, t) of the rows of selected tracks.

    Ranges (keys without t, ``t_start``, ``t_end``, x, y, w, h, obj_id) spread over their frames; each row moves to the
    brightest pixel around it, is scored by its patch's sum and dropped below ``bright``; rows link to tracks;
    tracks are selected by length, intensity range and hill shape (``hill``: options of ``tracks.hill_shape``); centers
    are refined in the patch.
    """
    spread = joins.expand_ranges(ranges).withColumn("det_id", F.xxhash64("video_id", "obj_id", "det_id", "t"))
    snapped = with_crop(spread, frames, width, height, size).withColumn("b", pixels.brightest_pixel(F.col("crop"), size))
    moved = snapped.where(F.col("b.value") >= bright).select(*KEYS, "obj_id", "det_id", (F.col("_x0") + F.col("b.px")).cast("double").alias("x"), (F.col("_y0") + F.col("b.py")).cast("double").alias("y"))
    patched = with_crop(moved, frames, width, height, size)
    scored = patched.withColumn("weight", pixels.crop_weight(F.col("crop")).cast("double")).withColumn("c", pixels.centroid(F.col("crop"), size, size, 1.5))
    # Linking reads its rows more than once, and so does the choice of tracks: each is made once.
    scored = materialise(scored.drop("crop", "b"), "ranges-scored")
    linked = materialise(tracks.link_tracks(scored, max_gap, radius), "ranges-linked")
    chosen = tracks.select_tracks(linked, "weight", min_points, min_range, **hill).where("selected")
    return chosen.select("track_id", (F.col("_x0") + F.col("c.cx")).alias("x"), (F.col("_y0") + F.col("c.cy")).alias("y"), "t")


def group_report(gt: DataFrame, models: dict[str, DataFrame], baselines: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Evaluation of several models over all videos in one job: rows by (model, video), and groups.

    ``gt`` has ``grp``. Rows: counts, a status (``error`` where a model has no row for a video at all) and the
    baseline's counts of the video (``baselines``: video_id, tp, fp, fn) as ``base_*``. Groups: micro-aggregates
    by model and group.
    """
    names = list(models)
    # The model goes into the video key, as text before it, so that one matching serves all of them.
    kind = gt.schema["video_id"].dataType
    key = lambda df, k: df.withColumn("video_id", F.concat(F.lit(f"{k}:"), F.col("video_id").cast("string")))
    truth, shown = None, None
    for k, name in enumerate(names):
        g, p = key(gt, k).select(*KEYS, "gt_id", "x", "y"), key(models[name], k).select(*KEYS, "det_id", "x", "y")
        truth, shown = (g, p) if truth is None else (truth.unionByName(g), shown.unionByName(p))
    counts = metrics.frame_counts(truth, shown, radius).groupBy("video_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.sum("n_pred").alias("n_pred"))
    model = F.element_at(F.array(*[F.lit(m) for m in names]), F.split_part("video_id", F.lit(":"), F.lit(1)).cast("int") + 1)
    none = F.col("n_pred") == 0
    rows = counts.select(model.alias("model"), F.regexp_replace("video_id", "^[0-9]+:", "").cast(kind).alias("video_id"), F.when(none, "error").otherwise("ok").alias("status"), F.when(none, "no predictions").alias("error"), *(F.when(~none, F.col(c)).alias(c) for c in ("tp", "fp", "fn")))
    videos = gt.select("video_id", "grp").distinct()
    base = baselines.select("video_id", *(F.col(c).alias(f"base_{c}") for c in ("tp", "fp", "fn")))
    full = rows.join(videos, "video_id").join(base, "video_id", "left")
    return full, metrics.group_rollup(full.withColumn("grp", F.concat_ws("/", "model", "grp")))


def ingest(annotations: DataFrame, stems: DataFrame, done: DataFrame, frames: DataFrame, existing: DataFrame, width: int, height: int, *, size: int = 4, fraction: float = 0.8, ratio: int = 2, per_frame: int = 3) -> DataFrame:
    """Dataset ingest: the data set's index (name, split, class) after the new patches are appended to ``existing``.

    Annotations (name, keys, x, y, w, h, id) are paired with video stems by prefix and those of videos already done
    left out; valid ones get patches, and so do ``ratio`` negatives to each positive, at most ``per_frame`` in a frame;
    each is split by hash. A name that exists keeps its row.
    """
    paired = annotations.join(joins.prefix_pair(annotations, stems), "name").where("stem IS NOT NULL")
    todo = filters.valid_annotations(joins.pending(paired, done, ["stem"]))
    none = existing.select("name").limit(0)
    cut = lambda rows: datasets.extract_patches(rows.select(*KEYS, "x", "y"), frames, none, width, height, size).select("name").distinct()
    positives = materialise(cut(todo), "ingest-positives")
    wanted = todo.groupBy("video_id").agg((F.count(F.lit(1)) * ratio).alias("n"))
    margin = min(size // 2, (min(width, height) - 1) // 2)
    negatives = materialise(cut(datasets.make_negatives(frames.select(*KEYS).join(todo.select(*KEYS).distinct(), KEYS, "left_anti"), per_frame, wanted, width, height, margin)).join(positives, "name", "left_anti"), "ingest-negatives")
    split = lambda rows, label: datasets.split_annotations(rows, "name", fraction).select("name", "split", F.lit(label).alias("class"))
    fresh = split(positives, "positive").unionByName(split(negatives, "negative"))
    return sets.keyed_append(existing, fresh, ["name"], ["class"])


def record_index(index: DataFrame, root: str, actor: str, timestamp: str) -> int:
    """Put a data set's index in place as the next version below ``root`` and append a line to its change log; the version.

    Who begins from the same version and commits later fails, and then logs nothing.
    """
    spark = index.sparkSession
    versions.register(spark)
    index.write.format("versioned").mode("overwrite").save(f"{root}/index")
    found = versions.current(f"{root}/index")
    line = F.to_json(F.struct(F.lit(found["version"]).alias("version"), F.lit(timestamp).alias("timestamp"), F.struct(F.lit(actor).alias("actor"), F.lit(False).alias("dry_run")).alias("meta"), F.lit(False).alias("had_error")))
    spark.range(1).select(line.alias("value")).write.format("linelog").mode("append").save(f"{root}/log")
    return found["version"]


def ingest_labels(lines: DataFrame, images: DataFrame, existing: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Label ingest: the copy plan (path, stem, action, target) and one row of counts.

    ``lines`` (stem, line) make a label file per stem; files with a bad line and those without an image are
    left out and counted; the others meet ``existing`` (stem, hash of label text and image path).
    """
    checked = tables.label_issues(lines)
    files = checked.groupBy("stem").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"), F.count("issue").alias("issues"))
    paired = files.join(joins.best_image(images).withColumnRenamed("path", "image"), "stem", "left")
    good = paired.where("image IS NOT NULL AND issues = 0").select(F.concat_ws("/", F.lit("labels"), "stem").alias("path"), "stem", F.sha2(F.concat_ws("|", "image", "text"), 256).alias("hash"))
    plan = joins.collision_plan(good, existing, source)
    count = lambda c, n: F.count_if(c).alias(n)
    report = paired.agg(F.count(F.lit(1)).alias("label_files_found"), count(F.col("image").isNull(), "missing_images"), count(F.col("issues") > 0, "bad_files"))
    done = plan.agg(count(F.col("action") != "skip", "pairs_to_copy"), count(F.col("action") == "skip", "skipped_existing"), count(F.col("action") == "rename", "renamed"))
    return plan, report.join(done)  # one row each
