"""Queries of sections C and D about detections, ground truth and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import naming, scores
from ..operators import joins, matching, metrics, sets
from .registry import Tables, query

#: Greedy walk over each frame's sorted pairs, step by step, with the used ids as lists.
GREEDY = """RECURSIVE p AS (SELECT g.video_id, g.t, gt_id, det_id, (g.x - d.x) * (g.x - d.x) + (g.y - d.y) * (g.y - d.y) AS d2 FROM {gt} g JOIN {pred} d ON g.video_id = d.video_id AND g.t = d.t),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, t ORDER BY d2, gt_id, det_id) AS k FROM p WHERE d2 <= 100),
    walk AS (SELECT video_id, t, 0::BIGINT AS k, []::BIGINT[] AS ug, []::BIGINT[] AS up, false AS hit FROM (SELECT DISTINCT video_id, t FROM r)
        UNION ALL SELECT r.video_id, r.t, r.k, CASE WHEN f.free THEN list_append(w.ug, r.gt_id) ELSE w.ug END, CASE WHEN f.free THEN list_append(w.up, r.det_id) ELSE w.up END, f.free
        FROM walk w JOIN r ON r.video_id = w.video_id AND r.t = w.t AND r.k = w.k + 1, LATERAL (SELECT NOT list_contains(w.ug, r.gt_id) AND NOT list_contains(w.up, r.det_id) AS free) f),
    m AS (SELECT r.* FROM walk JOIN r USING (video_id, t, k) WHERE hit)"""

METRICS = f"""WITH {GREEDY}, n AS (SELECT (SELECT count(*) FROM {{gt}}) AS n_gt, (SELECT count(*) FROM {{pred}}) AS n_pred),
    c AS (SELECT th::DOUBLE AS threshold, (SELECT count(*) FROM m WHERE d2 <= th * th) AS tp, (SELECT avg(sqrt(d2)) FROM m WHERE d2 <= th * th) AS mean_err FROM range(1, 11) x(th)),
    q AS (SELECT threshold, tp, n_pred - tp AS fp, n_gt - tp AS fn, mean_err, tp / n_pred AS precision, tp / n_gt AS recall FROM c, n)
    SELECT threshold, tp, fp, fn, precision, recall, 2 * precision * recall / (precision + recall) AS f1, mean_err FROM q"""

_FN = "(SELECT g.gt_id, g.video_id, g.t, g.x, g.y FROM {gt} g WHERE g.gt_id % 3 = 0)"
_TP = "(SELECT det_id, video_id, t, x, y FROM {pred} WHERE det_id % 2 = 0)"
_FP = "(SELECT det_id, video_id, t, x, y FROM {pred} WHERE det_id % 2 = 1)"


def _split(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that stand for misses, hits and false alarms."""
    return t.gt.where("gt_id % 3 = 0"), t.pred.where("det_id % 2 = 0"), t.pred.where("det_id % 2 = 1")


@query("threshold_metrics", METRICS)
def threshold_metrics(t: Tables) -> DataFrame:
    return metrics.threshold_metrics(t.gt, t.pred)


@query("greedy_match", f"WITH {GREEDY} SELECT video_id, t, gt_id, det_id, d2 FROM m")
def greedy_match(t: Tables) -> DataFrame:
    return matching.greedy_match(t.gt, t.pred, 10.0)


@query("optimal_match")
def optimal_match(t: Tables) -> DataFrame:
    return matching.optimal_match(t.gt, t.pred, 10.0)


@query("distance_join", "SELECT g.video_id, g.t, gt_id, det_id, (g.x - d.x) * (g.x - d.x) + (g.y - d.y) * (g.y - d.y) AS d2 FROM {gt} g JOIN {pred} d ON g.video_id = d.video_id AND g.t = d.t WHERE (g.x - d.x) * (g.x - d.x) + (g.y - d.y) * (g.y - d.y) <= 36")
def distance_join(t: Tables) -> DataFrame:
    return matching.distance_pairs(t.gt, t.pred, 6.0)


@query("frame_counts", f"""WITH {GREEDY}, k AS (SELECT video_id, t, sum(g) AS n_gt, sum(p) AS n_pred, sum(h) AS tp FROM (SELECT video_id, t, 1 AS g, 0 AS p, 0 AS h FROM {{gt}} UNION ALL SELECT video_id, t, 0, 1, 0 FROM {{pred}} UNION ALL SELECT video_id, t, 0, 0, 1 FROM m) GROUP BY ALL)
    SELECT *, n_pred - tp AS fp, n_gt - tp AS fn FROM k""")
def frame_counts(t: Tables) -> DataFrame:
    return metrics.frame_counts(t.gt, t.pred, 10.0)


@query("outcome_rows", f"""WITH {GREEDY}, g AS (SELECT * FROM {{gt}}), d AS (SELECT * FROM {{pred}})
    SELECT 'tp' AS outcome, m.video_id, m.t, m.gt_id, m.det_id, g.x AS gt_x, g.y AS gt_y, d.x AS pred_x, d.y AS pred_y, sqrt(m.d2) AS distance FROM m JOIN g USING (gt_id) JOIN d USING (det_id)
    UNION ALL SELECT 'fn', video_id, t, gt_id, NULL, x, y, NULL, NULL, NULL FROM g WHERE gt_id NOT IN (SELECT gt_id FROM m)
    UNION ALL SELECT 'fp', video_id, t, NULL, det_id, NULL, NULL, x, y, NULL FROM d WHERE det_id NOT IN (SELECT det_id FROM m)""")
def outcome_rows(t: Tables) -> DataFrame:
    return metrics.outcomes(t.gt, t.pred, 10.0)


@query("best_threshold", f"SELECT threshold, f1, fp FROM ({METRICS}) ORDER BY f1 DESC, fp, threshold LIMIT 1")
def best_threshold(t: Tables) -> DataFrame:
    return metrics.best_threshold(metrics.threshold_metrics(t.gt, t.pred))


@query("accuracy", "SELECT l_returnflag, CASE WHEN sum(l_linenumber + 2 * l_quantity) > 0 THEN sum(l_linenumber) / sum(l_linenumber + 2 * l_quantity) ELSE 0 END AS accuracy FROM lineitem GROUP BY 1")
def accuracy(t: Tables) -> DataFrame:
    """tp / (tp + fp + fn) with counts that stand for outcomes."""
    return t.read("lineitem").groupBy("l_returnflag").agg(scores.ratio(F.sum("l_linenumber"), F.sum(F.col("l_linenumber") + 2 * F.col("l_quantity"))).alias("accuracy"))


@query("rows_x_frames", "SELECT d.det_id, f.t, f.video_id, list_sum(f.pixels)::BIGINT AS mass FROM (SELECT det_id, video_id, t // 2 AS t FROM {det}) d JOIN {frame} f ON f.video_id = d.video_id AND f.t = d.t")
def rows_x_frames(t: Tables) -> DataFrame:
    rows = t.det.select("det_id", "video_id", F.expr("t div 2").alias("t"))
    return joins.rows_to_frames(rows, t.frame).select("det_id", "t", "video_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p).alias("mass"))


_RANGES = "SELECT o_orderkey, (o_orderkey % 6)::BIGINT AS w, 10 AS h, CASE WHEN o_orderkey % 13 = 0 THEN e ELSE s END AS t_start, CASE WHEN o_orderkey % 13 = 0 THEN s ELSE e END AS t_end FROM (SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + o_orderkey % 7 AS e FROM orders)"


@query("range_expand", f"SELECT o_orderkey, w, h, unnest(range(least(t_start, t_end), greatest(t_start, t_end) + 1)) AS t FROM ({_RANGES}) WHERE w > 0 AND h > 0")
def range_expand(t: Tables) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    o = t.read("orders").select("o_orderkey", F.expr("o_orderkey % 6").alias("w"), F.lit(10).alias("h"), day.alias("s"), (day + F.col("o_orderkey") % 7).alias("e"))
    turned = F.col("o_orderkey") % 13 == 0
    return joins.expand_ranges(o.select("o_orderkey", "w", "h", F.when(turned, F.col("e")).otherwise(F.col("s")).alias("t_start"), F.when(turned, F.col("s")).otherwise(F.col("e")).alias("t_end")))


def _nearest_sql(left: str, right: str, lid: str, rid: str) -> str:
    return f"""SELECT video_id, t, {lid}, {rid}, distance FROM (SELECT a.video_id, a.t, a.{lid}, b.bid AS {rid}, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance,
        row_number() OVER (PARTITION BY a.{lid} ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.bid) AS n FROM {left} a LEFT JOIN (SELECT det_id AS bid, video_id, t, x, y FROM {right}) b ON a.video_id = b.video_id AND a.t = b.t) WHERE n = 1"""


@query("nearest_fn_tp", _nearest_sql(_FN, _TP, "gt_id", "det_id"))
def nearest_fn_tp(t: Tables) -> DataFrame:
    fn, tp, _ = _split(t)
    return matching.nearest(fn, tp, "gt_id", "det_id")


@query("nearest_fp_tp", _nearest_sql(_FP, _TP, "det_id", "tp_id"))
def nearest_fp_tp(t: Tables) -> DataFrame:
    _, tp, fp = _split(t)
    return matching.nearest(fp, tp.withColumnRenamed("det_id", "tp_id"), "det_id", "tp_id")


@query("nearest_fn_pred", _nearest_sql(_FN, "{pred}", "gt_id", "det_id"))
def nearest_fn_pred(t: Tables) -> DataFrame:
    fn, tp, fp = _split(t)
    return matching.nearest(fn, tp.unionByName(fp), "gt_id", "det_id")


_KEEP = "(SELECT DISTINCT video_id, t, round_even(x, 0)::BIGINT AS kx, round_even(y, 0)::BIGINT AS ky FROM {det} WHERE weight > 40)"


@query("logits_sync_semi", f"SELECT det_id FROM {{det}} d WHERE EXISTS (SELECT 1 FROM {_KEEP} k WHERE k.video_id = d.video_id AND k.t = d.t AND kx = round_even(d.x, 0) AND ky = round_even(d.y, 0))")
def logits_sync_semi(t: Tables) -> DataFrame:
    return joins.sync_keys(t.det, t.det.where("weight > 40")).select("det_id")


@query("logits_sync_anti", f"SELECT det_id FROM {{det}} d WHERE NOT EXISTS (SELECT 1 FROM {_KEEP} k WHERE k.video_id = d.video_id AND k.t = d.t AND kx = round_even(d.x, 0) AND ky = round_even(d.y, 0))")
def logits_sync_anti(t: Tables) -> DataFrame:
    return joins.sync_keys(t.det, t.det.where("weight > 40"), keep=False).select("det_id")


@query("logits_rebuild", "SELECT video_id, t, round_even(x / 8, 0)::BIGINT AS x, round_even(y / 8, 0)::BIGINT AS y, arg_max(weight, det_id) AS weight, arg_max(confidence, det_id) AS confidence FROM {det} WHERE lower(trim(class)) = 'positive' GROUP BY ALL")
def logits_rebuild(t: Tables) -> DataFrame:
    coarse = t.det.withColumn("x", F.col("x") / 8).withColumn("y", F.col("y") / 8)
    return joins.rebuild_slim(coarse, "det_id", ["weight", "confidence"])


@query("summary_enrich", f"SELECT a.gt_id, a.t, a.x, a.y, n.det_id, n.distance FROM {_FN} a LEFT JOIN ({_nearest_sql(_FN, _TP, 'gt_id', 'det_id')}) n ON a.gt_id = n.gt_id")
def summary_enrich(t: Tables) -> DataFrame:
    fn, tp, _ = _split(t)
    near = matching.nearest(fn, tp, "gt_id", "det_id").select("gt_id", "det_id", "distance").dropDuplicates(["gt_id"])
    return fn.select("gt_id", "t", "x", "y").join(near, "gt_id", "left")


_AUDIT = "(SELECT det_id, video_id, t, x, y, (det_id % 4)::INT AS stage_order, 'stage_' || (det_id % 4) AS stage FROM {det} WHERE det_id % 7 < 3)"


@query("stage_audit", f"SELECT stage_order, stage, count(*) AS n, min(t) AS t_min, max(t) AS t_max FROM {_AUDIT} GROUP BY ALL")
def stage_audit(t: Tables) -> DataFrame:
    """Snapshot rows by pipeline stage."""
    return _audit(t).groupBy("stage_order", "stage").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def _audit(t: Tables) -> DataFrame:
    return t.det.where("det_id % 7 < 3").select("det_id", "video_id", "t", "x", "y", F.expr("cast(det_id % 4 AS int)").alias("stage_order"), F.expr("concat('stage_', det_id % 4)").alias("stage"))


@query("miss_backtrace", f"SELECT f.gt_id, coalesce(arg_min(a.stage, a.stage_order), 'UNK') AS stage FROM {_FN} f LEFT JOIN {_AUDIT} a ON f.video_id = a.video_id AND f.t = a.t AND (f.x - a.x) * (f.x - a.x) + (f.y - a.y) * (f.y - a.y) <= 9 GROUP BY f.gt_id")
def miss_backtrace(t: Tables) -> DataFrame:
    return joins.earliest_culprit(_split(t)[0], _audit(t), 3.0)


@query("crop_index", "SELECT b.event_id, b.x, b.y, b.t, c.path FROM {named} b JOIN (SELECT t, x, y, w, h, arg_max(path, value * 100000000 + event_id) AS path FROM (SELECT *, 'f_' || lpad(event_id::VARCHAR, 9, '0') || '.png' AS path FROM {named}) GROUP BY ALL) c USING (t, x, y, w, h)")
def crop_index(t: Tables) -> DataFrame:
    keys = ["t", "x", "y", "w", "h"]
    crops = t.named.withColumn("path", F.expr("concat('f_', lpad(cast(event_id AS string), 9, '0'), '.png')"))
    return t.named.join(joins.best_crop(crops, keys, "value", "path"), keys).select("event_id", "x", "y", "t", "path")


@query("box_overlap", "SELECT g.video_id, g.t, gt_id, det_id FROM {gt} g JOIN {pred} d ON g.video_id = d.video_id AND g.t = d.t AND g.x < d.x + d.w AND d.x < g.x + g.w AND g.y < d.y + d.h AND d.y < g.y + g.h")
def box_overlap(t: Tables) -> DataFrame:
    return joins.box_overlaps(t.gt, t.pred, 12.0)


@query("frame_stats", "SELECT video_id, count(*) AS n_rows, count(DISTINCT t) AS n_frames, min(t) AS t_min, max(t) AS t_max FROM {gt} GROUP BY 1")
def frame_stats(t: Tables) -> DataFrame:
    return metrics.frame_stats(t.gt, ["video_id"])




def _bounded(t: Tables) -> DataFrame:
    frames = t.spark.range(4).select(F.col("id").alias("video_id"), F.when(F.col("id") % 2 == 0, 500).otherwise(900).alias("n_frames"))
    return metrics.infer_offset(t.gt.withColumn("t", F.col("t") + 3), frames)


@query("infer_offset", "SELECT video_id, CASE WHEN lo > 0 AND hi >= CASE WHEN video_id % 2 = 0 THEN 500 ELSE 900 END THEN lo ELSE 0 END AS t_offset FROM (SELECT video_id, min(t) + 3 AS lo, max(t) + 3 AS hi FROM {gt} GROUP BY 1)")
def infer_offset(t: Tables) -> DataFrame:
    return _bounded(t).select("video_id", "t_offset")


@query("infer_frame_cap", "SELECT video_id, hi - CASE WHEN lo > 0 AND hi >= CASE WHEN video_id % 2 = 0 THEN 500 ELSE 900 END THEN lo ELSE 0 END + 1 AS frame_cap FROM (SELECT video_id, min(t) + 3 AS lo, max(t) + 3 AS hi FROM {gt} GROUP BY 1)")
def infer_frame_cap(t: Tables) -> DataFrame:
    return _bounded(t).select("video_id", "frame_cap")


_DIST = "min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, avg({c}) AS mean, quantile_cont({c}, 0.75) AS p75, max({c}) AS max"


@query("score_summary", "SELECT video_id, " + _DIST.replace("{c}", "confidence") + " FROM {det} GROUP BY 1")
def score_summary(t: Tables) -> DataFrame:
    return t.det.groupBy("video_id").agg(*metrics.distribution("confidence"))


@query("per_frame_distribution", "SELECT video_id, " + _DIST.replace("{c}", "n") + ", count_if(n > 0) AS with_rows, count_if(n = 0) AS without_rows FROM (SELECT s.video_id, s.t, count(d.det_id) AS n FROM (SELECT v AS video_id, unnest(range(0, greatest(720, (SELECT coalesce(max(t), 0) + 1 FROM {det})))) AS t FROM range(0, 4) a(v) UNION SELECT video_id, t FROM {det}) s LEFT JOIN {pred} d ON d.video_id = s.video_id AND d.t = s.t GROUP BY ALL) GROUP BY 1")
def per_frame_distribution(t: Tables) -> DataFrame:
    """Positives of every frame of the four videos, up to the month's end or the last row behind it; a frame without positives, or without any row, counts as zero."""
    last = t.det.agg(F.greatest(F.lit(719), F.coalesce(F.max("t"), F.lit(0))).alias("_last"))  # one row
    spine = t.spark.range(4).join(F.broadcast(last)).select(F.col("id").alias("video_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias("t"))
    return metrics.per_frame_distribution(t.pred, spine.union(t.det.select("video_id", "t")).distinct())


@query("sketched_summary", "SELECT video_id, count(*) AS n, true AS within FROM {det} GROUP BY 1")
def sketched_summary(t: Tables) -> DataFrame:
    """The quartiles that a sketch gives have, in the whole column, a rank within the sketch's error."""
    found = metrics.sketched_distribution(t.det, ["video_id"], "confidence")
    ranked = t.det.join(found, "video_id").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), *(F.avg((F.col("confidence") < F.col(c)).cast("double")).alias(f"{c}_low") for c in ("p25", "p50", "p75")), *(F.avg((F.col("confidence") <= F.col(c)).cast("double")).alias(f"{c}_high") for c in ("p25", "p50", "p75")))
    error = metrics.sketch_error()
    within = [(F.col(f"{c}_low") <= q + error) & (F.col(f"{c}_high") >= q - error) for c, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    return ranked.select("video_id", "n", (within[0] & within[1] & within[2]).alias("within"))


@query("frame_union", "SELECT video_id, t FROM {gt} UNION SELECT video_id, t FROM {pred}")
def frame_union(t: Tables) -> DataFrame:
    return t.gt.select(*matching.KEYS).union(t.pred.select(*matching.KEYS)).distinct()


@query("recompose", f"SELECT 'gt' AS side, gt_id AS id, x, y FROM {{gt}} UNION ALL SELECT 'pred', det_id, x, y FROM {{pred}}")
def recompose(t: Tables) -> DataFrame:
    """Ground truth is hits and misses, predictions are hits and false alarms."""
    o = metrics.outcomes(t.gt, t.pred, 10.0)
    # Both sides of a row at once, so that frames are matched once.
    side = lambda name, key, p: F.struct(F.lit(name).alias("side"), F.col(key).alias("id"), F.col(f"{p}_x").alias("x"), F.col(f"{p}_y").alias("y"))
    sides = F.array(F.when(F.col("outcome") != "fp", side("gt", "gt_id", "gt")), F.when(F.col("outcome") != "fn", side("pred", "det_id", "pred")))
    return o.select(F.explode(F.array_compact(sides)).alias("s")).select("s.*")


_SCORED = "(SELECT doc_id, quality AS label, ((doc_id * 7919) % 97 + quality * 30) / 127.0::DOUBLE AS score FROM labels WHERE quality IS NOT NULL)"
_STEPS = f"(SELECT score, sum(sum(label)) OVER w AS tp, sum(sum(1 - label)) OVER w AS fp, sum(sum(label)) OVER () AS pos, sum(sum(1 - label)) OVER () AS neg FROM {_SCORED} GROUP BY score WINDOW w AS (ORDER BY score DESC))"


def _steps(t: Tables) -> DataFrame:
    score = F.expr("((doc_id * 7919) % 97 + quality * 30) / 127.0D")
    return metrics.score_steps(t.read("labels").where("quality IS NOT NULL").select(F.col("quality").alias("label"), score.alias("score")))


@query("pr_curve", f"SELECT score, tp / (tp + fp) AS precision, tp / pos AS recall FROM {_STEPS}")
def pr_curve(t: Tables) -> DataFrame:
    return metrics.pr_curve(_steps(t))


@query("roc_curve", f"SELECT score, fp / neg AS fpr, tp / pos AS tpr FROM {_STEPS}")
def roc_curve(t: Tables) -> DataFrame:
    return metrics.roc_curve(_steps(t))


@query("average_precision", f"SELECT sum((recall - before) * precision) AS average_precision FROM (SELECT tp / (tp + fp) AS precision, tp / pos AS recall, coalesce(lag(tp / pos) OVER (ORDER BY score DESC), 0) AS before FROM {_STEPS})")
def average_precision(t: Tables) -> DataFrame:
    return metrics.average_precision(_steps(t))


@query("roc_auc", f"SELECT sum((x - x0) * (y + y0) / 2) AS roc_auc FROM (SELECT fp / neg AS x, tp / pos AS y, coalesce(lag(fp / neg) OVER w, 0) AS x0, coalesce(lag(tp / pos) OVER w, 0) AS y0 FROM {_STEPS} WINDOW w AS (ORDER BY score DESC))")
def roc_auc(t: Tables) -> DataFrame:
    return metrics.roc_auc(_steps(t))


@query("confusion", f"SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT count_if(label = 1 AND score >= 0.5) AS tp, count_if(label = 0 AND score >= 0.5) AS fp, count_if(label = 1 AND score < 0.5) AS fn, count_if(label = 0 AND score < 0.5) AS tn FROM {_SCORED})")
def confusion(t: Tables) -> DataFrame:
    rows = t.read("labels").where("quality IS NOT NULL").select(F.col("quality").alias("label"), F.expr("cast(((doc_id * 7919) % 97 + quality * 30) / 127.0D >= 0.5D AS int)").alias("p"))
    return metrics.confusion(rows, "label", "p")


@query("ordered_export", "SELECT t, x, y, w, h, row_number() OVER (ORDER BY t, x, y, w, h, det_id) AS position FROM {det}")
def ordered_export(t: Tables) -> DataFrame:
    """Rows in the stable order (t, x, y, w, h). Range partitioning and sorting within; positions add up the partitions' sizes."""
    from ..operators.ranking import positions

    return positions(t.det, ["t", "x", "y", "w", "h", "det_id"]).select("t", "x", "y", "w", "h", "position")


@query("top_frames", "SELECT video_id, t, count(*) AS n FROM {pred} GROUP BY ALL ORDER BY n DESC, t, video_id LIMIT 5")
def top_frames(t: Tables) -> DataFrame:
    """The five frames with the most positives; frames without any do not count."""
    return t.pred.groupBy("video_id", "t").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t", "video_id").limit(5)


@query("first_n", "SELECT page_id, path FROM {video} ORDER BY path, page_id LIMIT 20")
def first_n(t: Tables) -> DataFrame:
    return t.video.select("page_id", "path").orderBy("path", "page_id").limit(20)


@query("failure_preview", "SELECT video, event_id FROM (SELECT video, event_id, row_number() OVER (PARTITION BY video ORDER BY event_id) AS n FROM {named} WHERE w = 0) WHERE n <= 3")
def failure_preview(t: Tables) -> DataFrame:
    from ..operators.ranking import first_per_group

    return first_per_group(t.named.where("w = 0"), ["video"], ["event_id"], 3).select("video", "event_id")


@query("dedupe_exact", "SELECT min(event_id) AS event_id, x, y, w, h, t FROM {named} GROUP BY x, y, w, h, t")
def dedupe_exact(t: Tables) -> DataFrame:
    return sets.dedupe_exact(t.named, ["x", "y", "w", "h", "t"], "event_id").select("event_id", "x", "y", "w", "h", "t")


@query("keyed_append", "SELECT src, event_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY src, event_id) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS src, event_id, x, y FROM {named})) WHERE n = 1")
def keyed_append(t: Tables) -> DataFrame:
    old = t.named.where("event_id % 3 = 0").select(F.lit(0).alias("src"), "event_id", "x", "y")
    new = t.named.where("event_id % 3 <> 0").select(F.lit(1).alias("src"), "event_id", "x", "y")
    return sets.keyed_append(old, new, ["x", "y"], ["event_id"])


@query("merge_lists", "SELECT DISTINCT path, route, grp FROM {video}")
def merge_lists(t: Tables) -> DataFrame:
    rows = t.video.select("path", "route", "grp")
    return rows.where("route = 'day'").unionByName(rows).dropDuplicates(["path", "route", "grp"])


@query("source_overlap", "SELECT count(*) AS n_overlap FROM (SELECT x, y, w, h FROM {named} WHERE event_id % 2 = 0 INTERSECT SELECT x, y, w, h FROM {named} WHERE event_id % 3 = 0)")
def source_overlap(t: Tables) -> DataFrame:
    rows = t.named.select("event_id", "x", "y", "w", "h")
    a, b = (rows.where(f"event_id % {n} = 0").drop("event_id") for n in (2, 3))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n_overlap"))


_SNAP = "(SELECT doc_id, source || '/' || doc_id AS path, n_chars + CASE WHEN doc_id % 17 = 0 THEN {d} ELSE 0 END AS size, doc_id * 10 + CASE WHEN doc_id % 19 = 0 THEN {d} ELSE 0 END AS mtime_ns, CASE WHEN doc_id % 5 > 0 THEN sha256(text || CASE WHEN doc_id % 23 = 0 THEN '{d}' ELSE '' END) END AS sha256 FROM documents WHERE doc_id % 3 <> {x})"


def _snapshot(t: Tables, d: int, without: int) -> DataFrame:
    docs = t.read("documents").where(F.col("doc_id") % 3 != without)
    bump = lambda n: F.when(F.col("doc_id") % n == 0, d).otherwise(0)
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), (F.col("n_chars") + bump(17)).alias("size"), (F.col("doc_id") * 10 + bump(19)).alias("mtime_ns"), F.when(F.col("doc_id") % 5 > 0, naming.content_hash(F.concat("text", F.when(F.col("doc_id") % 23 == 0, F.lit(str(d))).otherwise(F.lit(""))))).alias("sha256"))


@query("snapshot_diff", f"""SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM {_SNAP.replace('{d}', '0').replace('{x}', '2')} b FULL JOIN {_SNAP.replace('{d}', '1').replace('{x}', '0')} a ON a.path = b.path
    WHERE b.path IS NULL OR a.path IS NULL OR a.size <> b.size OR CASE WHEN a.sha256 IS NOT NULL AND b.sha256 IS NOT NULL THEN a.sha256 <> b.sha256 ELSE a.mtime_ns <> b.mtime_ns END""")
def snapshot_diff(t: Tables) -> DataFrame:
    return sets.snapshot_diff(_snapshot(t, 0, 2), _snapshot(t, 1, 0))
