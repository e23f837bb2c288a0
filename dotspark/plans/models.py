"""Queries of sections K and L: detectors, scorers, and the flows that users start."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry, scores
from ..operators import datasets, dedupe, detectors, flows, metrics
from ..sources.scratch import materialise, shared_dir
from .components import _REGIONS, _comp
from .matches import GREEDY
from .registry import SIDE, Tables, query


@query("detect_threshold", "WITH " + _REGIONS.replace("{op}", ">") + " SELECT video_id, t, x, y, w, h FROM (SELECT video_id, t, min(i % 8) AS x, min(i // 8) AS y, max(i % 8) - min(i % 8) + 1 AS w, max(i // 8) - min(i // 8) + 1 AS h FROM lab GROUP BY video_id, t, root) WHERE w * h BETWEEN 2 AND 32")
def detect_threshold(t: Tables) -> DataFrame:
    return detectors.detect(t.frame, "threshold", width=SIDE, level=150, min_area=2, max_scale=0.5, unknown=1).select("video_id", "t", "x", "y", "w", "h")


@query("detect_log")
def detect_log(t: Tables) -> DataFrame:
    return detectors.detect(t.frame, "log", width=SIDE)


#: Boxes of the regions of 8 by 8 frames ``fr`` above a level: centers weigh by value, the confidence is the greatest value in the box.
_BOXES = """, b AS (SELECT video_id, t, min(i % 8) AS x, min(i // 8) AS y, max(i % 8) - min(i % 8) + 1 AS w, max(i // 8) - min(i // 8) + 1 AS h, sum(v * (i % 8)) / sum(v)::DOUBLE AS cx, sum(v * (i // 8)) / sum(v)::DOUBLE AS cy FROM lab GROUP BY video_id, t, root)
    SELECT b.*, list_max(list_transform(list_filter(range(0, 64), lambda i: i % 8 BETWEEN b.x AND b.x + b.w - 1 AND i // 8 BETWEEN b.y AND b.y + b.h - 1), lambda i: fr.pixels[i + 1])) / 255::DOUBLE AS confidence FROM b JOIN fr ON fr.video_id = b.video_id AND fr.t = b.t"""
_MOVING = _REGIONS.replace("RECURSIVE ", "").replace("{op} 150", "> 40").replace("{frame}", "fr") + _BOXES


@query("detect_rolling", """WITH RECURSIVE v AS (SELECT video_id, t, r.i::INT AS i, pixels[r.i + 1] AS p FROM {frame}, range(0, 64) r(i)),
    m AS (SELECT *, avg(p) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY video_id, i ORDER BY t)),
    fr AS (SELECT video_id, t, list(greatest(0, floor(p - mean))::INT ORDER BY i) AS pixels FROM m WHERE k > 5 GROUP BY ALL), """ + _MOVING)
def detect_rolling(t: Tables) -> DataFrame:
    return detectors.detect(t.frame, "rolling", width=SIDE)


@query("detect_ewma", """WITH RECURSIVE f AS (SELECT video_id, t, pixels, row_number() OVER (PARTITION BY video_id ORDER BY t) AS k FROM {frame}),
    s AS (SELECT video_id, t, k, pixels, list_transform(pixels, lambda p: p::DOUBLE) AS state, NULL::DOUBLE[] AS mean FROM f WHERE k = 1
        UNION ALL SELECT f.video_id, f.t, f.k, f.pixels, list_transform(list_zip(s.state, f.pixels), lambda z: (1 - 0.2::DOUBLE) * z[1] + 0.2::DOUBLE * z[2]), s.state FROM s JOIN f ON f.video_id = s.video_id AND f.k = s.k + 1),
    fr AS (SELECT video_id, t, list_transform(list_zip(pixels, mean), lambda z: greatest(0, floor(z[1] - z[2]))::INT) AS pixels FROM s WHERE k > 1), """ + _MOVING)
def detect_ewma(t: Tables) -> DataFrame:
    return detectors.detect(t.frame, "ewma", width=SIDE)


@query("detect_frames")
def detect_frames(t: Tables) -> DataFrame:
    """All registered detectors on the same frames, by name."""
    found = [detectors.detect(t.frame, name, width=SIDE, level=60).withColumn("detector", F.lit(name)) for name in sorted(detectors.DETECTORS)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("score_patches", "SELECT t, list_avg(pixels) / 255 AS score FROM {frame}")
def score_patches(t: Tables) -> DataFrame:
    return detectors.score_patches(t.frame, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, v: a + v) / F.size(p) / 255).select("t", "score")


@query("redetect")
def redetect(t: Tables) -> DataFrame:
    first = detectors.detect(t.frame, "threshold", width=SIDE, level=190)
    return detectors.redetect(t.frame, first, SIDE, 2, 2.0, "threshold", materialise, level=150)


@query("patch_model")
def patch_model(t: Tables) -> DataFrame:
    rows = t.frame.select("t", F.col("pixels").alias("features"), (F.col("video_id") % 2).cast("int").alias("label"))
    split = datasets.split_stratified(rows, "t", "label")
    classes = t.spark.range(2).select(F.col("id").cast("int").alias("label"))
    return detectors.patch_model(split, "label", metrics.class_weights(rows, "label", classes))


# --- L: flows -----------------------------------------------------------------------------------------------

#: Frames of four videos in order, and points scaled to them.
_FR = "(SELECT t % 4 AS video_id, t // 4 AS t, pixels FROM {frame})"
_GT8 = "(SELECT gt_id, video_id, t, round_even(x / 8, 0) AS x, round_even(y / 8, 0) AS y FROM {gt} WHERE t < 200)"
_PRED8 = "(SELECT det_id, video_id, t, x / 8 AS x, y / 8 AS y FROM {pred} WHERE coalesce(lower(trim(class)), 'positive') = 'positive' AND t < 200)"


def _frames(t: Tables) -> DataFrame:
    return t.frame.select((F.col("t") % 4).cast("int").alias("video_id"), F.expr("t div 4").alias("t"), "pixels")


def _gt8(t: Tables) -> DataFrame:
    return t.gt.select("gt_id", "video_id", "t", F.bround(F.col("x") / 8).alias("x"), F.bround(F.col("y") / 8).alias("y"))


def _pred8(t: Tables) -> DataFrame:
    return t.pred.select("det_id", "video_id", "t", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"), "class")


_KEPT = f"""cr AS (SELECT *, list_transform(range(0, 16), lambda i: pixels[(y0 + i // 4) * 8 + x0 + i % 4 + 1]) AS crop FROM (
        SELECT g.*, pixels, greatest(0, least(round_even(g.x - 2.0, 0)::INT, 4)) AS x0, greatest(0, least(round_even(g.y - 2.0, 0)::INT, 4)) AS y0 FROM {_GT8} g JOIN {_FR} f ON f.video_id = g.video_id AND f.t = g.t)),
    px AS (SELECT gt_id, r.i::INT AS i FROM cr, range(0, 16) r(i) WHERE crop[r.i + 1] > 120),
    reach AS (SELECT gt_id, i AS a, i AS b FROM px UNION SELECT r.gt_id, r.a, n.i FROM reach r JOIN px n ON n.gt_id = r.gt_id AND abs(n.i // 4 - r.b // 4) <= 1 AND abs(n.i % 4 - r.b % 4) <= 1),
    area AS (SELECT gt_id, max(n) AS n FROM (SELECT gt_id, root, count(*) AS n FROM (SELECT gt_id, a, min(b) AS root FROM reach GROUP BY ALL) GROUP BY ALL) GROUP BY 1),
    kept AS (SELECT cr.gt_id, video_id, t, x, y, list_sum(crop)::BIGINT AS weight FROM cr JOIN area USING (gt_id) WHERE list_max(crop) >= 180 AND n >= 4),
    near AS (SELECT a.gt_id AS a, b.gt_id AS b FROM kept a JOIN kept b ON a.video_id = b.video_id AND a.t = b.t AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1),
    chain AS (SELECT gt_id AS a, gt_id AS b FROM kept UNION SELECT c.a, n.b FROM chain c JOIN near n ON c.b = n.a),
    once AS (SELECT gt_id, video_id, t, x, y FROM (SELECT k.*, row_number() OVER (PARTITION BY root ORDER BY weight DESC, gt_id) AS n FROM kept k JOIN (SELECT a AS gt_id, min(b) AS root FROM chain GROUP BY 1) USING (gt_id)) WHERE n = 1),
    shown AS (SELECT * FROM {_PRED8}),
    pairs AS (SELECT *, row_number() OVER (PARTITION BY video_id, t ORDER BY d2, gt_id, det_id) AS k FROM (SELECT g.video_id, g.t, gt_id, det_id, (g.x - d.x) * (g.x - d.x) + (g.y - d.y) * (g.y - d.y) AS d2 FROM once g JOIN shown d ON g.video_id = d.video_id AND g.t = d.t) WHERE d2 <= 9),
    walk AS (SELECT video_id, t, 0::BIGINT AS k, []::BIGINT[] AS ug, []::BIGINT[] AS up, false AS hit FROM (SELECT DISTINCT video_id, t FROM pairs)
        UNION ALL SELECT r.video_id, r.t, r.k, CASE WHEN f.free THEN list_append(w.ug, r.gt_id) ELSE w.ug END, CASE WHEN f.free THEN list_append(w.up, r.det_id) ELSE w.up END, f.free
        FROM walk w JOIN pairs r ON r.video_id = w.video_id AND r.t = w.t AND r.k = w.k + 1, LATERAL (SELECT NOT list_contains(w.ug, r.gt_id) AND NOT list_contains(w.up, r.det_id) AS free) f),
    m AS (SELECT pairs.* FROM walk JOIN pairs USING (video_id, t, k) WHERE hit)"""


def _evaluated(t: Tables, max_frames: int | None) -> flows.Evaluation:
    return flows.Evaluation(_gt8(t), _pred8(t), _frames(t), SIDE, SIDE, size=4, bright=180, floor=120, area=4, max_frames=max_frames, dedupe_radius=1.0, thresholds=(1.0, 2.0, 3.0))


#: The same without a frame cap.
_ALL = _KEPT.replace(" AND t < 200", "").replace(" WHERE t < 200", "")


@query("gt_filter", f"WITH RECURSIVE {_ALL} SELECT g.video_id, count(*) AS n_total, count(k.gt_id) AS n_kept FROM cr g LEFT JOIN kept k USING (gt_id) GROUP BY 1")
def gt_filter(t: Tables) -> DataFrame:
    """Ground truth whose crop is bright and has a region of four pixels: totals within the video and what is kept."""
    tested = flows.filter_gt(_gt8(t), _frames(t), SIDE, SIDE, 4, 180, 120, 4)
    return tested.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_total"), F.count_if("kept").alias("n_kept"))


@query("flow_evaluate", f"""WITH RECURSIVE {_KEPT}, c AS (SELECT th::DOUBLE AS threshold, (SELECT count(*) FROM m WHERE d2 <= th * th) AS tp, (SELECT avg(sqrt(d2)) FROM m WHERE d2 <= th * th) AS mean_err FROM range(1, 4) x(th)),
    q AS (SELECT threshold, tp, (SELECT count(*) FROM shown) - tp AS fp, (SELECT count(*) FROM once) - tp AS fn, mean_err FROM c),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM q),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)
    SELECT *, threshold = (SELECT threshold FROM f ORDER BY f1 DESC, fp, threshold LIMIT 1) AS best, (SELECT count(*) FROM {_GT8}) AS gt_total, (SELECT count(*) FROM kept) AS gt_kept, (SELECT count(*) FROM once) AS gt_final FROM f""")
def flow_evaluate(t: Tables) -> DataFrame:
    """Ground truth shifted, filtered by its crops and deduped, predictions filtered, metrics per threshold, the best one marked."""
    return _evaluated(t, 200).metrics()


@query("flow_evaluate_rows", f"""WITH RECURSIVE {_ALL}, o AS (SELECT 'tp' AS outcome, video_id, t, gt_id, det_id FROM m UNION ALL SELECT 'fn', video_id, t, gt_id, NULL FROM once WHERE gt_id NOT IN (SELECT gt_id FROM m) UNION ALL SELECT 'fp', video_id, t, NULL, det_id FROM shown WHERE det_id NOT IN (SELECT det_id FROM m)),
    n AS (SELECT 'fn' AS outcome, g.gt_id AS id, d.det_id AS near_id, (g.x - d.x) * (g.x - d.x) + (g.y - d.y) * (g.y - d.y) AS d2 FROM once g JOIN shown d ON d.video_id = g.video_id AND d.t = g.t
        UNION ALL SELECT 'fp', g.det_id, d.det_id, (g.x - d.x) * (g.x - d.x) + (g.y - d.y) * (g.y - d.y) FROM shown g JOIN shown d ON d.video_id = g.video_id AND d.t = g.t WHERE d.det_id IN (SELECT det_id FROM m)),
    b AS (SELECT outcome, id, near_id, sqrt(d2) AS near_distance FROM (SELECT *, row_number() OVER (PARTITION BY outcome, id ORDER BY d2, near_id) AS k FROM n) WHERE k = 1)
    SELECT o.outcome, o.video_id, o.t, o.gt_id, o.det_id, b.near_id, b.near_distance FROM o LEFT JOIN b ON b.outcome = o.outcome AND b.id = CASE o.outcome WHEN 'fn' THEN o.gt_id ELSE o.det_id END""")
def flow_evaluate_rows(t: Tables) -> DataFrame:
    """The outcome rows of the evaluation with the nearest rows of their frame."""
    return _evaluated(t, None).rows().select("outcome", "video_id", "t", "gt_id", "det_id", "near_id", "near_distance")


@query("flow_refine")
def flow_refine(t: Tables) -> DataFrame:
    return flows.refine(t.frame, SIDE, SIDE)


@query("flow_ranges")
def flow_ranges(t: Tables) -> DataFrame:
    """Range detections to frames, patches, tracks by intensity curve, refined centers exported as x, y, t."""
    rows = t.det.select("video_id", F.expr("det_id % 5").alias("obj_id"), "det_id", "w", "h", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"), F.col("t").alias("t_start"), (F.col("t") + F.col("det_id") % 3).alias("t_end"))
    return flows.track_ranges(rows, _frames(t), SIDE, SIDE, bright=150)


@query("flow_prepare", "SELECT d.det_id, coalesce(CASE WHEN d.det_id % 2 = 0 THEN d.x + 0.5 END, d.x + d.w / 2.0) AS x, coalesce(CASE WHEN d.det_id % 2 = 0 THEN d.y + 0.5 END, d.y + d.h / 2.0) AS y, ln(least(greatest(d.confidence, 1e-8), 1 - 1e-8)) AS pos_log, ln(least(greatest(1 - d.confidence, 1e-8), 1 - 1e-8)) AS neg_log FROM {det} d")
def flow_prepare(t: Tables) -> DataFrame:
    """Refined points where there are any, else patch centers, with log probabilities."""
    refined = t.det.where("det_id % 2 = 0").select("det_id", (F.col("x") + 0.5).alias("rx"), (F.col("y") + 0.5).alias("ry"))
    rows = t.det.join(refined, "det_id", "left")
    return rows.select("det_id", F.coalesce("rx", F.col("x") + F.col("w") / 2.0).alias("x"), F.coalesce("ry", F.col("y") + F.col("h") / 2.0).alias("y"), scores.log_prob(F.col("confidence")).alias("pos_log"), scores.log_prob(1 - F.col("confidence")).alias("neg_log"))


_MODELS = {"global": "true", "without_0": "det_id % 5 > 0", "video_1_only": "video_id = 1"}


def _report(t: Tables) -> tuple[DataFrame, DataFrame]:
    gt = t.gt.withColumn("grp", F.concat(F.lit("g"), (F.col("video_id") % 3).cast("string")))
    base = t.pred.groupBy("video_id").agg(F.count(F.lit(1)).alias("tp"), F.min("det_id").alias("fp"), F.max("t").alias("fn")).where("video_id <> 2")
    return flows.group_report(gt, {k: t.pred.where(w) for k, w in _MODELS.items()}, base, 10.0)


_REPORT = GREEDY.split("m AS (")[0].replace("{gt}", "{every_gt}").replace("{pred}", "{every_pred}") + """m AS (SELECT r.* FROM walk JOIN r USING (video_id, t, k) WHERE hit),
    e AS (SELECT i AS model_no, v AS video_id FROM range(0, 3) a(i), range(0, 4) b(v)),
    n AS (SELECT e.*, ['global', 'without_0', 'video_1_only'][model_no + 1] AS model, 'g' || video_id % 3 AS grp, (SELECT count(*) FROM {gt} g WHERE g.video_id = e.video_id) AS n_gt,
        (SELECT count(*) FROM {pred} d WHERE d.video_id = e.video_id AND (model_no = 0 OR model_no = 1 AND det_id % 5 > 0 OR model_no = 2 AND video_id = 1)) AS n_pred, (SELECT count(*) FROM m WHERE m.video_id = e.video_id * 3 + model_no) AS hits FROM e),
    c AS (SELECT model, grp, video_id, CASE WHEN n_pred = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n_pred > 0 THEN hits END AS tp, CASE WHEN n_pred > 0 THEN n_pred - hits END AS fp, CASE WHEN n_pred > 0 THEN n_gt - hits END AS fn FROM n)"""
_EVERY = {"{every_gt}": "(SELECT gt_id, video_id * 3 + i AS video_id, t, x, y FROM {gt}, range(0, 3) a(i))", "{every_pred}": "(SELECT det_id, video_id * 3 + i AS video_id, t, x, y FROM {pred}, range(0, 3) a(i) WHERE i = 0 OR i = 1 AND det_id % 5 > 0 OR i = 2 AND video_id = 1)"}
for _name, _sql in _EVERY.items():
    _REPORT = _REPORT.replace(_name, _sql)


@query("flow_group_report", f"""WITH {_REPORT} SELECT model || '/' || grp AS grp, count(*) AS videos_total, coalesce(sum(tp), 0) AS tp, coalesce(sum(fp), 0) AS fp, coalesce(sum(fn), 0) AS fn, count_if(status = 'ok') AS n_ok, count_if(status = 'error') AS n_error,
    CASE WHEN count_if(status = 'error') > 0 THEN 'no predictions' ELSE '' END AS errors, CASE WHEN count_if(status = 'ok') = 0 THEN 'error' WHEN count_if(status = 'error') > 0 THEN 'partial' ELSE 'ok' END AS status,
    coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0) AS precision, coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0) AS recall, coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0) AS f1, coalesce(sum(tp) / nullif(sum(tp + fp + fn), 0), 0) AS accuracy FROM c GROUP BY model, grp""")
def flow_group_report(t: Tables) -> DataFrame:
    """Evaluation of several models over all videos in one job, rolled up by model and group."""
    return _report(t)[1]


@query("flow_report_rows", f"""WITH {_REPORT}, b AS (SELECT video_id, count(*) AS base_tp, min(det_id) AS base_fp, max(t) AS base_fn FROM {{pred}} WHERE video_id <> 2 GROUP BY 1)
    SELECT model, video_id, grp, status, tp, fp, fn, base_tp, base_fp, base_fn FROM c LEFT JOIN b USING (video_id)""")
def flow_report_rows(t: Tables) -> DataFrame:
    """The rows of the report: each model on each video, with the baseline's counts."""
    return _report(t)[0].select("model", "video_id", "grp", "status", "tp", "fp", "fn", "base_tp", "base_fp", "base_fn")


_ANN = "(SELECT event_id, video || CASE event_id % 3 WHEN 0 THEN '' ELSE '_positive' END AS name, video, (event_id % 4)::INT AS video_id, t // 4 AS t, x % 8 AS x, y % 8 AS y, w, h FROM {named})"
_OLD = "(SELECT DISTINCT ON (name) name, split, class FROM (SELECT x % 8 || '_' || y % 8 || '_' || t // 4 || '_' || event_id % 4 AS name, 'train' AS split, 'positive' AS class FROM {named} WHERE event_id % 6 = 0))"


_INGESTED = f"""WITH f AS (SELECT DISTINCT video_id, t FROM {_FR}), o AS (SELECT * FROM {_OLD}),
    a AS (SELECT * FROM {_ANN} WHERE w > 0 AND h > 0 AND video <> 'clip0_b0' AND video IN (SELECT video FROM {{named}} WHERE event_id % 7 > 1)),
    p AS (SELECT DISTINCT x || '_' || y || '_' || a.t || '_' || a.video_id AS name FROM a JOIN f ON f.video_id = a.video_id AND f.t = a.t),
    k AS (SELECT f.*, r.k FROM f ANTI JOIN a ON a.video_id = f.video_id AND a.t = f.t, range(0, 3) r(k)),
    n AS (SELECT DISTINCT video_id, t, ('0x' || substr(md5('nx:' || video_id || ':' || t || ':' || k), 1, 12))::BIGINT % 4 + 2 AS x, ('0x' || substr(md5('ny:' || video_id || ':' || t || ':' || k), 1, 12))::BIGINT % 4 + 2 AS y FROM k),
    c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5('n:' || video_id || ':' || t || ':' || x || ':' || y)) AS i FROM n),
    g AS (SELECT DISTINCT x || '_' || y || '_' || t || '_' || c.video_id AS name FROM c JOIN (SELECT video_id, count(*) * 2 AS m FROM a GROUP BY 1) w ON w.video_id = c.video_id AND i <= m),
    s AS (SELECT name, 'positive' AS class, row_number() OVER (ORDER BY md5('s:' || name)) AS i, (SELECT count(*) FROM p) AS m FROM p UNION ALL SELECT name, 'negative', row_number() OVER (ORDER BY md5('s:' || name)), (SELECT count(*) FROM g WHERE name NOT IN (SELECT name FROM p)) FROM g WHERE name NOT IN (SELECT name FROM p))"""


@query("flow_ingest", _INGESTED + """ SELECT split, class, count(*) AS n FROM (SELECT split, class FROM o UNION ALL SELECT CASE WHEN i <= floor(m * 0.8::DOUBLE) THEN 'train' ELSE 'test' END, class FROM s WHERE name NOT IN (SELECT name FROM o)) GROUP BY ALL""")
def flow_ingest(t: Tables) -> DataFrame:
    """Annotations paired with videos, done ones skipped, patches cut, negatives made, split and appended; then counts by split and class."""
    return _index(t)[1].groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"))


@query("flow_ingest_log", _INGESTED + """ SELECT version, actor, n_rows, n_positive, count(*) AS logged FROM (SELECT 1 AS version, 'seed' AS actor, count(*) AS n_rows, count(*) AS n_positive FROM o
    UNION ALL SELECT 2, 'ingestor', count(*), count_if(class = 'positive') FROM (SELECT class FROM o UNION ALL SELECT class FROM s WHERE name NOT IN (SELECT name FROM o))) GROUP BY ALL""")
def flow_ingest_log(t: Tables) -> DataFrame:
    """The index kept as a table in versions, and a change log with a line for each: the log's lines with what their version holds."""
    root = f"{shared_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    old, new = _index(t)
    flows.record_index(old, root, "seed", "2025-01-01T00:00:00")
    flows.record_index(new, root, "ingestor", "2025-01-02T00:00:00")
    log = t.spark.read.format("linelog").load(f"{root}/log").select(F.from_json("value", "version int, timestamp string, meta struct<actor: string>").alias("r")).select("r.version", "r.meta.actor")
    held = None
    for n in (1, 2):
        part = t.spark.read.format("versioned").option("version", n).load(f"{root}/index").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("class") == "positive").alias("n_positive")).withColumn("version", F.lit(n))
        held = part if held is None else held.unionByName(part)
    return log.join(held, "version").groupBy("version", "actor", "n_rows", "n_positive").agg(F.count(F.lit(1)).alias("logged"))


def _index(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The index before and after an ingest."""
    n = t.named
    ann = n.select("event_id", F.expr("concat(video, CASE event_id % 3 WHEN 0 THEN '' ELSE '_positive' END)").alias("name"), F.expr("cast(event_id % 4 AS int)").alias("video_id"), F.expr("t div 4").alias("t"), F.expr("x % 8").alias("x"), F.expr("y % 8").alias("y"), "w", "h")
    stems = n.where("event_id % 7 > 1").select(F.col("video").alias("stem"))
    old = n.where("event_id % 6 = 0").select(F.expr("concat_ws('_', x % 8, y % 8, t div 4, event_id % 4)").alias("name"), F.lit("train").alias("split"), F.lit("positive").alias("class")).distinct()
    return old, flows.ingest(ann, stems, t.spark.sql("SELECT 'clip0_b0' AS stem"), _frames(t), old, SIDE, SIDE)


_LABELS = "(SELECT 's' || det_id % 700 AS stem, CASE WHEN det_id % 97 = 0 THEN '0 0.5' WHEN w > 0 AND h > 0 THEN printf('0 %.10f %.10f %.10f %.10f', (x + w / 2.0) / 50.0::DOUBLE, (y + h / 2.0) / 30.0::DOUBLE, w / 50.0::DOUBLE, h / 30.0::DOUBLE) ELSE '' END AS line FROM (SELECT det_id, greatest(x - 4, 0) AS x, greatest(y - 3, 0) AS y, least(x - 4 + w, 50) - greatest(x - 4, 0) AS w, least(y - 3 + h, 30) - greatest(y - 3, 0) AS h FROM {det}))"


_PLANNED = f"""WITH l AS (SELECT stem, string_agg(line, chr(10) ORDER BY line) AS text, count_if(line = '0 0.5') AS issues FROM {_LABELS} GROUP BY 1),
    p AS (SELECT l.*, CASE WHEN substr(stem, 2)::INT % 9 > 0 THEN 'd/' || stem || '.png' END AS image FROM l), g AS (SELECT stem, sha2_ AS hash FROM (SELECT stem, sha256(image || '|' || text) AS sha2_ FROM p WHERE image IS NOT NULL AND issues = 0)),
    e AS (SELECT stem, CASE WHEN substr(stem, 2)::INT % 2 = 0 THEN hash ELSE 'other' END AS held FROM g WHERE substr(stem, 2)::INT % 5 = 0)"""


@query("flow_labels", _PLANNED + """ SELECT (SELECT count(*) FROM p) AS label_files_found, (SELECT count(*) FROM p WHERE image IS NULL) AS missing_images, (SELECT count(*) FROM p WHERE issues > 0) AS bad_files,
    (SELECT count(*) FROM g LEFT JOIN e USING (stem) WHERE held IS DISTINCT FROM hash) AS pairs_to_copy, (SELECT count(*) FROM g JOIN e USING (stem) WHERE held = hash) AS skipped_existing, (SELECT count(*) FROM g JOIN e USING (stem) WHERE held <> hash) AS renamed""")
def flow_labels(t: Tables) -> DataFrame:
    """Label files of the boxes, paired with images and checked, then planned against what is there: the counts of the manifest."""
    return _labels_ingested(t)[1]


@query("flow_label_plan", _PLANNED + " SELECT 'labels/' || stem AS path, stem, CASE WHEN held IS NULL THEN 'copy' WHEN held = hash THEN 'skip' ELSE 'rename' END AS action, CASE WHEN held IS NULL THEN stem WHEN held <> hash THEN stem || '__src_web' END AS target FROM g LEFT JOIN e USING (stem)")
def flow_label_plan(t: Tables) -> DataFrame:
    """The plan itself: what is done with each label file, and under which name."""
    return _labels_ingested(t)[0].select("path", "stem", "action", "target")


def _labels_ingested(t: Tables) -> tuple[DataFrame, DataFrame]:
    box = geometry.box_to_norm(F.col("x") - 4, F.col("y") - 3, F.col("w"), F.col("h"), F.lit(50), F.lit(30))
    line = F.when(F.col("det_id") % 97 == 0, "0 0.5").otherwise(F.coalesce(F.concat(F.lit("0 "), box), F.lit("")))
    lines = t.det.select(F.expr("concat('s', det_id % 700)").alias("stem"), line.alias("line"))
    number = F.substring("stem", 2, 9).cast("int")
    images = lines.select("stem").distinct().where(number % 9 > 0).select("stem", F.concat(F.lit("d/"), "stem", F.lit(".png")).alias("path"))
    files = lines.groupBy("stem").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text")).join(images, "stem")
    held = files.where(number % 5 == 0).select("stem", F.when(number % 2 == 0, F.sha2(F.concat_ws("|", "path", "text"), 256)).otherwise(F.lit("other")).alias("hash"))
    return flows.ingest_labels(lines, images, held, "web")


@query("flow_corrections", f"""WITH {_comp("(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, t, x, y, w, h ORDER BY det_id % 2, det_id) AS o FROM {det}) WHERE o = 1)", 9)}
    SELECT det_id, video_id, t, x, y FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY weight DESC, det_id) AS n FROM c) WHERE n = 1""")
def flow_corrections(t: Tables) -> DataFrame:
    rows = t.det.select("det_id", "video_id", "t", "x", "y", "w", "h", "weight", (F.col("det_id") % 2).alias("source_rank"))
    return dedupe.merge_corrections(rows, 3.0, ["x", "y", "w", "h"])[0].select("det_id", "video_id", "t", "x", "y")
