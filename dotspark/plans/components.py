"""Queries on component dedupe, tracks, sequences, stacks and pixel regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import dedupe, regions, sequences, stacking, tracks
from .registry import SIDE, Tables, query

#: Components by label propagation along same-frame neighbours (distinct steps, so that it ends).
_COMP = """RECURSIVE v AS (SELECT det_id, video_id, t, x, y, weight, {extra} FROM {{from}}),
    e AS (SELECT a.det_id AS a, b.det_id AS b FROM v a JOIN v b ON a.video_id = b.video_id AND a.t = b.t AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r2}),
    reach AS (SELECT det_id AS a, det_id AS b FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
    c AS (SELECT v.*, k.component FROM v JOIN (SELECT a AS det_id, min(b) AS component FROM reach GROUP BY 1) k USING (det_id))"""


def _comp(source: str, r2: float, extra: str = "0 AS kind") -> str:
    return _COMP.replace("{extra}", extra).replace("{r2}", str(r2)).replace("{{from}}", source)


@query("dedupe_heaviest", f"WITH {_comp('{det}', 36)} SELECT det_id, video_id, t, x, y, weight FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY weight DESC, det_id) AS n FROM c) WHERE n = 1")
def dedupe_heaviest(t: Tables) -> DataFrame:
    return dedupe.keep_heaviest(t.det.select("det_id", "video_id", "t", "x", "y", "weight"), 6.0)


@query("region_replace", f"WITH {_comp('{det}', 25, 'CASE WHEN det_id % 11 = 0 THEN 1 ELSE 0 END AS kind')} SELECT det_id, kind FROM (SELECT *, max(kind) OVER (PARTITION BY component) AS any_, row_number() OVER (PARTITION BY component ORDER BY kind DESC, weight DESC, det_id) AS n FROM c) WHERE any_ = 0 OR n = 1")
def region_replace(t: Tables) -> DataFrame:
    rows = t.det.select("det_id", "video_id", "t", "x", "y", "weight")
    out = dedupe.replace_regions(rows.where("det_id % 11 <> 0"), rows.where("det_id % 11 = 0"), 5.0)
    return out.select("det_id", F.when(F.col("kind") == "candidate", 1).otherwise(0).alias("kind"))


_TWICE = "(SELECT *, 0 AS rank FROM {det} UNION ALL SELECT det_id + 100000000, video_id, t, x, y, w, h, weight + 1, confidence, event_type, xy_semantics, class, 1 AS rank FROM {det} WHERE det_id % 4 = 0)"


def _twice(t: Tables) -> DataFrame:
    """Annotations, and a second source that repeats a quarter of them."""
    rows = t.det.select("det_id", "video_id", "t", "x", "y", "w", "h", "weight")
    again = rows.where("det_id % 4 = 0").withColumn("det_id", F.col("det_id") + 100000000).withColumn("weight", F.col("weight") + 1)
    return rows.withColumn("source_rank", F.lit(0)).unionByName(again.withColumn("source_rank", F.lit(1)))


@query("merge_corrections", f"""WITH {_comp("(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, t, x, y, w, h ORDER BY rank, det_id) AS o FROM " + _TWICE + ") WHERE o = 1)", 9, 'rank AS kind')},
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY weight DESC, det_id) AS n FROM c) WHERE n = 1)
    SELECT a.rank AS source_rank, a.n_rows, a.n_rows - coalesce(o.n, 0) AS exact_removed, coalesce(o.n, 0) - coalesce(k.n, 0) AS near_removed, coalesce(k.n, 0) AS n_kept FROM (SELECT rank, count(*) AS n_rows FROM {_TWICE} GROUP BY 1) a
    LEFT JOIN (SELECT kind, count(*) AS n FROM v GROUP BY 1) o ON o.kind = a.rank LEFT JOIN (SELECT kind, count(*) AS n FROM k GROUP BY 1) k ON k.kind = a.rank""")
def merge_corrections(t: Tables) -> DataFrame:
    return dedupe.merge_corrections(_twice(t), 3.0, ["x", "y", "w", "h"])[1]


@query("proximity_merge", """WITH RECURSIVE n AS (SELECT det_id, video_id, t, x, y FROM {det} d WHERE det_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM {det} b WHERE b.det_id % 3 = 0 AND b.video_id = d.video_id AND b.t = d.t AND (b.x - d.x) * (b.x - d.x) + (b.y - d.y) * (b.y - d.y) <= 16)),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, t ORDER BY det_id) AS k FROM n),
    w AS (SELECT video_id, t, 0::BIGINT AS k, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept, -1::BIGINT AS det_id, false AS ok FROM (SELECT DISTINCT video_id, t FROM r)
        UNION ALL SELECT r.video_id, r.t, r.k, CASE WHEN f.ok THEN list_append(w.kept, {'x': r.x, 'y': r.y}) ELSE w.kept END, r.det_id, f.ok FROM w JOIN r ON r.video_id = w.video_id AND r.t = w.t AND r.k = w.k + 1,
        LATERAL (SELECT len(list_filter(w.kept, lambda q: (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) <= 16)) = 0 AS ok) f)
    SELECT det_id FROM w WHERE ok""")
def proximity_merge(t: Tables) -> DataFrame:
    rows = t.det.select("det_id", "video_id", "t", "x", "y")
    return dedupe.proximity_merge(rows.where("det_id % 3 = 0"), rows.where("det_id % 3 > 0"), 4.0).select("det_id")


def _objects(t: Tables) -> DataFrame:
    """Detections with an object key; tracks drift, as ids do not tell time."""
    return t.det.select("video_id", F.expr("det_id % 5").alias("obj_id"), "t", "det_id", F.expr("x / 4").alias("x"), F.expr("y / 4").alias("y"), F.col("weight"))


#: Linking step by step, within runs of an object's rows that no longer gap cuts: pairs of one row with earlier ones that cost the
#: same are a step, in order of frame, cost and row; it takes the oldest of their tracks that was not continued yet.
LINKED = """WITH RECURSIVE e AS (SELECT det_id, video_id * 5 + det_id % 5 AS obj, t, x / 4 AS x, y / 4 AS y, coalesce(t - lag(t) OVER (PARTITION BY video_id, det_id % 5 ORDER BY t, det_id) > 3, false) AS cut FROM {det}),
    o AS (SELECT *, count_if(cut) OVER (PARTITION BY obj ORDER BY t, det_id) AS run FROM e),
    c AS (SELECT p.obj, p.run, p.t, p.det_id AS p, d.det_id AS d, p.t - d.t AS gap, sqrt((p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y)) AS far FROM o p JOIN o d ON p.obj = d.obj AND p.run = d.run AND p.t - d.t BETWEEN 1 AND 3),
    g AS (SELECT obj, run, p, list(d) AS ds, row_number() OVER (PARTITION BY obj, run ORDER BY t, far + 0.5::DOUBLE * gap, p) AS k FROM c WHERE far <= 8 * gap GROUP BY obj, run, t, p, far + 0.5::DOUBLE * gap),
    walk AS (SELECT DISTINCT obj, run, 0::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[] AS ps, []::BIGINT[] AS names FROM o
        UNION ALL SELECT w.obj, w.run, g.k, CASE WHEN b.hit THEN list_append(used, b.best.d) ELSE used END, CASE WHEN b.hit THEN list_append(ps, g.p) ELSE ps END, CASE WHEN b.hit THEN list_append(names, b.best.name) ELSE names END
        FROM walk w JOIN g ON g.obj = w.obj AND g.run = w.run AND g.k = w.k + 1, LATERAL (SELECT f.best, f.best IS NOT NULL AND NOT list_contains(w.ps, g.p) AS hit FROM
            (SELECT list_min(list_transform(list_filter(g.ds, lambda d: NOT list_contains(w.used, d)), lambda d: {'name': coalesce(w.names[list_position(w.ps, d)], d), 'd': d})) AS best) f) b),
    l AS (SELECT unnest(ps) AS det_id, unnest(names) AS name FROM (SELECT ps, names, row_number() OVER (PARTITION BY obj, run ORDER BY k DESC) AS n FROM walk) WHERE n = 1)
    SELECT o.det_id, coalesce(name, o.det_id) AS track_id FROM o LEFT JOIN l USING (det_id)"""


@query("link_tracks", LINKED)
def link_tracks(t: Tables) -> DataFrame:
    return tracks.link_tracks(_objects(t), 3, 8.0).select("det_id", "track_id")


#: Tracks that SQL knows as well: every run of events of one object within a video.
_TRACKS = "(SELECT det_id, t, x, y, weight, video_id * 100 + (det_id % 16) * 1000 + t // 40 AS track_id FROM {det})"


def _tracks(t: Tables) -> DataFrame:
    return t.det.select("det_id", "t", "x", "y", "weight", F.expr("video_id * 100 + (det_id % 16) * 1000 + t div 40").alias("track_id"))


@query("track_motion", f"SELECT track_id, coalesce(sum(d), 0) AS motion FROM (SELECT track_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM {_TRACKS} WINDOW w AS (PARTITION BY track_id ORDER BY t, det_id)) GROUP BY 1")
def track_motion(t: Tables) -> DataFrame:
    return tracks.motion(_tracks(t))


@query("track_profile", f"SELECT det_id, track_id, count(*) OVER (PARTITION BY track_id) AS track_size, row_number() OVER (PARTITION BY track_id ORDER BY t, det_id) - 1 AS turn, t - min(t) OVER (PARTITION BY track_id) AS rel_t FROM {_TRACKS}")
def track_profile(t: Tables) -> DataFrame:
    return tracks.profile(_tracks(t)).select("det_id", "track_id", "track_size", "turn", "rel_t")


@query("intensity_range", f"SELECT track_id, max(weight) - min(weight) AS intensity_range, count(*) AS n FROM {_TRACKS} GROUP BY 1")
def intensity_range(t: Tables) -> DataFrame:
    return tracks.intensity_range(_tracks(t), "weight")


_SMOOTH = "CASE WHEN count(*) OVER (PARTITION BY track_id) <= 2 THEN weight ELSE round(avg(weight) OVER (PARTITION BY track_id ORDER BY t, det_id ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING), 9) END"


@query("moving_average", f"SELECT det_id, {_SMOOTH.replace('{half}', '2')} AS smooth, weight AS raw FROM {_TRACKS}")
def moving_average(t: Tables) -> DataFrame:
    five = tracks.moving_average(_tracks(t), "weight", 5).withColumnRenamed("smooth", "five")
    return tracks.moving_average(five, "weight", 1).select("det_id", F.col("five").alias("smooth"), F.col("smooth").alias("raw"))


_HILL = f"""(WITH y AS (SELECT track_id, t, det_id, {_SMOOTH.replace('{half}', '1')} AS v FROM {_TRACKS}),
    a AS (SELECT track_id, v, row_number() OVER w - 1 AS i, lead(v) OVER w - v AS d FROM y WINDOW w AS (PARTITION BY track_id ORDER BY t, det_id)),
    p AS (SELECT track_id, i AS peak FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY v DESC, i) AS n FROM a) WHERE n = 1),
    k AS (SELECT track_id, count(*) AS n, max(peak) AS peak, count_if(i < peak AND d > 1e-6) AS up, count_if(i < peak AND abs(d) > 1e-6) AS before, count_if(i >= peak AND d < -1e-6) AS down, count_if(i >= peak AND abs(d) > 1e-6) AS after FROM a JOIN p USING (track_id) GROUP BY 1)
    SELECT track_id, n, n >= 3 AND peak > floor(0.1::DOUBLE * (n - 1)) AND peak < ceil(0.9::DOUBLE * (n - 1)) AND before > 0 AND after > 0 AND up >= 2 AND down >= 2 AND up >= 0.6::DOUBLE * before AND down >= 0.6::DOUBLE * after AS is_hill FROM k)"""


@query("hill_shape", f"SELECT * FROM {_HILL}")
def hill_shape(t: Tables) -> DataFrame:
    return tracks.hill_shape(_tracks(t), "weight")


@query("select_tracks", f"SELECT det_id, track_id, n >= 4 AND r >= 40 AND is_hill AS selected FROM {_TRACKS} JOIN {_HILL} h USING (track_id) JOIN (SELECT track_id, max(weight) - min(weight) AS r FROM {_TRACKS} GROUP BY 1) USING (track_id)")
def select_tracks(t: Tables) -> DataFrame:
    return tracks.select_tracks(_tracks(t), "weight", 4, 40.0).select("det_id", "track_id", "selected")


@query("free_ranges", """SELECT video_id, t + 1 AS t_start, nxt - 1 AS t_end FROM (SELECT video_id, t, lead(t) OVER (PARTITION BY video_id ORDER BY t) AS nxt FROM (SELECT DISTINCT video_id, t FROM {pred} WHERE t < 700 UNION SELECT v, -1 FROM range(0, 4) a(v) UNION SELECT v, 700 FROM range(0, 4) a(v))) WHERE nxt - t > 1""")
def free_ranges(t: Tables) -> DataFrame:
    return sequences.free_ranges(t.pred, _spans(t))


def _spans(t: Tables) -> DataFrame:
    return t.spark.range(4).select(F.col("id").alias("video_id"), F.lit(700).alias("n_frames"))


@query("rolling_background", "SELECT video_id, t, i, v, avg(v) OVER (PARTITION BY video_id, i ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS background FROM (SELECT video_id, t, r.i, pixels[r.i + 1] AS v FROM {frame}, range(0, 64) r(i))")
def rolling_background(t: Tables) -> DataFrame:
    folded = stacking.rolling_background(t.frame, 5)
    return folded.select("video_id", "t", F.inline(F.transform(F.arrays_zip("pixels", "background"), lambda p, i: F.struct((F.col("tile") * stacking.TILE + i).alias("i"), p["pixels"].alias("v"), p["background"].alias("background")))))


@query("ewma_background", """WITH RECURSIVE f AS (SELECT video_id, t, pixels, row_number() OVER (PARTITION BY video_id ORDER BY t) AS k FROM {frame}),
    s AS (SELECT video_id, t, k, list_transform(pixels, lambda p: p::DOUBLE) AS state, NULL::DOUBLE[] AS background FROM f WHERE k = 1
        UNION ALL SELECT f.video_id, f.t, f.k, list_transform(list_zip(s.state, f.pixels), lambda z: 0.75 * z[1] + 0.25 * z[2]), s.state FROM s JOIN f ON f.video_id = s.video_id AND f.k = s.k + 1)
    SELECT video_id, t, round(list_sum(background), 3) AS total, round(background[10], 6) AS one FROM s WHERE k > 1""")
def ewma_background(t: Tables) -> DataFrame:
    b = stacking.ewma_background(t.frame, 0.25)
    return b.groupBy("video_id", "t").agg(F.round(F.sum(F.aggregate("background", F.lit(0.0), lambda a, p: a + p)), 3).alias("total"), F.round(F.max(F.when(F.col("tile") == 0, F.get("background", F.lit(9)))), 6).alias("one"))


def _stacked(value: str) -> str:
    return f"SELECT video_id, t_start, list(v ORDER BY i) AS pixels FROM (SELECT video_id, t // 50 * 50 AS t_start, i, {value} AS v FROM (SELECT video_id, t, r.i, pixels[r.i + 1] AS v FROM {{frame}}, range(0, 64) r(i)) GROUP BY ALL) GROUP BY ALL"


@query("stack_max", _stacked("max(v)"))
def stack_max(t: Tables) -> DataFrame:
    return stacking.stack_max(t.frame, 50)


@query("stack_mean", _stacked("floor(avg(v))::INT"))
def stack_mean(t: Tables) -> DataFrame:
    return stacking.stack_mean(t.frame, 50)


@query("stack_mean_gamma", _stacked("floor(avg((v / 255.0::DOUBLE) ** 2.2) ** (1 / 2.2) * 255.0 + 1e-6)::INT"))
def stack_mean_gamma(t: Tables) -> DataFrame:
    return stacking.stack_mean(t.frame, 50, 2.2)


#: 8-connected regions above 150 in an 8 by 8 frame.
_REGIONS = """RECURSIVE px AS (SELECT video_id, t, i::INT AS i, pixels[i + 1] AS v FROM {frame}, range(0, 64) r(i) WHERE pixels[i + 1] {op} 150),
    nb AS (SELECT a.t, a.i AS a, b.i AS b FROM px a JOIN px b ON a.t = b.t AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1),
    reach AS (SELECT t, i AS a, i AS b FROM px UNION SELECT r.t, r.a, n.b FROM reach r JOIN nb n ON n.t = r.t AND n.a = r.b),
    lab AS (SELECT px.*, k.root FROM px JOIN (SELECT t, a, min(b) AS root FROM reach GROUP BY ALL) k ON k.t = px.t AND k.a = px.i)"""


@query("mask_components", "WITH " + _REGIONS.replace("{op}", ">") + " SELECT video_id, t, row_number() OVER (PARTITION BY t ORDER BY root) AS label, count(*) AS area, min(i % 8) AS x, min(i // 8) AS y, max(i % 8) - min(i % 8) + 1 AS w, max(i // 8) - min(i // 8) + 1 AS h, sum(v) AS mass FROM lab GROUP BY video_id, t, root")
def mask_components(t: Tables) -> DataFrame:
    return regions.mask_components(t.frame, SIDE, 150).select("video_id", "t", "label", "area", "x", "y", "w", "h", F.col("mass").cast("long").alias("mass"))


@query("blob_gate", "WITH " + _REGIONS.replace("{op}", ">") + " SELECT f.t FROM {frame} f LEFT JOIN (SELECT t, max(n) AS n FROM (SELECT t, root, count(*) AS n FROM lab GROUP BY ALL) GROUP BY 1) m ON m.t = f.t WHERE f.t % 4 = 3 OR coalesce(m.n, 0) >= 6")
def blob_gate(t: Tables) -> DataFrame:
    """Positive rows need a bright region of 6 pixels; the others (every fourth) pass untested."""
    areas = regions.largest_area(t.frame.where("t % 4 <> 3"), SIDE, 150)
    return t.frame.select("t").join(areas.select("t", "max_area"), "t", "left").where("t % 4 = 3 OR max_area >= 6").select("t")


@query("grow_region", "WITH " + _REGIONS.replace("{op}", ">=") + ", s AS (SELECT t, (t * 7 % 64)::INT AS i FROM {frame}), g AS (SELECT l.* FROM lab l JOIN s ON s.t = l.t JOIN lab o ON o.t = s.t AND o.i = s.i AND o.root = l.root) SELECT f.video_id, f.t, count(g.i) AS area, min(g.i % 8) AS x, min(g.i // 8) AS y, max(g.i % 8) - min(g.i % 8) + 1 AS w, max(g.i // 8) - min(g.i // 8) + 1 AS h FROM {frame} f LEFT JOIN g ON g.t = f.t GROUP BY ALL")
def grow_region(t: Tables) -> DataFrame:
    seeds = t.frame.select("video_id", "t", F.expr("cast(t * 7 % 64 % 8 AS int)").alias("sx"), F.expr("cast(t * 7 % 64 div 8 AS int)").alias("sy"))
    return regions.grow_region(seeds, t.frame, SIDE, 150)
