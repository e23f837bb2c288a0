"""Queries of section H: scalar and array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry, naming, pixels, scores
from .registry import HEIGHT, SIDE, WIDTH, Tables, query


@query("softmax_conf", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0.5 ELSE 1 / (1 + exp(a - b)) END AS confidence FROM (SELECT event_id, (event_id % 17 - 8)::DOUBLE AS a, value / 100 AS b FROM {named})")
def softmax_conf(t: Tables) -> DataFrame:
    neg = F.expr("CASE WHEN event_id % 50 = 0 THEN NULL ELSE cast(event_id % 17 - 8 AS double) END")
    return t.named.select("event_id", scores.softmax_conf(neg, F.col("value") / 100).alias("confidence"))


@query("log_prob", "SELECT event_id, ln(least(greatest((event_id % 101) / 100.0::DOUBLE, 1e-8), 1 - 1e-8)) AS lp FROM {named}")
def log_prob(t: Tables) -> DataFrame:
    return t.named.select("event_id", scores.log_prob(F.expr("(event_id % 101) / 100.0D")).alias("lp"))


_MASS = """SELECT t, CASE WHEN m > 0 THEN mx / m ELSE {fx} END AS cx, CASE WHEN m > 0 THEN my / m ELSE {fy} END AS cy FROM (
    SELECT t, sum(p * g) AS m, sum(p * g * (i % 8)) AS mx, sum(p * g * (i // 8)) AS my FROM (
        SELECT t, i, CASE WHEN t % 10 = 0 THEN 0 ELSE pixels[i + 1] END::DOUBLE AS p, {g} AS g FROM {frame}, range(0, 64) r(i)) GROUP BY t)"""


def _dark(t: Tables) -> DataFrame:
    """Every tenth frame is black."""
    return t.frame.withColumn("pixels", F.when(F.col("t") % 10 == 0, F.transform("pixels", lambda p: F.lit(0))).otherwise(F.col("pixels")))


@query("centroid", _MASS.replace("{g}", "exp(-(((i % 8) - 3.5) ** 2 + ((i // 8) - 3.5) ** 2) / 8)").replace("{fx}", "4.0").replace("{fy}", "4.0"))
def centroid(t: Tables) -> DataFrame:
    return _dark(t).select("t", pixels.centroid(F.col("pixels"), SIDE, SIDE, 2.0).alias("c")).select("t", "c.cx", "c.cy")


@query("recenter_box", "SELECT t, greatest(0, least(round_even(3 * (t % 20) + cx - 5, 0), 54)) AS x, greatest(0, least(round_even(2 * (t % 20) + cy - 5, 0), 38)) AS y, 10 AS w, 10 AS h FROM (" + _MASS.replace("{g}", "1").replace("{fx}", "3.5").replace("{fy}", "3.5") + ") JOIN (SELECT t FROM {frame} WHERE list_max(pixels) >= 200 AND t % 10 <> 0) USING (t)")
def recenter_box(t: Tables) -> DataFrame:
    """A 10 by 10 box moves to its crop's centroid and into the frame, after the brightness gate."""
    bright = _dark(t).where(pixels.bright_enough(F.col("pixels"), 200))
    at = bright.select("t", pixels.centroid(F.col("pixels"), SIDE, SIDE, 0, "middle").alias("c"))
    box = geometry.clamp_box(F.bround(F.expr("3 * (t % 20)") + F.col("c.cx") - 5), F.bround(F.expr("2 * (t % 20)") + F.col("c.cy") - 5), F.lit(10), F.lit(10), F.lit(WIDTH), F.lit(HEIGHT))
    return at.select("t", *(v.alias(k) for k, v in box._asdict().items()))


@query("refine_center", "SELECT t, bx + cx AS x, byy + cy AS y, 10 AS w, 10 AS h, 'center' AS xy_semantics FROM (SELECT t, greatest(0, least(round_even(t % 60 - 4.0, 0)::INT, 56)) AS bx, greatest(0, least(round_even(t % 44 - 4.0, 0)::INT, 40)) AS byy FROM {frame}) JOIN (" + _MASS.replace("{g}", "exp(-(((i % 8) - 3.5) ** 2 + ((i // 8) - 3.5) ** 2) / 4.5)").replace("{fx}", "4.0").replace("{fy}", "4.0") + ") USING (t)")
def refine_center(t: Tables) -> DataFrame:
    """The center of a detection moves to the weighted centroid of the patch around it."""
    box = geometry.crop_box(F.expr("cast(t % 60 AS double)"), F.expr("cast(t % 44 AS double)"), F.lit(SIDE), F.lit(SIDE), F.lit(WIDTH), F.lit(HEIGHT))
    c = _dark(t).select("t", pixels.centroid(F.col("pixels"), SIDE, SIDE, 1.5).alias("c"), box.x.alias("bx"), box.y.alias("by"))
    return c.select("t", (F.col("bx") + F.col("c.cx")).alias("x"), (F.col("by") + F.col("c.cy")).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"), F.lit("center").alias("xy_semantics"))


@query("refine_gt", _MASS.replace("SELECT t, CASE", "SELECT 'frame_' || lpad(t::VARCHAR, 6, '0') AS frame, CASE").replace("{g}", "exp(-(((i % 8) - 3.5) ** 2 + ((i // 8) - 3.5) ** 2) / 4.5)").replace("{fx}", "sum_x").replace("{fy}", "sum_y").replace("sum_x", "3.5").replace("sum_y", "3.5"))
def refine_gt(t: Tables) -> DataFrame:
    """Ground truth keeps its raw frame name; a patch without weighted mass takes the plain centroid."""
    c = _dark(t).select(F.concat(F.lit("frame_"), F.lpad(F.col("t").cast("string"), 6, "0")).alias("frame"), pixels.centroid(F.col("pixels"), SIDE, SIDE, 1.5, "plain").alias("c"))
    return c.select("frame", "c.cx", "c.cy")


@query("crop_weight", "SELECT t, list_sum(pixels)::BIGINT AS weight FROM {frame}")
def crop_weight(t: Tables) -> DataFrame:
    return t.frame.select("t", pixels.crop_weight(F.col("pixels")).alias("weight"))


@query("brightest_pixel", "SELECT t, (list_position(pixels, list_max(pixels)) - 1) % 8 AS px, (list_position(pixels, list_max(pixels)) - 1) // 8 AS py, list_max(pixels) AS value FROM {frame}")
def brightest_pixel(t: Tables) -> DataFrame:
    return t.frame.select("t", pixels.brightest_pixel(F.col("pixels"), SIDE).alias("b")).select("t", "b.*")


@query("snap_to_bright", """SELECT t, arg_min(i % 8, k) AS px, arg_min(i // 8, k) AS py FROM (
    SELECT t, i, -pixels[i + 1]::BIGINT * 1000000 + (((i % 8) - t % 8) ** 2 + ((i // 8) - t % 5) ** 2)::BIGINT * 1000 + i AS k FROM {frame}, range(0, 64) r(i)) GROUP BY t""")
def snap_to_bright(t: Tables) -> DataFrame:
    """The brightest pixel, of several the nearest to the click."""
    spread = t.frame.select("t", F.posexplode("pixels").alias("i", "v"))
    px, py = F.col("i") % SIDE, F.floor(F.col("i") / SIDE)
    d2 = (px - F.col("t") % 8) * (px - F.col("t") % 8) + (py - F.col("t") % 5) * (py - F.col("t") % 5)
    return spread.groupBy("t").agg(F.min_by(F.struct(px.alias("px"), py.alias("py")), F.struct(-F.col("v"), d2, "i")).alias("b")).select("t", "b.*")


@query("min_square", """SELECT det_id, side, round_even(x + 1.5 - side / 2.0, 0)::INT AS x0, round_even(y + 1.25 - side / 2.0, 0)::INT AS y0 FROM (
    SELECT det_id, x, y, ceil(2 * greatest(1.5, abs(w - 1 - 1.5), 1.25, abs(h - 1 - 1.25)) + 1)::INT AS side FROM {det})""")
def min_square(t: Tables) -> DataFrame:
    square = geometry.min_square(F.col("x") + 1.5, F.col("y") + 1.25, F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return t.det.select("det_id", square.alias("s")).select("det_id", "s.*")


_FRAMES = "CASE WHEN event_id % 11 = 0 THEN 'garbage' WHEN event_id % 5 = 0 THEN (' ' || t || CASE event_id % 3 WHEN 0 THEN '.5' WHEN 1 THEN '.7' ELSE '' END) WHEN event_id % 7 = 0 THEN 'run12/plain' ELSE 'clip' || (event_id % 4) || '_frame_' || lpad(t::VARCHAR, 6, '0') || '.png' END"


def _frame_names(t: Tables) -> DataFrame:
    return t.named.select("event_id", F.expr(_FRAMES.replace("t::VARCHAR", "cast(t AS string)")).alias("name"))


@query("parse_frame_last", f"SELECT event_id, coalesce(round_even(try_cast(trim(name) AS DOUBLE), 0)::BIGINT, try_cast(regexp_extract_all(split_part(name, '/', -1), '\\d+')[-1] AS BIGINT)) AS frame FROM (SELECT event_id, {_FRAMES} AS name FROM {{named}})")
def parse_frame_last(t: Tables) -> DataFrame:
    return _frame_names(t).select("event_id", naming.parse_frame(F.col("name")).alias("frame"))


@query("parse_frame_first", f"SELECT event_id, coalesce(round_even(try_cast(trim(name) AS DOUBLE), 0)::BIGINT, try_cast(regexp_extract_all(name, '\\d+')[1] AS BIGINT)) AS frame FROM (SELECT event_id, {_FRAMES} AS name FROM {{named}})")
def parse_frame_first(t: Tables) -> DataFrame:
    return _frame_names(t).select("event_id", naming.parse_frame(F.col("name"), "first").alias("frame"))


@query("parse_crop_name", "SELECT event_id, CASE WHEN event_id % 13 > 0 THEN t END::INT AS t, CASE WHEN event_id % 13 > 0 THEN x - 3 END::INT AS x, CASE WHEN event_id % 13 > 0 THEN y END::INT AS y, CASE WHEN event_id % 13 > 0 THEN (event_id % 100) / 100.0 END::DOUBLE AS p FROM {named}")
def parse_crop_name(t: Tables) -> DataFrame:
    name = F.expr("CASE WHEN event_id % 13 = 0 THEN concat('x_', t) ELSE concat('f_', t, '_', x - 3, '_', y, '_', w, '_', h, '_', format_string('%.2f', (event_id % 100) / 100.0D), '.png') END")
    return t.named.select("event_id", naming.parse_crop_name(name).alias("c")).select("event_id", "c.t", "c.x", "c.y", "c.p")


@query("parse_exposure_name", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN 100 END AS interval, CASE WHEN event_id % 7 > 0 THEN video END AS video, CASE WHEN event_id % 7 > 0 THEN 'lighten' END AS mode, CASE WHEN event_id % 7 > 0 THEN t END AS t_start, CASE WHEN event_id % 7 > 0 THEN t + 99 END AS t_end FROM {named}")
def parse_exposure_name(t: Tables) -> DataFrame:
    name = F.expr("concat('100_', video, CASE WHEN event_id % 7 = 0 THEN '_other_' ELSE '_lighten_' END, t, '-', t + 99)")
    return t.named.select("event_id", naming.parse_exposure_name(name).alias("e")).select("event_id", "e.*")


@query("parse_patch_name", "SELECT event_id, CASE WHEN event_id % 9 > 0 THEN x END AS x, CASE WHEN event_id % 9 > 0 THEN t END AS t, CASE WHEN event_id % 9 > 0 THEN video END AS video, CASE WHEN event_id % 9 > 0 THEN 'g' || event_id % 3 END AS grp FROM {named}")
def parse_patch_name(t: Tables) -> DataFrame:
    name = F.expr("CASE WHEN event_id % 9 = 0 THEN concat(x, '_', y, '.png') ELSE concat(x, '_', y, '_', w, '_', h, '_', t, '_', video, '_g', event_id % 3, '.png') END")
    return t.named.select("event_id", naming.parse_patch_name(name).alias("p")).select("event_id", "p.x", "p.t", "p.video", "p.grp")


@query("parse_identity", "SELECT event_id, CASE WHEN event_id % 8 > 0 THEN video END AS video, CASE WHEN event_id % 8 > 0 THEN 'g' || event_id % 3 END AS grp, CASE WHEN event_id % 8 > 0 THEN CASE event_id % 2 WHEN 0 THEN 'day' ELSE 'night' END END AS route, CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'negative' ELSE 'positive' END AS label FROM {named}")
def parse_identity(t: Tables) -> DataFrame:
    name = F.expr("concat(video, '_g', event_id % 3, CASE event_id % 2 WHEN 0 THEN '_day' ELSE '_night' END, CASE WHEN event_id % 8 = 0 THEN '' WHEN event_id % 3 = 0 THEN '_time_Negative' ELSE '_time' END, '.csv')")
    return t.named.select("event_id", naming.parse_identity(name).alias("i")).select("event_id", "i.*")


@query("parse_version", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 30 WHEN 1 THEN event_id % 40 END AS version FROM {named}")
def parse_version(t: Tables) -> DataFrame:
    name = F.expr("CASE event_id % 3 WHEN 0 THEN concat('v', event_id % 30) WHEN 1 THEN concat('v', event_id % 40, '_2025-01-0', event_id % 9) ELSE 'latest' END")
    return t.named.select("event_id", naming.parse_version(name).alias("version"))


_SAFE = "trim(regexp_replace(regexp_replace({text}, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_')"
_SLUG = "trim(regexp_replace(lower({text}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("safe_name", "SELECT event_id, " + _SAFE.replace("{text}", "' _/' || grp_text || ' _(' || video || ')!'") + " AS name FROM {named}")
def safe_name(t: Tables) -> DataFrame:
    return t.named.select("event_id", naming.safe_name(F.expr("concat(' _/', grp_text, ' _(', video, ')!')")).alias("name"))


@query("slug", "SELECT event_id, " + _SLUG.replace("{text}", "grp_text || ' #' || video || '-'") + " AS slug FROM {named}")
def slug(t: Tables) -> DataFrame:
    return t.named.select("event_id", naming.slug(F.expr("concat(grp_text, ' #', video, '-')")).alias("slug"))


@query("group_token", "SELECT event_id, replace(replace(lower(grp_text), ' ', '-'), '_', '-') AS token FROM {named}")
def group_token(t: Tables) -> DataFrame:
    return t.named.select("event_id", naming.group_token(F.col("grp_text")).alias("token"))


@query("stem", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN name WHEN 1 THEN name || '.tar.gz' WHEN 2 THEN name ELSE name || '.mp4.csv' END AS stem FROM (SELECT page_id, split_part(path, '/', -1) AS name FROM {video})")
def stem(t: Tables) -> DataFrame:
    return t.video.select("page_id", naming.stem(F.expr("concat(path, CASE page_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.MP4' ELSE '.mp4.csv' END)")).alias("stem"))


@query("short_key", "SELECT page_id, grp || '__' || CASE WHEN length(n) > 120 THEN rtrim(substr(n, 1, 120), '_') ELSE n END || '__' || substr(sha1(n), 1, 10) AS key FROM (SELECT page_id, grp, " + _SAFE.replace("{text}", "CASE WHEN page_id % 3 = 0 THEN url ELSE url || ' ' || url || url END") + " AS n FROM {video})")
def short_key(t: Tables) -> DataFrame:
    return t.video.select("page_id", naming.short_key(F.col("grp"), F.expr("CASE WHEN page_id % 3 = 0 THEN url ELSE concat(url, ' ', url, url) END")).alias("key"))


_DAY, _NIGHT = "(s LIKE '%-day-%' OR s LIKE '%-daytime-%' OR s LIKE '%-day-time-%')", "(s LIKE '%-night-%' OR s LIKE '%-nighttime-%' OR s LIKE '%-night-time-%')"
_ROUTE = f"CASE WHEN {_DAY} AND {_NIGHT} THEN 'conflict' WHEN {_DAY} THEN 'day' WHEN {_NIGHT} THEN 'night' END"
_TEXT = "CASE WHEN event_id % 9 = 0 THEN 'day and night' WHEN event_id % 9 = 1 THEN 'x_DayTime' WHEN event_id % 9 = 2 THEN 'nightly' ELSE grp_text END"


@query("route_hint", f"SELECT event_id, {_ROUTE} AS hint FROM (SELECT event_id, '-' || regexp_replace(lower({_TEXT}), '[^a-z0-9]+', '-', 'g') || '-' AS s FROM {{named}})")
def route_hint(t: Tables) -> DataFrame:
    return t.named.select("event_id", naming.route_hint(F.expr(_TEXT)).alias("hint"))


@query("resolve_route", f"""SELECT event_id, coalesce(o.route, h.hint, g.route, 'night') AS route FROM (SELECT event_id, video, grp_text, {_ROUTE} AS hint FROM (SELECT *, '-' || regexp_replace(lower(grp_text), '[^a-z0-9]+', '-', 'g') || '-' AS s FROM {{named}})) h
    LEFT JOIN (VALUES ('clip1_b0', 'night'), ('clip2_b1', 'day')) o(video, route) ON o.video = h.video LEFT JOIN (VALUES ('Gamma', 'day')) g(grp_text, route) ON g.grp_text = h.grp_text""")
def resolve_route(t: Tables) -> DataFrame:
    """A stem's own route, else the hint in its group's name, else the group's route, else night."""
    stems = t.spark.sql("SELECT * FROM VALUES ('clip1_b0', 'night'), ('clip2_b1', 'day') AS o(video, by_stem)")
    groups = t.spark.sql("SELECT * FROM VALUES ('Gamma', 'day') AS g(grp_text, by_group)")
    joined = t.named.join(stems, "video", "left").join(groups, "grp_text", "left")
    return joined.select("event_id", F.coalesce("by_stem", naming.route_hint(F.col("grp_text")), "by_group", F.lit("night")).alias("route"))


@query("label_from_name", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'negative' ELSE 'positive' END AS label, CASE event_id % 5 WHEN 0 THEN 'negative' WHEN 3 THEN 'negative' ELSE 'positive' END AS by_suffix FROM {named}")
def label_from_name(t: Tables) -> DataFrame:
    """With the video's name (which may itself end in a label), and by the last word alone."""
    video = F.expr("CASE event_id % 5 WHEN 3 THEN concat(video, '(a)_negative') ELSE video END")
    name = F.concat(F.lit("a/"), F.expr("CASE event_id % 5 WHEN 3 THEN concat(video, '-a-_negative') ELSE video END"), F.expr("CASE event_id % 5 WHEN 0 THEN '_x_Negative' WHEN 1 THEN '_positive' WHEN 2 THEN '_nonnegative' WHEN 3 THEN '' ELSE '_negative_x' END"), F.lit(".csv"))
    return t.named.select("event_id", naming.label_from_name(name, video).alias("label"), naming.label_from_name(name).alias("by_suffix"))


@query("box_to_norm", """SELECT det_id, CASE WHEN w > 0 AND h > 0 THEN printf('%.10f %.10f %.10f %.10f', (x + w / 2.0) / 50.0::DOUBLE, (y + h / 2.0) / 30.0::DOUBLE, w / 50.0::DOUBLE, h / 30.0::DOUBLE) END AS line FROM (
    SELECT det_id, greatest(x - 4, 0) AS x, greatest(y - 3, 0) AS y, least(x - 4 + w, 50) - greatest(x - 4, 0) AS w, least(y - 3 + h, 30) - greatest(y - 3, 0) AS h FROM {det})""")
def box_to_norm(t: Tables) -> DataFrame:
    return t.det.select("det_id", geometry.box_to_norm(F.col("x") - 4, F.col("y") - 3, F.col("w"), F.col("h"), F.lit(50), F.lit(30)).alias("line"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", naming.content_hash(F.col("text")).alias("hash"))


@query("format_names", "SELECT event_id, printf('thr_%.1fpx', floor(value * 2) / 2) AS folder, CASE WHEN event_id % 7 - 3 >= 0 THEN '+' ELSE '' END || (event_id % 7 - 3) AS shift FROM {named}")
def format_names(t: Tables) -> DataFrame:
    return t.named.select("event_id", naming.threshold_name(F.floor(F.col("value") * 2) / 2).alias("folder"), naming.signed_offset(F.expr("event_id % 7 - 3")).alias("shift"))


_METRICS = "CASE event_id % 6 WHEN 0 THEN 'ERROR: no ground truth' WHEN 1 THEN ' ' WHEN 2 THEN 'tp=' || x || ' fp=x fn=1' WHEN 3 THEN 'tp=' || x || '  fp=' || y || ' fn=' || w ELSE 'tp=0 tp=' || x || ' fp=' || y || ' fn=' || w || ' precision=0.5 accuracy=0.25 f1=' || h END"


@query("parse_metrics", f"""WITH c AS (SELECT event_id, {_METRICS} AS text, event_id % 6 AS k, x AS tp, y AS fp, w AS fn, h FROM {{named}}),
    r AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN k > 3 THEN 0.5 WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS precision, CASE WHEN k > 3 THEN 0.25 WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END::DOUBLE AS accuracy FROM c)
    SELECT event_id, CASE k WHEN 0 THEN 'error' WHEN 1 THEN 'not_run' WHEN 2 THEN 'error' ELSE 'ok' END AS status, CASE k WHEN 0 THEN 'no ground truth' WHEN 2 THEN 'unable to parse metric summary: ' || text ELSE '' END AS error,
    CASE WHEN k > 2 THEN tp END AS tp, CASE WHEN k > 2 THEN fp END AS fp, CASE WHEN k > 2 THEN fn END AS fn, CASE WHEN k > 2 THEN precision END AS precision, CASE WHEN k > 2 THEN recall END AS recall, CASE WHEN k > 2 THEN accuracy END AS accuracy,
    CASE WHEN k > 3 THEN h::DOUBLE WHEN k = 3 THEN CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END END AS f1 FROM r""")
def parse_metrics(t: Tables) -> DataFrame:
    return t.named.select("event_id", naming.parse_metrics(F.expr(_METRICS)).alias("m")).select("event_id", "m.*")
