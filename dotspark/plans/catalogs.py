"""Queries of sections A, C, D, E, F, G and I on catalogs, files, logs and training sets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import naming
from ..operators import datasets, filters, joins, metrics, sets
from ..sources import tables, versions
from ..sources.scratch import shared_dir
from ..streaming import streams
from .registry import SIDE, Tables, query

# --- A: scans and sinks -----------------------------------------------------------------------------

_RAW = """(SELECT event_id AS "Extra", CASE event_id % 9 WHEN 0 THEN 'x' ELSE ' ' || x || '.0' END AS " X", y::VARCHAR AS y, CASE event_id % 7 WHEN 0 THEN '' ELSE t::VARCHAR END AS "Frame" FROM {named})"""


def _raw(t: Tables) -> DataFrame:
    """Text columns as a CSV reader gives them, some cells bad."""
    return t.named.select(F.col("event_id").alias("Extra"), F.expr("CASE event_id % 9 WHEN 0 THEN 'x' ELSE concat(' ', x, '.0') END").alias(" X"), F.col("y").cast("string").alias("y"), F.expr("CASE event_id % 7 WHEN 0 THEN '' ELSE cast(t AS string) END").alias("Frame"))


@query("scan_lenient", 'SELECT "Extra" AS extra_id, try_cast(trim(" X") AS DOUBLE) AS x, y::DOUBLE AS y FROM ' + _RAW + ' WHERE try_cast(trim(" X") AS DOUBLE) IS NOT NULL')
def scan_lenient(t: Tables) -> DataFrame:
    return tables.lenient(_raw(t), {"x": "double", "y": "double"}).select(F.col("Extra").alias("extra_id"), "x", "y")


@query("scan_alias", 'SELECT "Extra" AS extra_id, nullif("Frame", \'\')::BIGINT AS t FROM ' + _RAW)
def scan_alias(t: Tables) -> DataFrame:
    return tables.with_frame(_raw(t)).select(F.col("Extra").alias("extra_id"), F.col("t").try_cast("long").alias("t"))


@query("gt_normalize", "SELECT event_id, round_even(x / 2.0, 0)::BIGINT AS x, y, coalesce(try_cast(f AS BIGINT), try_cast(regexp_extract_all(f, '\\d+')[-1] AS BIGINT)) AS t FROM (SELECT event_id, x, y, CASE WHEN event_id % 11 = 0 THEN 'garbage' WHEN event_id % 5 = 0 THEN t::VARCHAR ELSE 'clip2_' || lpad(t::VARCHAR, 5, '0') || '.png' END AS f FROM {named}) WHERE f <> 'garbage'")
def gt_normalize(t: Tables) -> DataFrame:
    frame = F.expr("CASE WHEN event_id % 11 = 0 THEN 'garbage' WHEN event_id % 5 = 0 THEN cast(t AS string) ELSE concat('clip2_', lpad(cast(t AS string), 5, '0'), '.png') END")
    return tables.normalize_gt(t.named.select("event_id", F.expr("concat(x / 2.0D, ' ')").alias("x"), "y", "w", "h", frame.alias("frame")))


_HEADERS = "CASE page_id % 4 WHEN 0 THEN 'X,Y,W,H,Frame' WHEN 1 THEN 'x,y,w,h' WHEN 2 THEN 'x, y ,w,h,time,label' ELSE 'x,y,t' END"


@query("is_annotation_table", "SELECT page_id, page_id % 4 IN (0, 2) AS ok FROM {video}")
def is_annotation_table(t: Tables) -> DataFrame:
    return t.video.select("page_id", tables.is_annotation_table(F.split(F.expr(_HEADERS), ",")).alias("ok"))


@query("file_catalog")
def file_catalog(t: Tables) -> DataFrame:
    """The Parquet files behind the tables, names and sizes without contents."""
    return tables.file_catalog(t.spark, t.sf_dir, ("parquet",))


@query("newest_file")
def newest_file(t: Tables) -> DataFrame:
    files = tables.file_catalog(t.spark, t.sf_dir, ("parquet",)).withColumn("table", F.regexp_extract("path", r"/(\w+)\.parquet", 1))
    return files.groupBy("table").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


_LOG = """(SELECT page_id, '2025-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || 'T' || lpad((page_id % 24)::VARCHAR, 2, '0') AS timestamp, CASE page_id % 5 WHEN 0 THEN 'cleaner' ELSE 'ingestor' END AS actor, page_id % 7 = 0 AS dry_run, grp, page_id % 11 = 0 AS had_error FROM {video})"""


@query("listed_sources", "SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids, true AS newest FROM documents WHERE source IS NOT NULL GROUP BY 1")
def listed_sources(t: Tables) -> DataFrame:
    """Documents as files in a folder per source, found by listing these folders; the newest file of a source is among its own."""
    root = f"{shared_dir(t.spark)}/listed-{uuid.uuid4().hex}"
    t.read("documents").where("source IS NOT NULL").select("doc_id", "source").repartition(4, "source").write.partitionBy("source").parquet(root)
    files = tables.file_catalog(t.spark, root, ("parquet",)).withColumn("source", F.regexp_extract("path", "/source=([^/]*)/", 1))
    newest = files.groupBy("source").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
    rows = t.spark.read.parquet(root).withColumn("path", F.col("_metadata.file_path")).groupBy("source", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    read = rows.select("source", "n", "ids", name.alias("file")).join(files.select("source", name.alias("file")), ["source", "file"])
    marked = read.join(newest.select("source", name.alias("file"), F.lit(True).alias("_newest")), ["source", "file"], "left")
    return marked.groupBy("source").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.coalesce(F.bool_or("_newest"), F.lit(False)).alias("newest"))


@query("table_versions", "SELECT 1 AS version, count(*) AS n, sum(det_id)::BIGINT AS ids FROM {det} UNION ALL SELECT 2, count(*), sum(det_id)::BIGINT FROM {det} WHERE w * h >= 20 UNION ALL SELECT 3, count(*), sum(det_id)::BIGINT FROM (SELECT det_id FROM {det} WHERE w * h >= 20 UNION ALL SELECT det_id FROM {det} WHERE w * h < 5)")
def table_versions(t: Tables) -> DataFrame:
    """A table overwritten in place by what an area gate leaves of it, then appended to; every version can still be read."""
    versions.register(t.spark)
    root = f"{shared_dir(t.spark)}/versions-{uuid.uuid4().hex}"
    put = lambda rows, mode: rows.write.format("versioned").mode(mode).save(root)
    read = lambda n=None: (t.spark.read.format("versioned") if n is None else t.spark.read.format("versioned").option("version", n)).load(root)
    rows = t.det.select("det_id", "w", "h")
    put(rows, "append")
    put(filters.area_filter(read(), 20), "overwrite")
    put(rows.where("w * h < 5"), "append")
    counts = [read(n).agg(F.count(F.lit(1)).alias("n"), F.sum("det_id").alias("ids")).select(F.lit(n).alias("version"), "n", "ids") for n in (1, 2)]
    return counts[0].unionByName(counts[1]).unionByName(read().agg(F.count(F.lit(1)).alias("n"), F.sum("det_id").alias("ids")).select(F.lit(3).alias("version"), "n", "ids"))


@query("log_appends", f"SELECT actor, grp, count(*) AS n, max(timestamp) AS latest FROM {_LOG} WHERE page_id % 13 > 0 GROUP BY ALL")
def log_appends(t: Tables) -> DataFrame:
    """A change log appended to twice, read as a whole; broken lines are passed over."""
    return tables.parse_change_log(t.spark.read.format("linelog").load(_appended(t)).select("value")).groupBy("meta.actor", "meta.grp").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("latest"))


@query("live_log", f"SELECT actor, count(*) AS n, count(DISTINCT timestamp) AS times FROM {_LOG} WHERE page_id % 13 > 0 GROUP BY 1")
def live_log(t: Tables) -> DataFrame:
    """The log as a stream, run after each append with one checkpoint: every line comes once."""
    target = f"{shared_dir(t.spark)}/log-{uuid.uuid4().hex}"

    def run(path: str) -> None:
        lines = t.spark.readStream.format("linelog").load(path)
        streams.ingest_new_files(tables.parse_change_log(lines.select("value")), f"{target}/rows", f"{target}/checkpoint").awaitTermination()

    _appended(t, run)
    return t.spark.read.parquet(f"{target}/rows").groupBy("meta.actor").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("timestamp").alias("times"))


def _appended(t: Tables, after: Callable[[str], None] | None = None) -> str:
    """The change log's lines in two appends; ``after`` is called behind each."""
    versions.register(t.spark)
    path = f"{shared_dir(t.spark)}/log-{uuid.uuid4().hex}"
    for k in (0, 1):
        _log_lines(t.video.where(F.col("page_id") % 2 == k)).write.format("linelog").mode("append").save(path)
        if after:
            after(path)
    return path


@query("snapshot_scan")
def snapshot_scan(t: Tables) -> DataFrame:
    return tables.snapshot(t.spark, t.sf_dir)


@query("sanitize_report")
def sanitize_report(t: Tables) -> DataFrame:
    """Documents as files: a few are empty or have no image signature."""
    docs = t.read("documents")
    content = F.when(F.col("doc_id") % 10 == 0, F.lit("").cast("binary")).when(F.col("doc_id") % 3 == 0, F.unhex(F.concat(F.lit(tables.IMAGE_MAGIC["png"]), F.hex("text")))).otherwise(F.col("text").cast("binary"))
    files = docs.select(F.concat_ws("/", F.lit("root"), "source", F.col("doc_id").cast("string")).alias("path"), content.alias("content"))
    return tables.sanitize(files.withColumn("length", F.octet_length("content")))


@query("resolve_by_priority", """SELECT video, arg_min(path, priority || path) AS path FROM (SELECT regexp_replace(split_part(path, '://', 2), '[0-9]+$', '') AS video, path || CASE page_id % 3 WHEN 0 THEN '_gt.csv' WHEN 1 THEN '_points.csv' ELSE '.csv' END AS path FROM {video}) f
    JOIN (VALUES ('_gt.csv', 0), ('_points.csv', 1)) r(suffix, priority) ON ends_with(f.path, r.suffix) GROUP BY video""")
def resolve_by_priority(t: Tables) -> DataFrame:
    files = t.video.select(F.regexp_replace(F.split_part("path", F.lit("://"), F.lit(2)), "[0-9]+$", "").alias("video"), F.expr("concat(path, CASE page_id % 3 WHEN 0 THEN '_gt.csv' WHEN 1 THEN '_points.csv' ELSE '.csv' END)").alias("path"))
    rules = t.spark.sql("SELECT * FROM VALUES ('_gt.csv', 0), ('_points.csv', 1) AS r(suffix, priority)")
    return tables.resolve_by_priority(files, rules)


def _log_lines(videos: DataFrame) -> DataFrame:
    """A change log in JSON lines, every 13th line broken."""
    stamp = F.expr("concat('2025-01-', lpad(cast(page_id % 28 + 1 AS string), 2, '0'), 'T', lpad(cast(page_id % 24 AS string), 2, '0'))")
    meta = F.struct(F.expr("CASE page_id % 5 WHEN 0 THEN 'cleaner' ELSE 'ingestor' END").alias("actor"), F.expr("page_id % 7 = 0").alias("dry_run"), "grp", F.array(F.expr("concat('v', page_id % 40)"), F.expr("concat('v', page_id % 9)")).alias("pairs"))
    line = F.to_json(F.struct(stamp.alias("timestamp"), meta.alias("meta"), F.expr("page_id % 11 = 0").alias("had_error")))
    return videos.select(F.when(F.col("page_id") % 13 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))


@query("changelog_scan", f"SELECT timestamp, actor, dry_run, grp, had_error FROM {_LOG} WHERE page_id % 13 > 0")
def changelog_scan(t: Tables) -> DataFrame:
    return tables.parse_change_log(_log_lines(t.video)).select("timestamp", "meta.actor", "meta.dry_run", "meta.grp", "had_error")


@query("ingest_index", f"SELECT grp, video, max(timestamp) AS timestamp FROM (SELECT *, unnest(['v' || page_id % 40, 'v' || page_id % 9]) AS video FROM {_LOG}) WHERE page_id % 13 > 0 AND NOT dry_run AND actor = 'ingestor' AND NOT had_error GROUP BY ALL")
def ingest_index(t: Tables) -> DataFrame:
    return tables.ingest_index(tables.parse_change_log(_log_lines(t.video)), ("ingestor",))


def _written(t: Tables, name: str, rows: DataFrame) -> str:
    """Text rows as files in the shared folder."""
    path = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path


@query("catalog_scan", "SELECT url AS video_path, grp, route, category FROM {video}")
def catalog_scan(t: Tables) -> DataFrame:
    """Catalog documents, one per group, written as JSON and scanned again."""
    entry = F.struct(F.col("url").alias("video_path"), F.lit("n").alias("video_name"), F.lit("s").alias("video_stem"), "grp", "route", "category")
    docs = t.video.groupBy("grp", F.floor(F.col("page_id") / 200)).agg(F.to_json(F.struct(F.collect_list(entry).alias("videos"))).alias("value")).select("value")
    return tables.read_catalog(t.spark, _written(t, "catalog", docs), lines=True).select("video_path", "grp", "route", "category")


def _coco(t: Tables) -> tuple[DataFrame, DataFrame]:
    """COCO documents of 50 frames each: a box per detection whose id fits, some outside and some short."""
    image = F.struct("id", F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".png")).alias("file_name"), F.lit(50).alias("width"), F.lit(30).alias("height"))
    boxes = t.det.select(F.col("det_id").alias("image_id"), F.when(F.col("det_id") % 10 == 0, F.array("x")).otherwise(F.array(*(F.col(c).cast("double") for c in "xywh"))).alias("bbox")).where("image_id % 3 > 0")
    part = lambda c: F.floor(F.col(c) / 50).alias("part")
    images = t.det.select(F.col("det_id").alias("id")).groupBy(part("id")).agg(F.collect_list(image).alias("images"))
    grouped = boxes.groupBy(part("image_id")).agg(F.collect_list(F.struct("image_id", "bbox")).alias("annotations"))
    docs = images.join(grouped, "part", "left").select(F.to_json(F.struct("images", "annotations")).alias("value"))
    return tables.read_coco(t.spark, _written(t, "coco", docs), lines=True)


@query("coco_scan", "SELECT det_id AS image_id, x, y, w::DOUBLE AS w, h::DOUBLE AS h FROM {det} WHERE det_id % 3 > 0 AND det_id % 10 > 0")
def coco_scan(t: Tables) -> DataFrame:
    return _coco(t)[1]


@query("coco_to_labels", """SELECT det_id AS id, CASE WHEN det_id % 3 > 0 AND det_id % 10 > 0 AND w > 0 AND h > 0 THEN printf('0 %.10f %.10f %.10f %.10f', (x + w / 2.0) / 50::DOUBLE, (y + h / 2.0) / 30::DOUBLE, w / 50::DOUBLE, h / 30::DOUBLE) ELSE '' END AS line
    FROM (SELECT det_id, x, y, least(x + w, 50) - x AS w, least(y + h, 30) - y AS h FROM {det})""")
def coco_to_labels(t: Tables) -> DataFrame:
    return tables.coco_labels(*_coco(t)).select("id", F.array_join("lines", "|").alias("line"))


_LINES = "CASE event_id % 6 WHEN 0 THEN '0 0.5 0.5 0.1' WHEN 1 THEN 'a 0.5 0.5 0.1 0.1' WHEN 2 THEN '0 0.5 x 0.1 0.1' WHEN 3 THEN '' ELSE '1 0.25  0.5 0.1 0.1 extra' END"


@query("label_validate", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'too_few_fields' WHEN 1 THEN 'bad_class' WHEN 2 THEN 'bad_number' END AS issue FROM {named}")
def label_validate(t: Tables) -> DataFrame:
    return tables.label_issues(t.named.select("event_id", F.expr(_LINES).alias("line"))).select("event_id", "issue")


@query("frame_scan", "SELECT video_id, t FROM {frame} WHERE t < 300")
def frame_scan(t: Tables) -> DataFrame:
    """Decoded frames up to a cap: the filter reaches the scan."""
    return t.frame.where("t < 300").select("video_id", "t")


@query("outcome_sink", "SELECT threshold, outcome, count(*) AS n FROM (SELECT 5.0::DOUBLE AS threshold, CASE det_id % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'fn' END AS outcome FROM {pred} UNION ALL SELECT 10.0, CASE det_id % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'fn' END FROM {pred}) GROUP BY ALL")
def outcome_sink(t: Tables) -> DataFrame:
    """Outcome rows written by threshold and outcome, and read again."""
    rows = t.pred.select(F.explode(F.array(F.lit(5.0), F.lit(10.0))).alias("threshold"), F.expr("CASE det_id % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'fn' END").alias("outcome"), "x", "y", "t", "confidence")
    path = f"{shared_dir(t.spark)}/outcomes-{uuid.uuid4().hex}"
    tables.write_outcomes(rows, path)
    return t.spark.read.parquet(path).groupBy(F.col("threshold").cast("double").alias("threshold"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("summary_json")
def summary_json(t: Tables) -> DataFrame:
    return tables.json_documents(_summary(t), ["video_id"])


def _summary(t: Tables) -> DataFrame:
    rows = metrics.outcomes(t.gt, t.pred, 10.0)
    cell = F.struct("t", "gt_id", "det_id", F.round("distance", 4).alias("distance"))
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("outcome") == k, cell))).alias(k)
    counts = F.struct(*(F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn"))).alias("counts")
    # Rows are grouped by a bounded run of frames first, so that no array holds a whole video.
    return rows.groupBy("video_id", F.floor(F.col("t") / 24).alias("part")).agg(counts, of("tp"), of("fp"), of("fn"))


@query("summary_nested")
def summary_nested(t: Tables) -> DataFrame:
    """Per video and run of 24 frames the counts and sorted rows of each outcome."""
    return _summary(t)


@query("xyt_export", "SELECT x, y, t FROM {det} WHERE confidence >= 0.4")
def xyt_export(t: Tables) -> DataFrame:
    return t.det.where("confidence >= 0.4").select("x", "y", "t")


# --- C: catalog joins ---------------------------------------------------------------------------------

_PAIR = "(SELECT DISTINCT video || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_positive' ELSE '_x_y' END AS name FROM {named}), (SELECT DISTINCT video AS stem FROM {named} WHERE event_id % 7 > 1 UNION SELECT 'clip' || event_id % 7 FROM {named})"


@query("prefix_pair", "SELECT name, arg_max(stem, length(stem)) AS stem FROM (SELECT n.name, s.stem FROM " + _PAIR.replace("), (", ") n LEFT JOIN (") + " s ON n.name = s.stem OR starts_with(n.name, s.stem || '_')) GROUP BY name")
def prefix_pair(t: Tables) -> DataFrame:
    names = t.named.select(F.expr("concat(video, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_positive' ELSE '_x_y' END)").alias("name")).distinct()
    stems = t.named.where("event_id % 7 > 1").select(F.col("video").alias("stem")).union(t.named.select(F.expr("concat('clip', event_id % 7)")))
    return joins.prefix_pair(names, stems)


_TOKENS = "(VALUES ('Alpha'), ('alpha day'), ('bet'), ('gamma'), ('day'), ('--')) g(grp)"


@query("infer_group", "SELECT path, arg_max(grp, length(grp) * 1000 + 0) AS grp FROM (SELECT p.path, g.grp FROM (SELECT DISTINCT '/data/' || grp_text || '/' || video AS path FROM {named}) p LEFT JOIN (SELECT * FROM " + _TOKENS + " WHERE grp <> '--') g ON contains(regexp_replace(lower(p.path), '[^a-z0-9]+', '-', 'g'), replace(lower(g.grp), ' ', '-'))) GROUP BY path")
def infer_group(t: Tables) -> DataFrame:
    """The group of a path by the longest name in it; 'bet' is found within 'beta' too."""
    paths = t.named.select(F.concat(F.lit("/data/"), "grp_text", F.lit("/"), "video").alias("path"))
    groups = t.spark.sql("SELECT * FROM VALUES ('Alpha'), ('alpha day'), ('bet'), ('gamma'), ('day'), ('--') AS g(grp)")
    return joins.token_groups(paths, groups)


_STEMS = "(SELECT page_id, grp, route, category, path, 's' || page_id % 60 AS stem FROM {video})"


def _stems(t: Tables) -> DataFrame:
    return t.video.select("page_id", "grp", "route", "category", "path", F.expr("concat('s', page_id % 60)").alias("stem"))


@query("catalog_label", f"SELECT page_id, CASE WHEN EXISTS (SELECT 1 FROM {_STEMS} k WHERE k.page_id % 40 < 9 AND k.stem = v.stem) THEN 'training' ELSE 'inference' END AS label, EXISTS (SELECT 1 FROM {_STEMS} k WHERE k.page_id % 40 < 9 AND k.grp = v.grp AND k.stem = v.stem) AS same_group FROM {_STEMS} v")
def catalog_label(t: Tables) -> DataFrame:
    return joins.catalog_label(_stems(t), _stems(t).where("page_id % 40 < 9")).select("page_id", "label", "same_group")


@query("ingest_pending", f"SELECT page_id FROM {_STEMS} v WHERE NOT EXISTS (SELECT 1 FROM {_STEMS} k WHERE k.page_id % 6 = 0 AND k.grp = v.grp AND k.stem = v.stem)")
def ingest_pending(t: Tables) -> DataFrame:
    return joins.pending(_stems(t), _stems(t).where("page_id % 6 = 0"), ["grp", "stem"]).select("page_id")


@query("catalog_pairs", f"SELECT v.page_id, r.path AS reference, r.path IS NULL AS missing FROM {_STEMS} v LEFT JOIN (SELECT grp, stem, min(path) AS path FROM {_STEMS} WHERE page_id % 2 = 0 GROUP BY ALL) r USING (grp, stem) WHERE v.category = 'training'")
def catalog_pairs(t: Tables) -> DataFrame:
    """Training videos with their reference file; those without one are marked."""
    refs = _stems(t).where("page_id % 2 = 0").groupBy("grp", "stem").agg(F.min("path").alias("reference"))
    return _stems(t).where("category = 'training'").join(refs, ["grp", "stem"], "left").select("page_id", "reference", F.col("reference").isNull().alias("missing"))


_IMAGES = "(SELECT event_id, 's' || event_id % 900 AS stem, 'd' || event_id % 4 || '/s' || event_id % 900 || CASE WHEN event_id % 5 = 0 THEN '.png' ELSE '.jpg' END AS path FROM {named})"


def _images(t: Tables) -> DataFrame:
    return t.named.select("event_id", F.expr("concat('s', event_id % 900)").alias("stem"), F.expr("concat('d', event_id % 4, '/s', event_id % 900, CASE WHEN event_id % 5 = 0 THEN '.png' ELSE '.jpg' END)").alias("path"))


@query("pair_report", f"SELECT coalesce(i.stem, l.stem) AS stem, CASE WHEN l.stem IS NULL THEN 'left_only' WHEN i.stem IS NULL THEN 'right_only' ELSE 'paired' END AS status FROM (SELECT DISTINCT stem FROM {_IMAGES} WHERE event_id % 900 < 600) i FULL JOIN (SELECT DISTINCT stem FROM {_IMAGES} WHERE event_id % 900 > 250) l ON i.stem = l.stem")
def pair_report(t: Tables) -> DataFrame:
    return joins.pair_report(_images(t).where("event_id % 900 < 600"), _images(t).where("event_id % 900 > 250"), "stem")


@query("best_image", f"SELECT stem, arg_min(path, CASE WHEN path LIKE '%.png' THEN '0' ELSE '1' END || lpad(length(path)::VARCHAR, 5, '0') || path) AS path FROM {_IMAGES} GROUP BY stem")
def best_image(t: Tables) -> DataFrame:
    return joins.best_image(_images(t))


@query("label_manifest", f"""WITH i AS (SELECT DISTINCT stem FROM {_IMAGES} WHERE event_id % 900 < 600), l AS (SELECT DISTINCT stem FROM {_IMAGES} WHERE event_id % 900 > 250)
    SELECT (SELECT count(*) FROM i) AS images, (SELECT count(*) FROM l) AS labels, (SELECT count(*) FROM i WHERE stem NOT IN (SELECT stem FROM l)) AS missing_labels, (SELECT count(*) FROM l WHERE stem NOT IN (SELECT stem FROM i)) AS missing_images""")
def label_manifest(t: Tables) -> DataFrame:
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return joins.pair_report(_images(t).where("event_id % 900 < 600"), _images(t).where("event_id % 900 > 250"), "stem").agg(count("paired", "left_only").alias("images"), count("paired", "right_only").alias("labels"), count("left_only").alias("missing_labels"), count("right_only").alias("missing_images"))


_FILES = "(SELECT doc_id, 's' || doc_id % 300 AS stem, 'in/' || lpad(doc_id::VARCHAR, 9, '0') AS path, sha256(text) AS hash FROM documents)"


def _planned(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Incoming files, and those of a data set: some stems taken under the bare name, some also under the next names."""
    name = "CASE doc_id % 21 WHEN 7 THEN concat('s', doc_id % 300, '__src_web') WHEN 14 THEN concat('s', doc_id % 300, '__src_web__dup2') ELSE concat('s', doc_id % 300) END"
    files = t.read("documents").select("doc_id", F.expr(name).alias("name"), F.expr("concat('s', doc_id % 300)").alias("stem"), F.expr("concat('in/', lpad(cast(doc_id AS string), 9, '0'))").alias("path"), F.sha2(F.concat("text", F.lit("")), 256).alias("hash"))
    held = files.where("doc_id % 7 = 0").groupBy(F.col("name").alias("stem")).agg(F.min("hash").alias("hash"))
    # A few incoming files repeat a held content.
    again = held.withColumn("path", F.concat(F.lit("in/z"), "stem")).withColumn("stem", F.regexp_replace("stem", "__.*", ""))
    return files.where("doc_id % 7 > 0").select("path", "stem", "hash").unionByName(again.select("path", "stem", "hash")), held


#: The files go one after another: a step looks at the names in order, up to the first free one or an equal one.
_COLLISION = """WITH RECURSIVE f AS (SELECT doc_id, 's' || doc_id % 300 AS stem, CASE doc_id % 21 WHEN 7 THEN 1 WHEN 14 THEN 2 ELSE 0 END AS place, 'in/' || lpad(doc_id::VARCHAR, 9, '0') AS path, sha256(text) AS hash FROM documents),
    e AS (SELECT stem, place, min(hash) AS hash FROM f WHERE doc_id % 7 = 0 AND hash IS NOT NULL GROUP BY ALL),
    i AS (SELECT stem, path, hash FROM f WHERE doc_id % 7 > 0 UNION ALL SELECT stem, 'in/z' || stem || CASE place WHEN 0 THEN '' WHEN 1 THEN '__src_web' ELSE '__src_web__dup2' END, hash FROM e),
    o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS k FROM i),
    s AS (SELECT DISTINCT i.stem FROM i),
    w AS (SELECT s.stem, 0::BIGINT AS k, coalesce((SELECT list({'p': e.place, 'h': e.hash} ORDER BY e.place) FROM e WHERE e.stem = s.stem), []) AS held, ''::VARCHAR AS path, -1 AS spot, false AS skip FROM s
        UNION ALL SELECT n.stem, n.k, CASE WHEN n.skip THEN n.held ELSE list_append(n.held, {'p': n.free, 'h': n.hash}) END, n.path, n.free, n.skip FROM (
            SELECT o.stem, o.k, o.path, o.hash, w.held, fr.free, len(list_filter(w.held, lambda q: q.p < fr.free AND q.h = o.hash)) > 0 AS skip
            FROM w JOIN o ON o.stem = w.stem AND o.k = w.k + 1, LATERAL (SELECT list_min(list_filter(range(0, len(w.held) + 1), lambda p: NOT list_contains(list_transform(w.held, lambda q: q.p), p)))::INT AS free) fr) n)
    SELECT path, stem, CASE WHEN skip THEN 'skip' WHEN spot > 0 THEN 'rename' ELSE 'copy' END AS action, CASE WHEN skip THEN NULL WHEN spot = 0 THEN stem WHEN spot = 1 THEN stem || '__src_web' ELSE stem || '__src_web__dup' || spot END AS target FROM w WHERE k > 0"""


@query("collision_plan", _COLLISION)
def collision_plan(t: Tables) -> DataFrame:
    return joins.collision_plan(*_planned(t), "web")


@query("metric_backfill", "SELECT r.page_id, coalesce(CASE WHEN r.page_id % 3 > 0 THEN r.page_id % 50 END, b.tp) AS tp FROM {video} r LEFT JOIN (SELECT grp, max(page_id) AS tp FROM {video} WHERE page_id % 2 = 0 GROUP BY 1) b USING (grp)")
def metric_backfill(t: Tables) -> DataFrame:
    rows = t.video.select("page_id", "grp", F.expr("CASE WHEN page_id % 3 > 0 THEN page_id % 50 END").alias("tp"))
    base = t.video.where("page_id % 2 = 0").groupBy("grp").agg(F.max("page_id").alias("tp"))
    return joins.backfill(rows, base, "grp", ["tp"]).select("page_id", "tp")


@query("missing_models", "SELECT r.route, g.grp FROM (SELECT DISTINCT route FROM {video}) r, (SELECT DISTINCT grp FROM {video}) g WHERE NOT EXISTS (SELECT 1 FROM {video} v WHERE v.route = r.route AND v.grp = g.grp AND v.category = 'training' AND v.page_id % 2 = 0)")
def missing_models(t: Tables) -> DataFrame:
    v = t.video
    return joins.spine_missing(v.select("route").distinct(), v.select("grp").distinct(), v.where("category = 'training' AND page_id % 2 = 0"), ["route", "grp"])


@query("eval_set", "SELECT page_id FROM {video} WHERE page_id IN (SELECT user_id FROM events)")
def eval_set(t: Tables) -> DataFrame:
    """Videos with annotations (here: pages whose id a user has)."""
    return t.video.join(t.read("events").select(F.col("user_id").alias("page_id")), "page_id", "left_semi").select("page_id")


@query("eval_skips", "SELECT page_id, 'video_skip' AS record FROM {video} WHERE page_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def eval_skips(t: Tables) -> DataFrame:
    return t.video.join(t.read("events").select(F.col("user_id").alias("page_id")), "page_id", "left_anti").select("page_id", F.lit("video_skip").alias("record"))


@query("missing_outputs", "SELECT v.page_id, string_agg(o.name, ',' ORDER BY o.name) AS missing FROM {video} v, (VALUES (0, 'fn'), (1, 'fp'), (2, 'summary')) o(k, name) WHERE (v.page_id + o.k) % 3 = 0 OR v.page_id % 7 = o.k GROUP BY 1")
def missing_outputs(t: Tables) -> DataFrame:
    """Per video the required outputs that are not there."""
    required = t.spark.sql("SELECT * FROM VALUES (0, 'fn'), (1, 'fp'), (2, 'summary') AS o(k, name)")
    present = t.video.crossJoin(F.broadcast(required)).where("NOT ((page_id + k) % 3 = 0 OR page_id % 7 = k)").select("page_id", "name")
    return joins.spine_missing(t.video.select("page_id"), required.select("name"), present, ["page_id", "name"]).groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("missing"))


# --- D: rollups ------------------------------------------------------------------------------------------

_RESULTS = "(SELECT grp, CASE page_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN page_id % 5 = 0 THEN 'E' || page_id % 3 END AS error, CASE WHEN page_id % 5 > 1 THEN page_id % 17 END AS tp, CASE WHEN page_id % 5 > 1 THEN page_id % 7 END AS fp, CASE WHEN page_id % 5 > 1 THEN page_id % 11 END AS fn FROM {video} WHERE grp <> 'src3' OR page_id % 5 = 1)"


@query("group_rollup", f"""SELECT grp, videos_total, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS accuracy, tp, fp, fn, n_ok, n_error, errors, CASE WHEN n_ok > 0 AND n_error > 0 THEN 'partial' WHEN n_ok > 0 THEN 'ok' WHEN n_error > 0 THEN 'error' ELSE 'empty' END AS status, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (
    SELECT grp, count(*) AS videos_total, coalesce(sum(tp), 0) AS tp, coalesce(sum(fp), 0) AS fp, coalesce(sum(fn), 0) AS fn, count_if(status = 'ok') AS n_ok, count_if(status = 'error') AS n_error, coalesce(string_agg(DISTINCT error, ';' ORDER BY error), '') AS errors FROM {_RESULTS} GROUP BY 1))""")
def group_rollup(t: Tables) -> DataFrame:
    case = lambda e: F.expr(f"CASE WHEN page_id % 5 > 1 THEN {e} END")
    rows = t.video.where("grp <> 'src3' OR page_id % 5 = 1").select("grp", F.expr("CASE page_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'empty' ELSE 'ok' END").alias("status"), F.expr("CASE WHEN page_id % 5 = 0 THEN concat('E', page_id % 3) END").alias("error"), case("page_id % 17").alias("tp"), case("page_id % 7").alias("fp"), case("page_id % 11").alias("fn"))
    return metrics.group_rollup(rows)


@query("dataset_counts", "SELECT l_returnflag AS split, l_linestatus AS class, l_linenumber AS grp, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((1, 2, 3), (1, 2), (1), ())")
def dataset_counts(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("class"), F.col("l_linenumber").alias("grp"))
    return rows.rollup("split", "class", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_rollup", "SELECT route, category, count(*) AS n, count(DISTINCT grp) AS n_groups FROM {video} GROUP BY CUBE (route, category)")
def catalog_rollup(t: Tables) -> DataFrame:
    return t.video.cube("route", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("n_groups"))


@query("class_weights", "SELECT label, n, CASE WHEN n > 0 THEN sum(n) OVER () / n ELSE 0 END AS weight FROM (SELECT l AS label, count(e.vec_id) AS n FROM range(0, 12) x(l) LEFT JOIN embeddings e ON e.label = l GROUP BY 1)")
def class_weights(t: Tables) -> DataFrame:
    return metrics.class_weights(t.read("embeddings"), "label", t.spark.range(12).select(F.col("id").cast("int").alias("label")))


@query("registry_upsert", "SELECT key, value, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, u DESC) AS n FROM (SELECT event_id % 500 AS key, max(event_id) AS value, 1 AS version, 0 AS u FROM {named} GROUP BY 1 UNION ALL SELECT event_id % 800, min(event_id), (event_id % 800) % 3, 1 FROM {named} GROUP BY 1, 3)) WHERE n = 1")
def registry_upsert(t: Tables) -> DataFrame:
    old = t.named.groupBy(F.expr("event_id % 500").alias("key")).agg(F.max("event_id").alias("value")).withColumn("version", F.lit(1).cast("long"))
    new = t.named.groupBy(F.expr("event_id % 800").alias("key")).agg(F.min("event_id").alias("value")).withColumn("version", F.expr("key % 3"))
    return sets.upsert(old, new, ["key"], "version")


@query("run_manifest", "SELECT 'pipeline' AS section, route AS name, count(*) AS n_rows FROM {video} GROUP BY 2 UNION ALL SELECT 'training', grp, count(*) FROM {video} WHERE category = 'training' GROUP BY 2 UNION ALL SELECT 'baseline', category, count(*) FROM {video} GROUP BY 2")
def run_manifest(t: Tables) -> DataFrame:
    part = lambda df, section, name: df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(section).alias("section"), "name", "n_rows")
    return part(t.video, "pipeline", "route").unionByName(part(t.video.where("category = 'training'"), "training", "grp")).unionByName(part(t.video, "baseline", "category"))


@query("source_stems", f"SELECT route, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups, count(DISTINCT stem) AS n_stems FROM {_STEMS} GROUP BY 1")
def source_stems(t: Tables) -> DataFrame:
    return _stems(t).groupBy("route").agg(F.array_join(F.sort_array(F.collect_set("grp")), ",").alias("groups"), F.countDistinct("stem").alias("n_stems"))


@query("share_of_total", "SELECT event_id, value / sum(value) OVER (PARTITION BY video) AS share FROM {named}")
def share_of_total(t: Tables) -> DataFrame:
    return metrics.share_of_total(t.named, ["video"], "value").select("event_id", "share")


@query("log_final_row", "SELECT video, count(*) AS n_rows, arg_max(value, event_id) AS final_value, max(event_id) AS final_epoch FROM {named} GROUP BY 1")
def log_final_row(t: Tables) -> DataFrame:
    return t.named.groupBy("video").agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("value", "event_id").alias("final_value"), F.max("event_id").alias("final_epoch"))


@query("failed_rows", "SELECT event_id, 'ERROR: ' || video AS result FROM {named} WHERE event_id % 40 = 0")
def failed_rows(t: Tables) -> DataFrame:
    results = t.named.select("event_id", F.expr("concat(CASE WHEN event_id % 40 = 0 THEN 'ERROR: ' ELSE 'tp=1 ' END, video)").alias("result"))
    return results.where(F.startswith("result", F.lit("ERROR:")))


# --- E, I: versions, splits, negatives ---------------------------------------------------------------------

_VERSIONS = "(SELECT event_id, video, CASE event_id % 3 WHEN 0 THEN 'v' || event_id % 30 WHEN 1 THEN 'v' || event_id % 40 || '_2025' ELSE 'latest' END AS name, CASE event_id % 3 WHEN 0 THEN event_id % 30 WHEN 1 THEN event_id % 40 END AS version FROM {named})"


def _versions(t: Tables) -> DataFrame:
    name = F.expr("CASE event_id % 3 WHEN 0 THEN concat('v', event_id % 30) WHEN 1 THEN concat('v', event_id % 40, '_2025') ELSE 'latest' END")
    return t.named.select("video", name.alias("name")).withColumn("version", naming.parse_version(F.col("name")))


@query("latest_version", f"SELECT video, max(version) AS version, arg_max(name, lpad(version::VARCHAR, 5, '0') || name) AS name FROM {_VERSIONS} WHERE version IS NOT NULL GROUP BY 1")
def latest_version(t: Tables) -> DataFrame:
    return sets.latest_version(_versions(t), ["video"], "version", "name")


@query("next_version", f"SELECT max(version) AS latest, 'v' || (max(version) + 1) AS next_name FROM {_VERSIONS}")
def next_version(t: Tables) -> DataFrame:
    return datasets.next_version(_versions(t), F.col("version"))


@query("split_annotations", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY video ORDER BY md5('s:' || event_id)) <= floor(count(*) OVER (PARTITION BY video) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM {named}")
def split_annotations(t: Tables) -> DataFrame:
    return datasets.split_annotations(t.named, "event_id", 0.8, by=["video"]).select("event_id", "split")


@query("split_global", "SELECT event_id, x, y, CASE WHEN row_number() OVER (ORDER BY md5('s:' || event_id)) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM {named}")
def split_global(t: Tables) -> DataFrame:
    return datasets.split_annotations(t.named, "event_id", 0.8).select("event_id", "x", "y", "split")


@query("split_stratified", "SELECT doc_id, CASE WHEN p <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.8::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('s:' || doc_id)) AS p, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def split_stratified(t: Tables) -> DataFrame:
    return datasets.split_stratified(t.read("labels"), "doc_id", "quality").select("doc_id", "split")


@query("split_pairs", "SELECT path, grp, CASE WHEN p <= CASE WHEN n >= 2 THEN least(greatest(floor(n * 0.9::DOUBLE), 1), n - 1) ELSE n END THEN 'train' ELSE 'test' END AS split FROM (SELECT path, grp, row_number() OVER (PARTITION BY grp ORDER BY path) AS p, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT DISTINCT path, grp FROM {video}))")
def split_pairs(t: Tables) -> DataFrame:
    return datasets.split_pairs(t.video.select("path", "grp").distinct(), "path", 0.9, ["grp"])


_FREE = "(SELECT video_id, t + 1 AS t_start, nxt - 1 AS t_end FROM (SELECT video_id, t, lead(t) OVER (PARTITION BY video_id ORDER BY t) AS nxt FROM (SELECT DISTINCT video_id, t FROM {pred} WHERE t < 700 AND det_id % 4 = 0 UNION SELECT v, -1 FROM range(0, 4) a(v) UNION SELECT v, 700 FROM range(0, 4) a(v))) WHERE nxt - t > 1)"


def _sampled(t: Tables) -> DataFrame:
    spans = t.spark.range(4).select(F.col("id").alias("video_id"), F.lit(700).alias("n_frames"))
    return datasets.sample_frames(t.pred.where("det_id % 4 = 0"), spans, 50)


_SAMPLE = f"""(WITH f AS (SELECT *, sum(t_end - t_start + 1) OVER (PARTITION BY video_id ORDER BY t_start) AS upto, sum(t_end - t_start + 1) OVER (PARTITION BY video_id) AS total FROM {_FREE}),
    p AS (SELECT v.video_id, k, ('0x' || substr(md5('s:' || v.video_id || ':' || k), 1, 12))::BIGINT % v.total AS at FROM (SELECT DISTINCT video_id, total::BIGINT AS total FROM f) v, range(0, 50) r(k))
    SELECT p.video_id, p.k, (f.t_start + p.at - (f.upto - (f.t_end - f.t_start + 1)))::BIGINT AS t FROM p JOIN f ON f.video_id = p.video_id AND p.at < f.upto AND p.at >= f.upto - (f.t_end - f.t_start + 1))"""


@query("sample_frames", f"SELECT * FROM {_SAMPLE}")
def sample_frames(t: Tables) -> DataFrame:
    return _sampled(t)


@query("make_negatives", f"""WITH c AS (SELECT DISTINCT s.video_id, s.t, ('0x' || substr(md5('nx:' || s.video_id || ':' || s.t || ':' || k), 1, 12))::BIGINT % 54 + 5 AS x, ('0x' || substr(md5('ny:' || s.video_id || ':' || s.t || ':' || k), 1, 12))::BIGINT % 38 + 5 AS y FROM (SELECT DISTINCT video_id, t FROM {_SAMPLE}) s, range(0, 10) r(k))
    SELECT video_id, t, x, y FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5('n:' || video_id || ':' || t || ':' || x || ':' || y)) AS n FROM c) WHERE n <= 100 + 50 * video_id""")
def make_negatives(t: Tables) -> DataFrame:
    wanted = t.spark.range(4).select(F.col("id").alias("video_id"), (100 + 50 * F.col("id")).alias("n"))
    return datasets.make_negatives(_sampled(t), 10, wanted, 64, 48, 5)


@query("weighted_resample", "SELECT vec_id, unnest(range(1, k + 1)) AS copy FROM (SELECT vec_id, (floor(w) + CASE WHEN ('0x' || substr(md5('r:' || vec_id), 1, 8))::BIGINT / 4294967296.0 < w - floor(w) THEN 1 ELSE 0 END)::INT AS k FROM (SELECT vec_id, 0.35::DOUBLE * label AS w FROM embeddings)) WHERE k > 0")
def weighted_resample(t: Tables) -> DataFrame:
    return datasets.weighted_resample(t.read("embeddings").select("vec_id", "label"), "vec_id", 0.35 * F.col("label")).select("vec_id", "copy")


@query("draw_resample", """WITH w AS (SELECT vec_id, (count(*) OVER () * 1000000 // count(*) OVER (PARTITION BY label))::BIGINT AS w FROM embeddings),
    l AS (SELECT vec_id, w, (sum(w) OVER (ORDER BY vec_id))::BIGINT AS upto FROM w),
    d AS (SELECT k AS draw, ('0x' || substr(md5('d:' || k), 1, 15))::BIGINT % (SELECT max(upto) FROM l) AS p FROM range(0, (SELECT count(*) FROM embeddings)) x(k))
    SELECT draw, vec_id FROM d JOIN l ON p >= upto - w AND p < upto""")
def draw_resample(t: Tables) -> DataFrame:
    return datasets.draw_resample(t.read("embeddings").select("vec_id", "label"), "vec_id", "label").select("draw", "vec_id")


@query("combine_groups", "SELECT route || '__' || path AS path, route AS grp FROM {video}")
def combine_groups(t: Tables) -> DataFrame:
    return datasets.combine_groups({r: t.video.where(F.col("route") == r).select("path") for r in ("day", "night")}, "path").select("path", "grp")


@query("leave_one_out", "SELECT dataset, count(*) AS n FROM (SELECT 'global' AS dataset FROM {video} UNION ALL SELECT 'without_' || g.grp FROM {video} v, (SELECT DISTINCT grp FROM {video}) g WHERE g.grp <> v.grp) GROUP BY 1")
def leave_one_out(t: Tables) -> DataFrame:
    return datasets.leave_one_out(t.video.select("page_id", "grp")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("trainable_check", "SELECT s.split, l.label, count(e.vec_id) AS n, count(e.vec_id) > 0 AS ok FROM (VALUES ('train'), ('val')) s(split), (VALUES ('0'), ('5'), ('11')) l(label) LEFT JOIN embeddings e ON e.label::VARCHAR = l.label AND CASE e.vec_id % 2 WHEN 0 THEN 'train' ELSE 'val' END = s.split GROUP BY ALL")
def trainable_check(t: Tables) -> DataFrame:
    rows = t.read("embeddings").select(F.col("label").cast("string").alias("label"), F.expr("CASE vec_id % 2 WHEN 0 THEN 'train' ELSE 'val' END").alias("split"))
    return datasets.trainable_check(rows, ["train", "val"], ["0", "5", "11"])


@query("extract_patches", "SELECT (t % 8)::VARCHAR || '_' || (t % 7) || '_' || t || '_' || video_id AS name, list_transform(range(0, 16), lambda i: CASE WHEN y0 + i // 4 BETWEEN 0 AND 7 AND x0 + i % 4 BETWEEN 0 AND 7 THEN pixels[(y0 + i // 4) * 8 + x0 + i % 4 + 1] ELSE 0 END) AS patch FROM (SELECT *, (t % 8 - 2)::INT AS x0, (t % 7 - 2)::INT AS y0 FROM {frame}) WHERE t % 5 > 0")
def extract_patches(t: Tables) -> DataFrame:
    rows = t.frame.select("video_id", "t", (F.col("t") % 8).alias("x"), (F.col("t") % 7).alias("y"))
    existing = rows.where("t % 5 = 0").select(F.concat_ws("_", *(F.col(c).cast("string") for c in ("x", "y", "t", "video_id"))).alias("name"))
    return datasets.extract_patches(rows, t.frame, existing, SIDE, SIDE, 4)


@query("work_list", "SELECT path, CASE WHEN bool_or(page_id % 9 = 0) OVER (PARTITION BY path) THEN 'held_out' WHEN NOT bool_or(page_id % 4 > 0) OVER (PARTITION BY path) THEN 'missing' WHEN bool_or(page_id % 5 = 1) OVER (PARTITION BY path) THEN 'done' ELSE 'todo' END AS status FROM {video}")
def work_list(t: Tables) -> DataFrame:
    v = t.video.select("page_id", "path")
    return datasets.work_list(v, v.where("page_id % 9 = 0"), v.where("page_id % 4 > 0"), v.where("page_id % 5 = 1"))
