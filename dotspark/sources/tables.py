"""Table scans and sinks: lenient CSV, annotation tables, catalogs, change logs, label text, COCO files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import naming

#: Names under which a frame column may come.
FRAME_NAMES = ("t", "frame", "frame_idx", "time")


def resolve(columns: list[str], *names: str) -> str | None:
    """The first of ``names`` among ``columns``, case and surrounding spaces ignored."""
    known = {c.strip().lower(): c for c in columns}
    return next((known[n] for n in names if n in known), None)


def lenient(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns, keep all others as they are, and drop rows in which a named one does not cast.

    Raises if a named column is missing.
    """
    missing = [c for c in types if resolve(rows.columns, c) is None]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    named = {c: resolve(rows.columns, c) for c in types}
    extra = [F.col(f"`{c}`") for c in rows.columns if c not in named.values()]
    cast = [F.trim(F.col(f"`{old}`").cast("string")).try_cast(types[c]).alias(c) for c, old in named.items()]
    return rows.select(*cast, *extra).where(" AND ".join(f"{c} IS NOT NULL" for c in types))


def read_csv(spark: SparkSession, path: str | list[str], types: dict[str, str]) -> DataFrame:
    """Header-driven CSV scan of all columns as text, then :func:`lenient`."""
    return lenient(spark.read.csv(path, header=True, inferSchema=False), types)


def with_frame(rows: DataFrame) -> DataFrame:
    """The frame column under any of its names becomes ``t``; the first name that is present and not null wins."""
    present = [c for n in FRAME_NAMES if (c := resolve(rows.columns, n))]
    if not present:
        raise ValueError(f"none of {', '.join(FRAME_NAMES)} is a column")
    value = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in present))
    return rows.withColumn("_t", value).drop(*present).withColumnRenamed("_t", "t")


def normalize_gt(rows: DataFrame, which: str = "last") -> DataFrame:
    """Ground truth of either schema, (x, y, t) or (x, y, w, h, frame), as (x, y, t); x and y are taken as centers.

    Numbers are rounded, halves to even; rows in which one is missing or no number are left out.
    """
    columns = rows.columns
    if not all(resolve(columns, c) for c in "xy"):
        raise ValueError("ground truth needs x and y")
    point = resolve(columns, "t")
    frame = resolve(columns, "frame")
    if point is None and not (frame and resolve(columns, "w") and resolve(columns, "h")):
        raise ValueError("ground truth needs t, or w, h and frame")
    number = lambda c: F.trim(F.col(c).cast("string")).try_cast("double")
    t = F.bround(number(point)).cast("long") if point else naming.parse_frame(F.col(frame).cast("string"), which)
    whole = lambda c: F.bround(number(resolve(columns, c))).cast("long").alias(c)
    return rows.withColumn("t", t).select(*(c for c in columns if c.lower() not in ("x", "y", "t", "w", "h", "frame")), whole("x"), whole("y"), "t").where("x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL")


def is_annotation_table(header: Column) -> Column:
    """Whether an array of column names holds x, y, w, h and a frame column."""
    names = F.transform(header, lambda c: F.lower(F.trim(c)))
    frame = F.arrays_overlap(names, F.array(*[F.lit(n) for n in FRAME_NAMES]))
    return F.size(F.array_intersect(names, F.array(*[F.lit(c) for c in "xywh"]))).eqNullSafe(4) & frame


def file_catalog(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """(path, size, modified) of the files below ``path`` with one of the extensions; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    rows = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$")) if extensions else rows


def snapshot(spark: SparkSession, path: str, hash_cap: int = 1 << 24) -> DataFrame:
    """(path, size, mtime_ns, sha256) of all files below; files above ``hash_cap`` bytes get no hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= hash_cap).select("path", F.sha2("content", 256).alias("sha256"))
    # Contents of large files are pruned from this side of the join.
    return files.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")).join(small, "path", "left")


#: First bytes of image formats (fixed values).
IMAGE_MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D"}


def sanitize(files: DataFrame) -> DataFrame:
    """Per split (the file's folder) scanned and bad counts, and the first bad paths: empty, or no known signature."""
    head = F.hex(F.substring("content", 1, 8))
    known = F.lit(False)
    for magic in IMAGE_MAGIC.values():
        known = known | F.startswith(head, F.lit(magic))
    reason = F.when(F.col("length") == 0, "zero_bytes").when(~known, "undecodable")
    split = F.element_at(F.split("path", "/"), -2)
    rows = files.select(split.alias("split"), "path", reason.alias("reason"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("scanned"), F.count("reason").alias("bad"), F.slice(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws(": ", "path", "reason")))), 1, 5).alias("preview"))


def resolve_by_priority(files: DataFrame, rules: DataFrame, key: str = "video") -> DataFrame:
    """(key, path): per key the file of the best rule (``suffix``, ``priority``), of equals the first path."""
    joined = files.join(F.broadcast(rules), F.endswith(files["path"], rules["suffix"]))
    return joined.groupBy(key).agg(F.min_by("path", F.struct("priority", "path")).alias("path"))


CHANGE = "timestamp string, meta struct<actor:string,dry_run:boolean,grp:string,pairs:array<string>>, had_error boolean"


def parse_change_log(lines: DataFrame) -> DataFrame:
    """JSON lines (``value``) -> change records; lines that are no JSON object with a timestamp are left out."""
    return lines.select(F.from_json("value", CHANGE, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where("timestamp IS NOT NULL")


def read_change_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_change_log(spark.read.text(path))


def ingest_index(changes: DataFrame, actors: tuple[str, ...]) -> DataFrame:
    """(grp, video, timestamp) of the latest change that is no dry run, without error and of an allowed actor."""
    real = changes.where(~F.coalesce("meta.dry_run", F.lit(False)) & F.col("meta.actor").isin(*actors) & ~F.coalesce("had_error", F.lit(False)))
    return real.select("timestamp", "meta.grp", F.explode("meta.pairs").alias("video")).groupBy("grp", "video").agg(F.max("timestamp").alias("timestamp"))


VIDEO = "video_path string, video_name string, video_stem string, grp string, route string, category string"


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The ``videos`` of JSON catalog documents, one row each; a document is a file, or a line if ``lines``."""
    docs = spark.read.schema(f"videos array<struct<{VIDEO.replace(' string', ':string')}>>").json(path, multiLine=not lines)
    return docs.select(F.explode("videos").alias("v")).select("v.*")


COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<image_id:long,bbox:array<double>>>"


def read_coco(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, boxes) of COCO documents, a file or a line each. Boxes with fewer than four numbers are left out."""
    docs = spark.read.schema(COCO).json(path, multiLine=not lines)
    images = docs.select(F.explode("images").alias("i")).select("i.*")
    boxes = docs.select(F.explode("annotations").alias("a")).select("a.image_id", *(F.get("a.bbox", F.lit(i)).alias(k) for i, k in enumerate("xywh"))).where("h IS NOT NULL")
    return images, boxes


def coco_labels(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, file_name, ``lines``): each image's boxes as sorted label lines of class 0; images without one keep an empty list."""
    from ..functions.geometry import box_to_norm

    line = box_to_norm(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    joined = images.join(boxes, images["id"] == boxes["image_id"], "left")
    return joined.groupBy("id", "file_name").agg(F.sort_array(F.collect_list(F.concat(F.lit("0 "), line))).alias("lines"))


def label_issues(lines: DataFrame) -> DataFrame:
    """(all columns, ``issue``): null if a label line is good, else too_few_fields, bad_class or bad_number. Blank lines are good."""
    parts = F.split(F.trim("line"), r"\s+")
    numbers = [F.get(parts, F.lit(i)).try_cast("double").isNull() for i in range(1, 5)]
    issue = F.when(F.trim("line") == "", None).when(F.size(parts) < 5, "too_few_fields").when(parts[0].try_cast("int").isNull(), "bad_class").when(numbers[0] | numbers[1] | numbers[2] | numbers[3], "bad_number")
    return lines.withColumn("issue", issue)


def write_outcomes(rows: DataFrame, path: str) -> None:
    """Outcome rows as one table, partitioned by threshold and outcome."""
    rows.repartition("threshold", "outcome").write.partitionBy("threshold", "outcome").mode("overwrite").parquet(path)


def write_version(rows: DataFrame, root: str, version: int) -> str:
    """A new version beside the old ones; what is read is never overwritten."""
    path = f"{root.rstrip('/')}/v{version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def json_documents(rows: DataFrame, keys: list[str], name: str = "document") -> DataFrame:
    """Per row the keys and one JSON text of all other columns."""
    return rows.select(*keys, F.to_json(F.struct(*(c for c in rows.columns if c not in keys))).alias(name))
