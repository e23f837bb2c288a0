"""Intermediate tables in the folder that all executors share."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialise, shared_dir

__all__ = ["keyed", "materialise", "shared_dir"]

#: Most files of a table whose numbers are broadcast, and bits of a row's place in its file.
FILES, PLACE_BITS = 1 << 16, 40


def keyed(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` with a number that only one row has, and that column's name, which no column of ``docs`` has.

    The rows of a Parquet table as it was read are numbered by file, in order of path, and place in the file, so
    nothing is copied: a task that runs again finds the same numbers. Any other DataFrame, a table of more than
    ``FILES`` files, and one that reads a file twice, is written once with its numbers.
    """
    key = f"row_{uuid.uuid4().hex}"
    placed = _by_place(docs, key, label)
    return (materialise(docs.withColumn(key, F.monotonically_increasing_id()), label) if placed is None else placed), key


def _by_place(docs: DataFrame, key: str, label: str) -> DataFrame | None:
    # Behind a join or an explosion a place comes more than once, so only a bare scan will do.
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or "_metadata" in (c.lower() for c in docs.columns):
        return None
    path, place = f"{key}_path", f"{key}_place"
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    except AnalysisException:  # a format whose rows have no place
        return None
    paths = rows.groupBy(path).agg(F.count(F.lit(1)).alias(f"{key}_rows"), F.max(place).alias(f"{key}_last"))
    # One partition numbers from 0 on; the table of files is written, so the numbers stay.
    files = materialise(paths.coalesce(1).sortWithinPartitions(path).withColumn(key, F.monotonically_increasing_id()), f"{label}-files")
    if files.count() > FILES or not files.where(F.col(f"{key}_rows") > F.col(f"{key}_last") + 1).isEmpty():
        return None
    numbered = rows.join(F.broadcast(files.select(path, key)), path)
    return numbered.withColumn(key, F.shiftleft(key, PLACE_BITS) + F.col(place)).drop(path, place)
