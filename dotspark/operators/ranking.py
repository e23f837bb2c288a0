"""Global positions, running sums, ranks by hash, and bounded previews.

A total order is cut at splitters, which are taken once from a sample and kept as a table of one row. A row's
bucket is found by binary search in them and so depends on its values only, not on where a row happens to lie;
buckets are numbered and summed apart, and what lies before each bucket is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import materialise

#: Rows of the sample for each splitter, and the most splitters.
SAMPLES, MOST = 50, 1 << 14
#: Tells rows apart that the order does not.
TIE = "_tie"


def _splitters(rows: DataFrame, key: Column, buckets: int) -> DataFrame:
    """One row: an array of at most ``buckets`` keys at even distances of a sorted sample."""
    sample = rows.select(key.alias("k")).orderBy(F.rand(11)).limit(SAMPLES * buckets)
    n = F.size("_k")
    cuts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.element_at("_k", 1 + F.floor(i * n / buckets).cast("int")))).otherwise(F.slice("_k", 1, 0))
    return materialise(sample.agg(F.sort_array(F.collect_list("k")).alias("_k")).select(F.array_distinct(cuts).alias("_cuts")), "splitters")


def bucketed(rows: DataFrame, order: list[str], buckets: int | None = None) -> DataFrame:
    """``rows``, written once with ``_tie`` and ``_bucket``: buckets are ranges of (order, tie), in ascending order."""
    n = min(buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST)
    tied = rows.withColumn(TIE, F.monotonically_increasing_id())
    key = F.struct(*order, TIE)
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(n.bit_length()))))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) <= key, at + step).otherwise(at))
    cuts = _splitters(tied, key, n)  # one row of at most MOST keys
    return materialise(tied.join(F.broadcast(cuts)).withColumn("_bucket", place).drop("_cuts"), "ordered")


def _before(totals: DataFrame, columns: list[str], descending: bool) -> DataFrame:
    """Per bucket what the buckets before it sum up to; ``totals`` has one row a bucket."""
    order = F.desc("_bucket") if descending else F.asc("_bucket")
    up_to = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(totals.select("_bucket", *(F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"_{c}") for c in columns)))


def positions(rows: DataFrame, order: list[str], buckets: int | None = None, name: str = "position") -> DataFrame:
    """Adds ``position``, the row's place (from 1) in the ascending order ``order``, nulls first.

    Rows that the order does not tell apart get places next to each other, and may lie in several buckets.
    """
    written = bucketed(rows, order, buckets)
    before = _before(written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")), ["n"], descending=False)
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order, TIE))
    return written.withColumn("_inside", inside).join(before, "_bucket").withColumn(name, F.col("_inside") + F.col("_n")).drop("_bucket", "_inside", "_n", TIE)


def running(rows: DataFrame, order: list[str], sums: dict[str, str], descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Adds the running sums of columns, named by ``sums``, in ``order``, which tells rows apart; no task sees all rows."""
    written = bucketed(rows, order, buckets)
    before = _before(written.groupBy("_bucket").agg(*(F.sum(c).alias(new) for c, new in sums.items())), list(sums.values()), descending)
    turn = F.desc if descending else F.asc
    inside = W.partitionBy("_bucket").orderBy(*map(turn, [*order, TIE])).rowsBetween(W.unboundedPreceding, 0)
    part = written.withColumns({new: F.sum(c).over(inside) for c, new in sums.items()}).join(before, "_bucket")
    return part.withColumns({new: F.col(new) + F.col(f"_{new}") for new in sums.values()}).drop("_bucket", TIE, *(f"_{new}" for new in sums.values()))


#: Hexadecimal digits of a hash that one level of a histogram looks at, and rows of a bucket that are ranked in one task.
DIGITS, RANKED = 3, 100_000


def first_by_hash(rows: DataFrame, by: list[str], digest: Column, cuts: list[Column], names: list[str], digits: int = DIGITS, ranked: int = RANKED) -> DataFrame:
    """Adds ``split``: ``names[k]`` for rows of a group up to place ``cuts[k]`` in the order of ``digest``, the last name for the rest.

    ``digest`` is a hexadecimal hash of 32 digits; ``cuts`` are columns of the group's size ``n``, ascending. The places
    are found by histograms of the leading digits: hashes below a boundary are in and those above are out, and only
    the rows of a boundary's own bucket are looked at again, with more digits, until a bucket is small
    enough to be ranked. Rows of equal hashes that are still too many are ranked in a total order.
    """
    rows = rows.withColumn("_by", F.struct(*(map(F.col, by) if by else [F.lit(1)]))).withColumn("_digest", digest)
    sizes = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n"))
    bounds = materialise(sizes.select("_by", F.lit("").alias("_prefix"), F.col("n").alias("_size"), F.posexplode(F.array(*(c.cast("long") for c in cuts))).alias("_cut", "_want")), "bounds")
    depth, large = 0, not bounds.where(F.col("_size") > ranked).isEmpty()
    if large:
        rows = materialise(rows, "hashed")
    while large and depth < 32:
        counts = rows.select("_by", F.substring("_digest", 1, depth).alias("_prefix"), F.substring("_digest", 1, depth + digits).alias("_next"))
        counts = counts.join(bounds.select("_by", "_prefix").distinct(), ["_by", "_prefix"], "left_semi").groupBy("_by", "_prefix", "_next").agg(F.count(F.lit(1)).alias("_count"))
        counts = counts.withColumn("_upto", F.sum("_count").over(W.partitionBy("_by", "_prefix").orderBy("_next")))
        hit = bounds.join(counts, ["_by", "_prefix"]).where("_want > _upto - _count AND _want <= _upto")  # below a cut of no rows lies nothing
        bounds = materialise(hit.select("_by", F.col("_next").alias("_prefix"), F.col("_count").alias("_size"), "_cut", (F.col("_want") - F.col("_upto") + F.col("_count")).alias("_want")), "bounds")
        depth, large = depth + digits, not bounds.where(F.col("_size") > ranked).isEmpty()
    return _assign(rows, bounds, names, depth, large)


def _assign(rows: DataFrame, bounds: DataFrame, names: list[str], depth: int, large: bool) -> DataFrame:
    """Rows to names by the boundaries (_by, _cut, _prefix, _want): below, above, or by rank within a boundary's bucket."""
    marks = bounds.groupBy("_by").agg(F.sort_array(F.collect_list(F.struct("_cut", "_prefix", "_want"))).alias("_marks"))  # a mark a cut
    marked = rows.join(marks, "_by", "left").withColumn("_at", F.substring("_digest", 1, depth))
    edge = F.coalesce(F.exists("_marks", lambda m: m["_prefix"] == F.col("_at")), F.lit(False))

    def split(place: Column) -> Column:
        first = F.filter("_marks", lambda m: (F.col("_at") < m["_prefix"]) | ((F.col("_at") == m["_prefix"]) & (place <= m["_want"])))
        return F.coalesce(F.get(F.array(*map(F.lit, names)), F.get(first, F.lit(0))["_cut"]), F.lit(names[-1]))

    if large:
        ranked = positions(marked.where(edge), ["_by", "_at", "_digest"], name="_place")
        starts = ranked.groupBy("_by", "_at").agg((F.min("_place") - 1).alias("_start"))
        ranked = ranked.join(starts, ["_by", "_at"]).withColumn("_place", F.col("_place") - F.col("_start")).drop("_start")
    else:
        ranked = marked.where(edge).withColumn("_place", F.row_number().over(W.partitionBy("_by", "_at").orderBy("_digest")))
    out = ranked.withColumn("split", split(F.col("_place"))).drop("_place")
    if depth:
        out = out.unionByName(marked.where(~edge).withColumn("split", split(F.lit(0))))
    return out.drop("_by", "_digest", "_marks", "_at")


def draws(rows: DataFrame, weight: str, order: list[str], n: int, seed: str = "d") -> DataFrame:
    """``n`` draws with replacement: (``draw``, the drawn row's columns), a row as likely as its whole-numbered ``weight``.

    Rows lie side by side on a line, in ``order`` and as long as their weights; draw k is a point on it by hash. The
    line is cut into about ``n`` cells, so a point meets the rows of its cell by equality and no other.
    A row without a weight above 0 is never drawn; without any there are no draws.
    """
    line = running(rows.where(F.col(weight) > 0), order, {weight: "_to"})
    line = materialise(line.withColumn("_from", F.col("_to") - F.col(weight)), "line")
    total = line.agg(F.coalesce(F.max("_to"), F.lit(0)).alias("_total"))
    spark = rows.sparkSession
    points = spark.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total)).where("_total > 0")  # one row
    points = points.withColumn("_at", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"))), 1, 15), 16, 10).cast("long"), F.col("_total")))
    width = F.greatest(F.expr(f"_total div {max(n, 1)}"), F.lit(1))
    cells = F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))
    celled = line.join(F.broadcast(total)).withColumn("_cell", F.explode(cells)).drop("_total")
    hit = points.withColumn("_cell", F.floor(F.col("_at") / width)).join(celled, "_cell").where("_at >= _from AND _at < _to")
    return hit.drop("_cell", "_at", "_total", "_from", "_to")


def first_per_group(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group: a preview of bounded size."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
