"""Secret scans with ownership frequency over the whole corpus, with DataFrame functions only.

Base patterns find assigned values, access keys and hexadecimal strings; a further one finds long mixed tokens.
The values found are hashed and counted over distinct owners and repositories of the whole corpus: what many
owners have is an example that was copied, what one or two have and looks random is taken for a live
credential. Base spans all stay; of the long tokens those that look live and belong to few are added.
Positions follow from splitting a text at a pattern: the pieces between and the matches take turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import materialise
from .skew import join_keyed

#: Fixed patterns. A run of the classes below is found whole by its least length; a value's least length is checked after
#: the match, as a shorter one still takes up its place.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
#: Name, pattern, group of the value and its least length; the last kind is only added where it looks live.
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("live", TOKEN, 0, 16))
BASE = 3
MATCHES = "array<struct<kind:int,no:int,gap:int,size:int,length:int,hash:string,random:boolean>>"
#: Different characters that a random value has at least; owners and repositories that a live one has at most.
DIFFERENT, OWNERS, REPOSITORIES = 8, 2, 10


def _matches(text: Column, kind: int) -> Column:
    """All matches of a kind in order: the characters before it since the last one, its own, and its value's length, hash and look."""
    _, pattern, group, _ = KINDS[kind]
    of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    sizes = F.transform(of(0), lambda m: F.length(m))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= DIFFERENT)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), of(group).alias("value"))
    each = F.transform(zipped, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), m["gap"].alias("gap"), m["size"].alias("size"), F.length(m["value"]).alias("length"), F.sha2(m["value"], 256).alias("hash"), mixed(m["value"]).alias("random")))
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast(MATCHES))


def candidates(rows: DataFrame) -> DataFrame:
    """(_row, _owner, _repo, kind, start, end, hash, random) of rows whose ``_found`` has the matches: base ones, and long tokens apart from these."""
    found = rows.select("_row", "_owner", "_repo", F.inline("_found"))
    upto = W.partitionBy("_row", "kind").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    placed = placed.where(F.col("length") >= least).where(f"kind < {BASE} OR random")
    # A token meets a base span if one that begins before ends behind its start, or one begins behind it and before its end.
    base = lambda c: F.when(F.col("kind") < BASE, F.col(c))
    by = W.partitionBy("_row").orderBy("start")
    before = F.max(base("end")).over(by.rangeBetween(W.unboundedPreceding, 0))
    behind = F.min(base("start")).over(by.rangeBetween(0, W.unboundedFollowing))
    apart = placed.withColumns({"_before": before, "_behind": behind})
    free = F.coalesce(F.col("_before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_behind") >= F.col("end"), F.lit(True))
    return apart.where((F.col("kind") < BASE) | free).select("_row", "_owner", "_repo", "kind", "start", "end", "hash", "random")


def ownership(found: DataFrame) -> DataFrame:
    """Of every hash: distinct owners, distinct repositories (those of different owners are different), and occurrences."""
    repos = found.groupBy("hash", "_owner", "_repo").agg(F.count(F.lit(1)).alias("many"))
    owners = repos.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("many").alias("many"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("many").alias("many"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_live``, ``n_copied``.

    ``spans`` lists kind:start:end of the base spans and of the live tokens besides, by start. ``n_live`` counts the
    spans, base ones included, whose value looks random and is with few owners and repositories; ``n_copied`` those
    whose value more of either have. A null or empty text has no spans; null owners are one owner and null
    repositories one repository; repeated rows are rows of their own, but one repository. Other columns are not
    read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*(_matches(text, k) for k in range(len(KINDS))))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # Written once: a row keeps its number, and no text is read again.
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), name(owner_col).alias("_owner"), name(repo_col).alias("_repo"), found.alias("_found")), "secret-rows")
    spans = materialise(candidates(rows.where(F.size("_found") > 0)), "secret-candidates")
    owned = join_keyed(spans, ownership(spans), ["hash"], "many", spans.count())
    few = (F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES)
    live = F.col("random") & few
    span = F.struct("start", "kind", "end")
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)]
    marked = owned.where((F.col("kind") < BASE) | few).groupBy("_row").agg(
        *kinds, F.collect_list(F.when(F.col("kind") < BASE, span)).alias("_base"), F.collect_list(span).alias("_all"),
        F.count_if(live).alias("n_live"), F.count_if(~few).alias("n_copied"),
    )
    out = rows.select("_row", F.col("_id").alias("doc_id")).join(marked, "_row", "left")
    none = F.lit(0).cast("long")
    counts = {c: F.coalesce(c, none) for c in ("n_assign", "n_access", "n_hex", "n_live", "n_copied")}
    return out.select("doc_id", *(counts[c].alias(c) for c in ("n_assign", "n_access", "n_hex")), F.sha2(F.coalesce(_listed(F.col("_base")), F.lit("")), 256).alias("base_sha256"), F.coalesce(_listed(F.col("_all")), F.lit("")).alias("spans"), counts["n_live"].alias("n_live"), counts["n_copied"].alias("n_copied"))
