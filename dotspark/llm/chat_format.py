"""Chat formatting by quotation linking, with DataFrame functions only.

A message's lines are parsed to (quote level, text); a level is a leading ``>``. Quoted lines are
normalised (lower case, runs of white space as one space) and hashed, and each is joined to the latest
earlier message of the conversation that has the line as its own text at one level less. The message that
most of the quoted lines lead to is the one replied to; without a quote that is found, the one before.
Conversations come out in reply order, every branch right behind the message it answers, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import materialise

#: Turns that one window partition spans when the last of something is carried forward.
SPAN = 1000
#: Digits of a turn in a reply path: those of the longest whole number.
DIGITS = 19


def carry_last(rows: DataFrame, keys: list[str], order: str, value: str, out: str, itself: bool) -> DataFrame:
    """``rows`` with ``out``: the last non-null ``value`` by ``order`` within ``keys``, the row itself counted if ``itself``.

    Two levels, so that one key with a large part of the rows does not go to one task: within spans of
    ``SPAN`` of ``order``, and over the spans' last values, which are joined back.
    """
    span = F.floor(F.col(order) / SPAN)
    rows = rows.withColumn("_span", span)
    near = W.partitionBy(*keys, "_span").orderBy(F.col(order).cast("decimal(20,0)")).rangeBetween(W.unboundedPreceding, 0 if itself else -1)
    lasts = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_span").agg(F.max_by(value, order).alias("_last"))
    spans = rows.select(*keys, "_span").distinct().join(lasts, [*keys, "_span"], "left")
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", True).over(before)).drop("_last")
    return rows.withColumn("_near", F.last(value, True).over(near)).join(carried, [*keys, "_span"]).withColumn(out, F.coalesce("_near", "_carried")).drop("_near", "_carried", "_span")


def quote_level(line: Column) -> Column:
    """Number of ``>`` at the start of a line, spaces between them allowed."""
    return F.when(~F.contains(line, F.lit(">")), 0).otherwise(F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1), "[^>]", "")))


def normalised(line: Column) -> Column:
    """A line without quote marks, in lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, r"^(?:[ \t]*>)+", "")), r"\s+", " "))


def _path(turn: Column) -> Column:
    """A turn as text that sorts like the number: a negative one by what it lacks of 10^19, behind a minus."""
    below = F.concat(F.lit("-"), F.lpad((turn.cast("decimal(20,0)") + F.lit("1" + "0" * DIGITS).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), DIGITS, "0"))
    return F.when(turn < 0, below).otherwise(F.lpad(turn.cast("string"), DIGITS, "0"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of messages that quote an earlier one: lines to votes to the message quoted."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("_no", "_line"))
    parsed = lines.select("conv_id", "turn", "_no", quote_level(F.col("_line")).alias("_level"), normalised(F.col("_line")).alias("_norm")).where("_norm <> ''")
    hashed = materialise(parsed.select("conv_id", "turn", "_level", F.sha2("_norm", 256).alias("_hash")), "chat-lines")
    # A line at level k of one message may be quoted at level k + 1 of another.
    quoted = hashed.where("_level > 0").select("conv_id", "turn", (F.col("_level") - 1).alias("_of"), "_hash")
    wanted = quoted.select("conv_id", "_of", "_hash").distinct()
    said = hashed.select("conv_id", "turn", F.col("_level").alias("_of"), "_hash").join(wanted, ["conv_id", "_of", "_hash"], "left_semi").distinct()
    both = said.withColumn("_said", F.col("turn")).withColumn("_quotes", F.lit(0).cast("long")).unionByName(quoted.groupBy("conv_id", "turn", "_of", "_hash").agg(F.count(F.lit(1)).alias("_quotes")).withColumn("_said", F.lit(None).cast("long")))
    found = carry_last(both, ["conv_id", "_of", "_hash"], "turn", "_said", "_source", itself=False).where("_quotes > 0 AND _source IS NOT NULL")
    votes = found.groupBy("conv_id", "turn", "_source").agg(F.sum("_quotes").alias("_votes"))
    return votes.groupBy("conv_id", "turn").agg(F.max_by("_source", F.struct("_votes", "_source")).alias("reply_to"))


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, ``reply_to``, ``depth``, ``reply_path``, ``text`` without quotes, ``formatted``.

    ``reply_path`` sorts a conversation's messages into reply order (turns of 19 digits, one per branch);
    ``depth`` counts the branches. A message that quotes no earlier one replies to the one before it, the
    first one to none. The latest message wins among those with as many quoted lines. Messages that repeat a
    turn are each kept, with the same links. A null text counts as empty; a null role is ``unknown``. A
    message with a null conversation or turn belongs to none and is left out. Other columns are not read; an
    empty table gives no rows.
    """
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    turns = rows.select("conv_id", "turn").distinct()
    links = reply_links(rows)
    before = carry_last(turns.withColumn("_t", F.col("turn")), ["conv_id"], "turn", "_t", "_previous", itself=False).select("conv_id", "turn", "_previous")
    # A message that answers another one than the one before opens a branch; those after it go on in it.
    linked = before.join(links, ["conv_id", "turn"], "left").withColumn("_opens", F.when(F.col("reply_to").isNotNull() & (F.col("reply_to") != F.col("_previous")), F.col("turn")))
    linked = materialise(carry_last(linked, ["conv_id"], "turn", "_opens", "_branch", itself=True).select("conv_id", "turn", F.coalesce("reply_to", "_previous").alias("reply_to"), F.coalesce("_branch", F.lit(-1)).alias("_branch"), F.col("_opens").isNotNull().alias("_first")), "chat-links")
    opened = linked.where("_first").select("conv_id", F.col("turn").alias("_branch"), F.col("reply_to").alias("_at"))
    parents = linked.select("conv_id", F.col("turn").alias("_at"), F.col("_branch").alias("_under"))
    branches = materialise(opened.join(parents, ["conv_id", "_at"]), "chat-branches")
    # Branches level by level: a branch's path is its parent's, the turn it answers, and its own first turn.
    level = materialise(branches.where("_under = -1").select("conv_id", "_branch", _path(F.col("_at")).alias("_prefix"), F.lit(1).alias("depth")), "chat-level")
    paths = level
    while not level.isEmpty():
        above = level.select("conv_id", F.col("_branch").alias("_under"), "_prefix", "depth")
        level = materialise(branches.join(above, ["conv_id", "_under"]).select("conv_id", "_branch", F.concat_ws(".", "_prefix", _path(F.col("_at"))).alias("_prefix"), (F.col("depth") + 1).alias("depth")), "chat-level")
        paths = paths.unionByName(level)
    placed = linked.join(paths, ["conv_id", "_branch"], "left").select("conv_id", "turn", "reply_to", F.coalesce("depth", F.lit(0)).alias("depth"), F.concat_ws(".", "_prefix", _path(F.col("turn"))).alias("reply_path"))
    kept = F.filter(F.split("text", "\r?\n"), lambda line: quote_level(line) == 0)
    own = F.trim(F.array_join(kept, "\n"))
    out = rows.withColumn("text", own).join(placed, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "role", "reply_to", "depth", "reply_path", "text", F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>")).alias("formatted"))
