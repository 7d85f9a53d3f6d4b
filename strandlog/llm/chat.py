"""Preference formatting, in DataFrame operations only.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns (equal in role and text, place by place) is rendered once as the prompt;
what each has beyond it is its completion. The result has a row for each rendered
turn: its part (prompt, chosen or rejected), place, text, offset within the part,
and the stretch of characters a loss counts: the texts of assistant turns in
completions (0 to 0: none). Joined by place, a part's rows are its text, so that no conversation,
however long, has to fit into one row.

Texts are shuffled once, by conversation and chunk of turns. Everything else that
places turns and finds the prefix is made of narrow rows: counts and lengths of
chunks, and a digest of each turn to compare the two sides by.

Turns are ordered by turn (null first), then role and text; places and offsets are
found by counting per chunk of turns first, so that a conversation may be longer
than a task can hold; turns of one number are in one chunk. Null roles and texts
count as empty. Turns that are repeated
are repeated in the result. A conversation without a partner is all completion,
marked by complete = false, as are pairs in which one side has no completion. Rows
without conv_id are left out, as no pair can hold them; extra columns too.
``examples`` puts each pair into one row, for conversations that fit into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CHUNK = 256


def paired(conversations: DataFrame) -> DataFrame:
    """pair_id, side, turn, role, text: of two neighbouring conversations the even one is chosen."""
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.expr("conv_id div 2 - if(conv_id < 0 and conv_id % 2 <> 0, 1, 0)").alias("pair_id"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("side"),
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def preference(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (chosen or rejected), turn, role, text."""
    side, chunk = ["pair_id", "side"], ["pair_id", "side", "chunk"]
    turns = turns.withColumn("chunk", F.coalesce(F.expr(f"turn div {CHUNK}"), F.lit(-(2**62))))
    size = F.length("role") + F.length("text") + len("<||>\n<|end|>\n")
    # Of each chunk: turns and characters before it in its conversation.
    sums = turns.groupBy(*chunk).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"))
    before = Window.partitionBy(*side).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*chunk, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    inside = Window.partitionBy(*chunk).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    dealt = turns.select(*chunk, "turn", "role", "text").withColumns({
        "i": F.row_number().over(inside) - 1, "chars": F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    place, offset = (F.col("i") + F.col("n_before")).cast("long").alias("place"), (F.col("chars") + F.col("chars_before")).alias("offset")

    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest")
    narrow = dealt.join(sums, chunk).select("pair_id", "side", place, offset, (offset + size).alias("end"), digest)
    last = lambda s: F.max(F.when(F.col("side") == s, F.col("place")))
    at = narrow.groupBy("pair_id", "place").agg(
        ((F.count(F.lit(1)) < 2) | (F.min("digest") != F.max("digest"))).alias("differs"), F.min("offset").alias("offset"), F.max("end").alias("end"), last("chosen").alias("c"), last("rejected").alias("r")
    )
    prefix = at.groupBy("pair_id").agg(
        F.min(F.when(F.col("differs"), F.struct("place", "offset"))).alias("first"), F.max("place").alias("last"), F.max("end").alias("end"), F.coalesce(F.max("c"), F.lit(-1)).alias("c"), F.coalesce(F.max("r"), F.lit(-1)).alias("r")
    )
    turns_shared = F.coalesce("first.place", F.col("last") + 1)
    prefix = prefix.select("pair_id", turns_shared.alias("prompt_turns"), F.coalesce("first.offset", "end").alias("prompt_chars"), (F.least("c", "r") >= turns_shared).alias("complete"))

    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    part = F.when(F.col("place") >= F.col("prompt_turns"), F.col("side")).otherwise(F.lit("prompt"))
    laid = (
        dealt.join(sums.join(prefix, "pair_id"), chunk)
        .select("pair_id", "side", "role", "text", place, offset, "prompt_turns", "prompt_chars", "complete")
        .withColumn("part", part)
        .where((F.col("part") != "prompt") | (F.col("side") == "chosen"))
        .withColumn("char_start", (F.col("offset") - F.when(F.col("part") == "prompt", 0).otherwise(F.col("prompt_chars"))).cast("long"))
    )
    loss = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    begin = F.col("char_start") + F.length(head)
    return laid.select(
        "pair_id", "part", "place", "role", F.concat(head, "text", F.lit("<|end|>\n")).alias("rendered"), "char_start",
        F.when(loss, begin).otherwise(0).cast("long").alias("loss_start"), F.when(loss, begin + F.length("text")).otherwise(0).cast("long").alias("loss_end"), "complete",
    )


def examples(parts: DataFrame) -> DataFrame:
    """A row for each pair: pair_id, prompt, chosen, rejected, the stretches
    chosen_loss and rejected_loss that a loss counts, complete. parts: of ``preference``."""
    turn = F.struct("place", "rendered", "loss_start", "loss_end")
    sides = [F.sort_array(F.collect_list(F.when(F.col("part") == p, turn))).alias(p) for p in ("prompt", "chosen", "rejected")]
    text = lambda p: F.array_join(F.transform(p, lambda t: t["rendered"]), "").alias(p)
    loss = lambda p: F.transform(F.filter(p, lambda t: t["loss_end"] > t["loss_start"]), lambda t: F.struct(t["loss_start"].alias("start"), t["loss_end"].alias("end"))).alias(f"{p}_loss")
    return parts.groupBy("pair_id").agg(*sides, F.first("complete").alias("complete")).select("pair_id", text("prompt"), text("chosen"), text("rejected"), loss("chosen"), loss("rejected"), "complete")


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference(paired(table(spark, sf_dir, "conversations")))


OP4_SQL = """
WITH t AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM t),
m AS (SELECT pair_id, place, count(*) AS n, count(DISTINCT struct_pack(r := role, t := text)) AS kinds FROM p GROUP BY ALL),
l AS (SELECT pair_id, coalesce(min(CASE WHEN n < 2 OR kinds > 1 THEN place END), max(place) + 1) AS prompt_turns FROM m GROUP BY pair_id),
e AS (SELECT pair_id, coalesce(max(CASE WHEN side = 'chosen' THEN place END), -1) AS c, coalesce(max(CASE WHEN side = 'rejected' THEN place END), -1) AS r FROM p GROUP BY pair_id),
x AS (
  SELECT p.*, least(c, r) >= prompt_turns AS complete, CASE WHEN place >= prompt_turns THEN side ELSE 'prompt' END AS part,
         concat('<|', role, '|>', chr(10)) AS head, concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS rendered
  FROM p JOIN l USING (pair_id) JOIN e USING (pair_id)),
y AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start
  FROM x WHERE part <> 'prompt' OR side = 'chosen')
SELECT pair_id, part, place, role, rendered, CAST(char_start AS BIGINT) AS char_start,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN char_start + length(head) ELSE 0 END AS BIGINT) AS loss_start,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN char_start + length(head) + length(text) ELSE 0 END AS BIGINT) AS loss_end, complete
FROM y
"""
