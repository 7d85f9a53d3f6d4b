"""Mixing sources to target weights.

The tree is domain, language, source. Weights go down from the root: at each
level the parent's tokens are shared among siblings by weight, but none gets more
than its subtree can give (its tokens times ``epochs``); what one cannot use its
siblings take, and only what a whole subtree cannot give goes to its parent's
siblings. A leaf takes whole epochs, then a prefix of one more, in the order of a
hash of seed, epoch and id; the prefix ends before its tokens would exceed the
leaf's budget (rows of one hash and id belong together).

Only sums per leaf, and per range of hashes within a leaf, are gathered; the place
at which a leaf's prefix ends is looked for inside one such range. So no leaf,
however large, is sorted in one task, and texts are never shuffled.

Null domain, language or source is the leaf ''; null and empty texts have no
tokens. Rows without an id hash as ''; repeated rows are all taken or none. Further
columns keep their values, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

LEVELS = ("domain", "lang", "source")
#: Documents of a range of hashes, about.
RANGE = 2_000


@dataclass(frozen=True)
class Plan:
    """Weights are whole numbers; a name that is not listed has weight ``other``.
    The budget is a share of the corpus's tokens, in per cent."""

    domains: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "reference": ("src0", "src1", "src2", "src3", "src4"), "news": ("src5", "src6", "src7", "src8", "src9"), "forum": ("src10", "src11", "src12", "src13", "src14")})
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {
        "domain": {"reference": 4, "news": 3, "forum": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {}})
    other: int = 1
    per_cent: int = 60
    epochs: int = 2
    seed: int = 11

    def domain_sql(self) -> str:
        return "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in names)}) THEN '{d}'" for d, names in self.domains.items()) + " ELSE 'other' END"

    def weight_sql(self, level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in self.weights[level].items())
        return f"CASE {cases} ELSE {self.other} END" if cases else str(self.other)


PRODUCTION = Plan()


def leaves_of(docs: DataFrame, plan: Plan) -> DataFrame:
    """row (all of docs' columns, so that no name can clash), doc_id, d_domain, d_lang,
    d_source and d_tokens (a token for each four bytes begun)."""
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id",
        F.expr(plan.domain_sql()).alias("d_domain"), F.coalesce("lang", F.lit("")).alias("d_lang"), F.coalesce("source", F.lit("")).alias("d_source"),
        F.expr("coalesce((octet_length(text) + 3) div 4, 0L)").alias("d_tokens"),
    )


def shared_out(nodes: DataFrame, level: str, above: list[str], plan: Plan) -> DataFrame:
    """nodes (above, level, can) joined with their parents' ``given``: what each gets.

    By rising can/weight, nodes get all they can while that is no more than their
    weight's part of what is left; the rest share what then is left by weight."""
    w = F.expr(plan.weight_sql(level)).cast("long")
    order = Window.partitionBy(*above).orderBy((F.col("can") / F.col("w")), level)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*above)
    full = (F.col("can") * F.col("w_left")) <= F.col("w") * (F.col("parent") - F.col("can_before"))
    return (
        nodes.withColumn("w", w)
        .withColumn("can_before", F.coalesce(F.sum("can").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(after))
        .withColumn("full", full)
        .withColumn("can_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("can"))).over(whole), F.lit(0)))
        .withColumn("w_rest", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
        .withColumn("given", F.when(F.col("full"), F.col("can")).otherwise(F.expr("w * (parent - can_full) div w_rest")))
    )


def budgets(leaves: DataFrame, plan: Plan = PRODUCTION) -> DataFrame:
    """domain, lang, source, docs, tokens, given, whole (epochs), rest (tokens of one more), of each leaf with tokens."""
    leaf = leaves.groupBy(F.col("d_domain").alias("domain"), F.col("d_lang").alias("lang"), F.col("d_source").alias("source")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("d_tokens").cast("long").alias("tokens")
    )
    leaf = stored(leaf.where("tokens > 0").withColumn("can", F.col("tokens") * plan.epochs), "leaves")
    parent = leaf.agg(F.expr(f"sum(tokens) * {plan.per_cent} div 100").alias("parent"))
    above: list[str] = ["root"]
    parent = parent.select(F.lit("").alias("root"), "parent")
    for level in LEVELS:
        here = leaf.withColumn("root", F.lit("")).groupBy(*above, level).agg(F.sum("can").cast("long").alias("can"))
        got = shared_out(here.join(parent, above), level, above, plan)
        above = [*above, level]
        parent = got.select(*above, F.col("given").cast("long").alias("parent"))
    return leaf.join(parent.drop("root"), list(LEVELS)).select(
        *LEVELS, "docs", "tokens", F.col("parent").alias("given"), F.expr("parent div tokens").alias("whole"), F.expr("parent % tokens").alias("rest")
    )


def with_plan(leaves: DataFrame, plans: DataFrame, plan: Plan) -> DataFrame:
    """leaves with their budget, their hash and its range."""
    renamed = plans.select(*(F.col(c).alias(f"d_{c}") for c in LEVELS), F.col("docs").alias("d_docs"), F.col("whole").alias("d_whole"), F.col("rest").alias("d_rest"))
    hashed = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("d_whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (
        leaves.join(renamed, [f"d_{c}" for c in LEVELS])
        .withColumn("d_hash", hashed)
        .withColumn("d_range", F.expr(f"cast(conv(substr(d_hash, 1, 8), 16, 10) as long) * (d_docs div {RANGE} + 1) div 4294967296"))
    )


def chosen(docs: DataFrame, plan: Plan = PRODUCTION) -> DataFrame:
    """row, doc_id, d_domain, d_lang, d_source, d_tokens and d_copies of docs that get at least one copy."""
    leaves = leaves_of(docs, plan)
    narrow = leaves.select("doc_id", *(f"d_{c}" for c in LEVELS), "d_tokens")
    plans = stored(budgets(narrow, plan), "budgets")
    leaf = [f"d_{c}" for c in LEVELS]
    hashed = with_plan(narrow, plans, plan)
    sums = hashed.groupBy(*leaf, "d_rest", "d_range").agg(F.sum("d_tokens").alias("n"))
    before = Window.partitionBy(*leaf).orderBy("d_range").rowsBetween(Window.unboundedPreceding, -1)
    border = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before <= d_rest and before + n > d_rest")
    border = stored(border.select(*leaf, F.col("d_range").alias("d_border"), "before"), "borders")
    inside = hashed.join(border, leaf).where("d_range = d_border")
    upto = Window.partitionBy(*leaf).orderBy("d_hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = inside.withColumn("cum", F.col("before") + F.sum("d_tokens").over(upto)).where("cum <= d_rest").groupBy(*leaf).agg(F.max("d_hash").alias("d_cut"))
    border = stored(border.join(cut, leaf, "left").select(*leaf, "d_border", F.coalesce("d_cut", F.lit("")).alias("d_cut")), "cuts")
    more = (F.col("d_range") < F.col("d_border")) | ((F.col("d_range") == F.col("d_border")) & (F.col("d_hash") <= F.col("d_cut")))
    copies = F.col("d_whole") + more.cast("int")
    return with_plan(leaves, plans, plan).join(border, leaf).withColumn("d_copies", copies.cast("int")).where("d_copies > 0").drop("d_docs", "d_whole", "d_rest", "d_hash", "d_range", "d_border", "d_cut")


def mixed(docs: DataFrame, plan: Plan = PRODUCTION) -> DataFrame:
    """docs as often as the mixture takes them."""
    return chosen(docs, plan).select("row", F.explode(F.sequence(F.lit(1), F.col("d_copies")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chosen(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("d_domain").alias("domain"), F.col("d_lang").alias("lang"), F.col("d_source").alias("source"), F.col("d_tokens").alias("tokens"), F.col("d_copies").alias("copies"))


def _level_sql(name: str, level: str, above: str, parent: str, plan: Plan) -> str:
    keys = f"{above}, {level}" if above else level
    part = f"PARTITION BY {above}" if above else ""
    join = f"JOIN {parent} USING ({above})" if above else f"CROSS JOIN {parent}"
    return f"""
{name}0 AS (SELECT h.*, parent, {plan.weight_sql(level)} AS w FROM (SELECT {keys}, sum(can) AS can FROM leaf GROUP BY {keys}) h {join}),
{name}1 AS (SELECT *, coalesce(sum(can) OVER ({part} ORDER BY can / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS can_before,
  sum(w) OVER ({part} ORDER BY can / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM {name}0),
{name}2 AS (SELECT *, can * w_left <= w * (parent - can_before) AS isfull FROM {name}1),
{name}3 AS (SELECT *, coalesce(sum(CASE WHEN isfull THEN can END) OVER ({part}), 0) AS can_full, sum(CASE WHEN NOT isfull THEN w END) OVER ({part}) AS w_rest FROM {name}2),
{name} AS (SELECT {keys}, CASE WHEN isfull THEN can ELSE w * (parent - can_full) // w_rest END AS parent FROM {name}3)"""


def op3_sql(plan: Plan = PRODUCTION) -> str:
    return f"""
WITH d AS (SELECT doc_id, {plan.domain_sql()} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce((strlen(text) + 3) // 4, 0) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {plan.epochs} AS can FROM d GROUP BY ALL HAVING sum(tokens) > 0),
root AS (SELECT sum(tokens) * {plan.per_cent} // 100 AS parent FROM leaf),
{_level_sql("a", "domain", "", "root", plan)},{_level_sql("b", "lang", "domain", "a", plan)},{_level_sql("c", "source", "domain, lang", "b", plan)},
p AS (SELECT leaf.domain, leaf.lang, leaf.source, parent // tokens AS whole, parent % tokens AS rest FROM leaf JOIN c USING (domain, lang, source)),
h AS (SELECT d.*, whole, rest, md5(concat('{plan.seed}', ':', CAST(CAST(whole AS BIGINT) AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS hash FROM d JOIN p USING (domain, lang, source)),
m AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY hash) AS cum FROM h)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(whole + (cum <= rest)::INT AS INTEGER) AS copies FROM m WHERE whole + (cum <= rest)::INT > 0
"""
