"""Exact top-k search by inner product, pruned a block at a time.

Components are terms. The rows are dealt out to shards by a hash of their id; in a
shard they are put in an order in which near rows are neighbours and cut into
blocks, each with a forward index (its matrix) and every term's least and largest
weight. For a query the sum of each term's largest product bounds a block from
above. A shard's blocks are visited in the order of their bounds, and scored
through the forward index until the next bound falls below the kth score so far.

A query visits the shard of its own id first. The kth score there is its floor in all
other shards: blocks whose bound is below it are not scored, and only rows that reach
it are passed on to meet in a window per query. A shard takes its queries in bounded
batches.

Vectors that are null, empty or hold null or non-finite components take no part,
nor do rows without an id. Repeated rows are candidates each, and one query. A query
is compared with vectors of its own length only. Scores that may not fit into a long
raise an error. Extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, stored, table

SCALE, K, EVERY = 1024, 10, 100
#: Rows of a shard (about), rows of a block, queries scored together.
SHARD, BLOCK, TOGETHER = 65_536, 256, 64


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v array<long> = floor(SCALE * x) of the rows that take part."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    sound = (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(math.inf)))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
        .select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE).cast("long")).alias("v"))
    )


def neighbourly(x: np.ndarray) -> np.ndarray:
    """An order that halves the rows again and again at the median of the widest component."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        part = x[rows]
        j = int(np.argmax(part.std(0)))
        order = rows[np.argsort(part[:, j], kind="stable")]
        cut = max(BLOCK, (len(rows) // 2 + BLOCK - 1) // BLOCK * BLOCK)
        todo += [order[cut:], order[:cut]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Index:
    """Blocks of one shard's vectors of one length. ``blocks`` counts those that
    queries could have visited, ``scored`` those that were."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = neighbourly(x)
        self.ids, self.x = ids[order], x[order]
        self.most = int(np.abs(x).max(initial=0))
        begins = np.arange(0, len(x), BLOCK)
        self.low, self.high = np.minimum.reduceat(self.x, begins), np.maximum.reduceat(self.x, begins)
        self.blocks = self.scored = 0
        self._kinds: dict[type, tuple] = {}

    def _as(self, kind: type) -> tuple:
        if kind not in self._kinds:
            self._kinds[kind] = tuple(a.astype(kind, copy=False) for a in (self.x, self.low, self.high))
        return self._kinds[kind]

    def search(self, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        """(query's place, ids, scores) of the k best for each query that reach its floor, less its own rows."""
        largest = int(np.abs(q).max(initial=0)) * self.most * q.shape[1]
        if largest >= 1 << 63:
            raise OverflowError("scores may not fit into 64 bits")
        kind = np.float64 if largest < 1 << 53 else np.int64
        q, (x, low, high) = q.astype(kind), self._as(kind)
        bounds = (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(np.int64)
        order = np.argsort(-bounds, axis=1, kind="stable")
        self.blocks += order.size
        for i in range(len(q)):
            ids, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), floor[i]
            for b in order[i]:
                if bounds[i, b] < least:
                    break
                self.scored += 1
                rows = slice(b * BLOCK, (b + 1) * BLOCK)
                s = (x[rows] @ q[i]).astype(np.int64)
                good = (s >= least) & (self.ids[rows] != query_ids[i])
                if good.any():
                    ids, scores = np.append(ids, self.ids[rows][good]), np.append(scores, s[good])
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    if len(ids) == k:
                        least = max(least, scores[-1])
            yield i, ids, scores


def by_length(ids: np.ndarray, more: np.ndarray, vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{length: (ids, more, vectors as a matrix)}."""
    offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    found = {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        found[n] = ids[at], more[at], values[offsets[at][:, None] + np.arange(n)]
    return found


FOUND = "query_id long, vec_id long, score long"


def visits(mine: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """What the queries find in the shards they ask. mine: shard, vec_id, v; asked also has floor."""

    def run(batches):
        here, held, index = None, [], {}

        def gathered(parts: list) -> dict:
            every: dict[int, list] = {}
            for part in parts:
                for n, x in by_length(*part).items():
                    every.setdefault(n, []).append(x)
            return {n: tuple(np.concatenate(y) for y in zip(*x, strict=True)) for n, x in every.items()}

        def answers(part):
            for n, (ids, floor, q) in by_length(*part).items():
                if n not in index:
                    continue
                for lo in range(0, len(ids), TOGETHER):
                    some = slice(lo, lo + TOGETHER)
                    found = [(ids[some][i], got, scores) for i, got, scores in index[n].search(ids[some], q[some], floor[some], k)]
                    columns = np.repeat([i for i, _, _ in found], [len(got) for _, got, _ in found]), np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

        for b in batches:
            shard, side, ids, floor = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3))
            edge = (np.flatnonzero((np.diff(shard) != 0) | (np.diff(side) != 0)) + 1).tolist()
            for lo, hi in zip([0, *edge], [*edge, b.num_rows], strict=True):
                if lo == hi:
                    continue
                part = ids[lo:hi], floor[lo:hi], b.column(4)[lo:hi]
                if shard[lo] != here:
                    here, held, index = shard[lo], [], {}
                if side[lo] == 0:
                    held.append(part)
                    continue
                if held:
                    index = {n: Index(ids, x) for n, (ids, _, x) in gathered(held).items()}
                    held = []
                yield from answers(part)

    rows = mine.select("shard", F.lit(0).alias("side"), "vec_id", F.lit(0).cast("long").alias("floor"), "v")
    rows = rows.union(asked.select("shard", F.lit(1).alias("side"), "vec_id", "floor", "v"))
    return rows.repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(run, FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among vectors (both: vec_id,
    v array<long>), ties to the smaller id. ``rows``: how many vectors there are, about."""
    rows = vectors.count() if rows is None else rows
    shards = max(parallelism(vectors.sparkSession), math.ceil(rows / SHARD))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    mine, queries = vectors.withColumn("shard", home), queries.select("vec_id", "v").distinct()
    none = -(2**63)
    first = stored(visits(mine, queries.select(home.alias("shard"), "vec_id", "v", F.lit(none).alias("floor")), k), "first")
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).where(f"found = {k}")
    # Ids that stand for several vectors get no floor.
    single = queries.groupBy("vec_id").agg(F.count(F.lit(1)).alias("m")).where("m = 1").select("vec_id")
    floors = floors.select(F.col("query_id").alias("vec_id"), "least").join(single, "vec_id", "left_semi")
    others = F.explode(F.expr(f"filter(sequence(0, {shards - 1}), s -> s <> pmod(xxhash64(vec_id), {shards}))")).alias("shard")
    asked = queries.join(floors, "vec_id", "left").select(others, "vec_id", "v", F.coalesce("least", F.lit(none)).alias("floor"))
    found = first.union(visits(mine, asked, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP2_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
