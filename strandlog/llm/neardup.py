"""Near-duplicate documents by fast similarity sketching.

A document's set holds its distinct shingles. The sketch has T coordinates. In
round i each shingle is hashed to a bin and a value; a bin takes the least value
of the first round that reaches it. After T rounds, T more visit each bin in
turn, so every coordinate fills; the estimate concentrates as for T independent
hash functions, at the cost of about one. BANDS of ROWS coordinates propose
candidates (a pair at similarity 0.8 is missed with probability below 2e-7).

Equal sets are one class from the start, led by their smallest id, so copies cost
one row each. In each bucket all members are compared with its smallest; links are
contracted to components. What shares a bucket and is still in different components
is then looked at again, in two ways. While that pays, each member outside its
bucket's largest component is compared with the members of other components whose
parity maps are nearest (as in Boruvka's algorithm, components at least halve where
those are linked). At last every pair of different components that parity maps don't
rule out is compared. Buckets are dealt out in blocks of members; maps meet there as
arrays, and only the pairs to compare become rows.

Each set has a parity map of BITS bits: a bit tells whether an odd number of its
shingles hash there. Two maps differ in at most as many bits as the sets differ in
shingles, so pairs whose maps differ in too many cannot be linked and are dropped
without their texts. Every other pair is compared on full sets.

Links become components by alternating large and small stars, each round written
to the shared folder. Sets are of 64-bit hashes of shingles.

Null and empty texts have empty sets, are linked with nothing and keep their own
id. A row without an id has no component and is never a partner. Repeated rows
give repeated rows; if one id has several texts, its links are confirmed on the
smallest. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table, text_of

BANDS, ROWS = 40, 5
T = BANDS * ROWS
THRESHOLD = 80  # per cent
HELD = 2_000_000  # shingles of sets that a task keeps while it compares
BITS = 512
#: Members of a bucket, and pairs of one document, that are dealt to a task together (about).
BLOCK, TOGETHER = 512, 256
#: Candidates of a member in a round of nearest ones; the share of them that must be links for another such round.
NEAREST, PAYS = 2, 0.1
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of texts: sorted distinct 64-bit hashes of runs of ``words`` words."""

    def __init__(self, words: int, most: int = 100_000):
        self.words, self.most, self.known = words, most, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        n = min(self.words, len(h))
        x = mix(h[: len(h) - n + 1] + np.uint64(n * int(_M1) % (1 << 64)))
        for i in range(1, n):
            x = mix(x * _M1 + h[i : len(h) - n + 1 + i])
        return np.unique(x)


_rounds = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * _M1)


def sketch(items: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set."""
    empty = np.iinfo(np.uint64).max
    out = np.full(T, empty, np.uint64)
    for i in range(2 * T):
        x = mix(items ^ _rounds[i])
        if i < T:
            bins = (x >> np.uint64(32)) * np.uint64(T) >> np.uint64(32)
            value = (np.uint64(i) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, bins.astype(np.int64), value)
        else:
            out[i - T] = min(out[i - T], (np.uint64(i) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)).min())
        if out.max() < empty:
            break
    return out


def bands(items: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    s = sketch(items).reshape(BANDS, ROWS)
    x = np.arange(BANDS, dtype=np.uint64) * _M1
    for i in range(ROWS):
        x = mix(x * _M1 + s[:, i])
    return x.view(np.int64)


def parities(items: np.ndarray) -> np.ndarray:
    """The parity map of a set, as BITS / 64 numbers."""
    odd = np.bincount((items >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) that their maps don't rule out. maps: doc_id, n, parity (null: nothing is known)."""
    a, b = (maps.toDF(x, f"n_{x}", f"parity_{x}") for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(within()).select("a", "b")


def within():
    """Whether sets of n_a and n_b shingles may share enough, by parity_a and parity_b."""
    differ = " + ".join(f"bit_count(parity_a[{i}] ^ parity_b[{i}])" for i in range(BITS // 64))
    both = f"least(n_a, n_b, (n_a + n_b - ({differ})) div 2)"
    return F.expr(f"parity_a is null or parity_b is null or 100 * {both} >= {THRESHOLD} * (n_a + n_b - {both})")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null: empty), bands, parity."""

    def run(batches):
        sets = Shingler(words)
        for b in batches:
            n, digest, keys, parity = [], [], [], []
            for t in b.column(1).to_pylist():
                s = sets(t)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(bands(s) if len(s) else [])
                parity.append(parities(s))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, parity)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *lists], ["doc_id", "n_shingles", "set_hash", "bands", "parity"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, parity array<long>")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    n, m = len(a), len(b)
    if 100 * min(n, m) < THRESHOLD * max(n, m):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= THRESHOLD * (n + m - both)


def confirm(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. texts: doc_id, text. A document
    that stands as a in many pairs is sent once for each block of them."""
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.expr(f"cast((n + {TOGETHER - 1}) div {TOGETHER} as int)").alias("blocks"))
    block = F.expr("cast(pmod(xxhash64(b), blocks) as int)").alias("block")
    left = hubs.select("a", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block")).join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    right = pairs.join(hubs, "a").select("a", block, "b").join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
    both = left.select("a", "block", F.lit(None).cast("long").alias("b"), "text").union(right.select("a", "block", "b", "text"))

    def run(batches):
        sets = Shingler(words)
        held: dict[int, np.ndarray] = {}
        room, hub, mine = HELD, None, None

        def of(i, t):
            nonlocal room
            if i not in held:
                s = sets(t)
                if room < len(s):
                    held.clear()
                    room = HELD
                held[i] = s
                room -= len(s)
            return held[i]

        for batch in batches:
            found = []
            for a, b, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b is None:
                    hub, mine = a, of(a, t.as_py())
                elif a == hub and similar(mine, of(b, t.as_py())):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return both.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component (smallest id reachable) of all ends of edges (a, b)."""
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    last = None
    while True:
        # Large star: every larger neighbour goes to the smallest neighbour (or the vertex itself).
        both = edges.union(edges.select("b", "a").toDF("a", "b")).toDF("v", "u")
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).where("a < b").distinct()
        # Small star: every vertex and its smaller neighbours go to the smallest of those.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last:
            return edges.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "doc_id")
        last = now


def close(n: np.ndarray, parity: np.ndarray, m: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some maps and each of others: whether the two may be linked, and
    how many bits they differ in. n, m: sizes of sets, -1: nothing is known."""
    differ = np.bitwise_count(parity[:, None, :] ^ others[None, :, :]).sum(2, dtype=np.int64)
    n, m = n[:, None], m[None, :]
    both = np.minimum(np.minimum(n, m), (n + m - differ) // 2)
    return (n < 0) | (m < 0) | (100 * both >= THRESHOLD * (n + m - both)), differ


def across(rest: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) of a bucket and different components that may be linked; for
    ``nearest`` only each member's NEAREST in each block. A member outside the
    largest component meets its own block and visits the others.

    rest: key, doc_id, component, lead, size and largest (of the bucket), n, parity."""
    minor = (F.col("component") != F.col("largest")).alias("minor")
    n = F.when(F.col("parity").isNotNull(), F.col("n")).otherwise(F.lit(-1)).cast("long").alias("n")
    parity = F.coalesce("parity", F.array_repeat(F.lit(0).cast("long"), BITS // 64)).alias("parity")
    rest = rest.withColumn("blocks", F.expr(f"cast((size + {BLOCK - 1}) div {BLOCK} as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
    columns = ["doc_id", "component", "lead", minor, n, parity]
    own = rest.select("key", "block", F.lit(0).alias("visits"), *columns)
    to = F.explode(F.expr("array_except(sequence(0, blocks - 1), array(block))")).alias("block")
    visiting = rest.where("blocks > 1 and component <> largest").select("key", to, F.lit(1).alias("visits"), *columns)

    def run(batches):
        here, held = None, None

        def pairs(x: tuple):
            ids, component, lead, _, n, parity = x
            o_ids, o_component, _, o_minor, o_n, o_parity = held
            for at in range(0, len(ids), 128):
                part = slice(at, at + 128)
                may, differ = close(n[part], parity[part], o_n, o_parity)
                may &= component[part, None] != o_component[None, :]
                # With the bucket's lead all were compared; of two members outside the largest component the smaller asks.
                may &= (ids[part, None] != lead[part, None]) & (o_ids[None, :] != lead[part, None])
                if not nearest:
                    may &= ~o_minor[None, :] | (ids[part, None] < o_ids[None, :])
                elif may.shape[1] > NEAREST:
                    rank = np.where(may, differ, 1 << 40)
                    worst = np.partition(rank, NEAREST - 1, axis=1)[:, NEAREST - 1 : NEAREST]
                    may &= rank <= worst
                    may &= np.cumsum(may, axis=1) <= NEAREST
                i, k = np.nonzero(may)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][i]), pa.array(o_ids[k])], ["a", "b"])

        def part_of(b, lo, hi):
            column = [np.asarray(b.column(j)[lo:hi].to_numpy(zero_copy_only=False)) for j in (3, 4, 5, 6, 7)]
            parity = b.column(8)[lo:hi].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(hi - lo, -1)
            return (*column, parity)

        def begun():
            """Pairs inside a block, once it is complete."""
            minors = held[3]
            yield from pairs(tuple(x[minors] for x in held))

        waiting = False
        for b in batches:
            key, block, visits = (b.column(j).to_numpy(zero_copy_only=False) for j in (0, 1, 2))
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(visits) != 0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                x = part_of(b, lo, hi)
                if visits[lo]:
                    if here == (key[lo], block[lo]):
                        if waiting:
                            yield from begun()
                            waiting = False
                        yield from pairs(x)
                    continue
                if here == (key[lo], block[lo]):
                    held = tuple(np.concatenate(y) for y in zip(held, x, strict=True))
                else:
                    if waiting:
                        yield from begun()
                    here, held, waiting = (key[lo], block[lo]), x, True
        if waiting:
            yield from begun()

    return own.union(visiting).repartition("key", "block").sortWithinPartitions("key", "block", "visits").mapInArrow(run, "a long, b long").distinct()


#: Spark's Bloom filter of a join's smaller side, at every size of input; it never has more than 8 MB.
BLOOM = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t", "expectedNumItems": "4000000", "numBits": "67108864"}


@contextmanager
def bloom_filters(spark: SparkSession):
    """Inside, joins drop rows without a partner before the shuffle, as far as the
    filter tells; the join itself stays exact. Spark filters only by a side that has
    a comparison in it."""
    names = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in BLOOM.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def still_apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component, and their bucket's size and largest component."""
    where = members.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    where = stored(where, "placed")
    sizes = where.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("key").agg(F.sum("m").alias("size"), F.max(F.struct("m", "component")).alias("x"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    # Written first, so that a bucket with many members can be split in the join.
    mixed = stored(mixed.select("key", "size", F.col("x.component").alias("largest")), "mixed")
    return stored(where.join(mixed, "key"), "apart")


def cluster(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    small_batches(spark)
    sketched = stored(sketches(docs, words), "sketches")
    classes = stored(sketched.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    leading = classes.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key"))
    # Apart from the count, so that a bucket with many members can be split in the join.
    buckets = stored(leading.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    with bloom_filters(spark):
        members = stored(leading.join(buckets.where("size > 1"), "key").select("key", "doc_id", "lead", "size"), "members")
    tried = stored(members.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    ends = stored(tried.select("a").union(tried.select("b")).distinct().select(F.col("a").alias("doc_id"), F.lit(1).alias("chosen")), "ends")
    chosen = ends.where("chosen = 1").select("doc_id")
    known = F.when(F.min("set_hash") == F.max("set_hash"), F.min("parity")).alias("parity")
    with bloom_filters(spark):
        texts = stored(docs.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
        maps = stored(sketched.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("n_shingles").alias("n"), known), "maps")

    def linked(pairs: DataFrame) -> DataFrame:
        with bloom_filters(spark):
            return stored(confirm(pairs, texts, words), "links")

    links = linked(stored(may_link(tried, maps), "pairs"))
    found = components(links)
    members = members.where("size > 2").select("key", "doc_id", "lead").join(maps, "doc_id")
    apart, nearest = still_apart(members, found), True
    while not apart.isEmpty():
        candidates = across(apart, nearest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        untried = stored(candidates.join(tried, ["a", "b"], "left_anti"), "untried")
        n = untried.count()
        more = linked(untried) if n else untried
        m = more.count()
        if m:
            links = links.union(more)
            found = components(links)
        if not nearest:
            break
        nearest, tried = m > PAYS * n, tried.union(untried)
        if m:
            apart = still_apart(members, found)

    whole = classes.select("set_hash", "rep").join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    # An empty set has no class; under a key of its own it does not meet the others in one task.
    own = F.coalesce("set_hash", F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")).alias("set_hash")
    return sketched.select("doc_id", "n_shingles", own).join(whole, "set_hash", "left").select("doc_id", "n_shingles", component)


#: Bits at most, and for each id, of the map by which ids are looked for before a join.
MAP_BITS, EACH = 1 << 26, 16


def apart_from(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose doc_id is not among ids for sure, and all others. By a map of a
    bit for each hash of an id; it has at most MAP_BITS / 64 rows, which are broadcast.
    The more ids there are for it, the more rows are among the others."""
    size = min(MAP_BITS, max(1 << 12, 1 << (EACH * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {size}) % 64 as int))")
    words = ids.groupBy(word.alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(doc_id), {size}) % 64 as int)))").alias("bits"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), word.alias("word"), bit.alias("bit"))
    marked = row.join(F.broadcast(stored(words, "words")), "word", "left")
    among = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return marked.where(~among).select("row.*"), marked.where(among).select("row.*")


def deduplicated(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest
    id; of rows with the same id and text one stays. Rows without an id are compared
    like others, and come after all ids; they leave without one."""
    nameless, columns, top = docs.where("doc_id is null"), docs.columns, None
    if not nameless.isEmpty():
        top = max(docs.agg(F.max("doc_id")).first()[0] or 0, 0)
        nameless = stored(nameless.withColumn("doc_id", F.monotonically_increasing_id() + F.lit(top + 1)), "nameless")
        docs = docs.where("doc_id is not null").union(nameless)
    found = cluster(docs, words).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.expr("doc_id = component_id")).alias("first"))
    # All other ids stay as they are, and their texts where they are.
    touched = stored(found.where("rows > 1 or not first"), "touched")
    untouched, rest = apart_from(docs, touched)
    repeated = rest.join(touched.where("first"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    kept = untouched.union(rest.join(touched, "doc_id", "left_anti").select(columns)).union(repeated.select(columns))
    return kept if top is None else kept.withColumn("doc_id", F.when(F.col("doc_id") <= top, F.col("doc_id")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "documents"), 2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
