"""Toxicity through a noisy channel.

Words may come disguised: letters written as look-alikes, drawn out, or spaced
apart. A suspicious token becomes a lattice of the letters each of its characters
may stand for (or nothing, or at a separator a word's end); the Viterbi path under
a character trigram model of the corpus, with the channel's costs, is the restored
word, or words. Restored text is then
scored: words and their beginnings carry the share of toxic documents among the
training documents that hold them, shrunk towards the base rate; a document's
score is that of at least one of its words being meant (noisy or).

The trigram counts cover all documents, the counts of words at most ``LABELLED``
labelled ones, from which labels are learnt. A feature is kept if a document that
holds it and nothing else would be rejected, if its counts are surer than the number
of features looked at explains, and if it is beyond doubt or needed beside better ones. What reaches
the driver is bounded: 27**3 trigram counts, and the kept features of at most
``LABELLED`` documents.

Null and empty texts have no words and the base score; repeated rows count
repeatedly; rows without an id are scored but not learnt from; without labels all
scores are 0. ``apply`` keeps all columns, whatever their names, and the caller
names the score's.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import id_crc, label_sample, small_batches, stored, table, text_of, unused

#: Labelled rows learnt from, at most; documents a feature needs; pseudo-documents at the base rate; features a task counts before it passes them on.
LABELLED, LEAST, SHRINK, COUNTED = 60_000, 4, 2.0, 100_000
#: Characters that are compared as whole arrays at once, about.
TOGETHER = 300_000
#: Nats by which a feature's likelihood ratio must exceed the logarithm of the number of features tried;
#: documents that it alone explains.
SURE, NEW = 2.0, 2
#: Pseudo-documents at the base rate, and the share beside them, for a feature to be kept whatever others explain.
DOUBT, STRONG = 8.0, 0.9
CUT = 0.7
#: What a character may stand for besides itself (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
#: Nats: for a look-alike, for leaving a character out, for each letter of a run left out, for one of two.
ALIKE, SKIP, SHORTEN, SINGLE = 0.5, 9.0, 0.3, 8.0
#: Nats for a word's end at a separator that is no wider than the token's others.
BREAK = 1.0
LETTER, SYMBOL = r"[^\W\d_]", re.escape("".join(LEET))
#: Letters or look-alikes apart, one or two separators between them; or letters with look-alikes around them, or joined by dots and the like.
UNIT = rf"(?:{LETTER}|[{re.escape(''.join(LEET).replace('*', ''))}])"
SPACED = re.compile(rf"(?<![^\W_]){UNIT}(?![^\W_])(?:[ .\-_*]{{1,2}}+{UNIT}(?![^\W_])){{3,}}+")
TOKEN = re.compile(rf"{SPACED.pattern}|(?:(?<![{SYMBOL}])[{SYMBOL}]++|(?<!{LETTER})){LETTER}++(?:[{SYMBOL}.\-_]++{LETTER}++)*+[{SYMBOL}]*+")
#: What makes a token suspicious: a letter three times, letters that something joins, a look-alike before or behind two letters.
ODD = re.compile(rf"({LETTER})\1\1|{LETTER}[{SYMBOL}.\-_]+{LETTER}|[{SYMBOL}]{LETTER}{{2}}|{LETTER}{{2}}[{SYMBOL}]")
WORD = re.compile(LETTER + "+")
GAP = re.compile(r"[ .\-_*]")
#: Letters of beginnings; letters up to which a word stands for itself as a feature (longer ones: by a digest).
BEGINNINGS, PLAIN = (4, 5, 6), 40
#: Longest token that is remembered.
KNOWN = 200


def _fold(c: str) -> int:
    base = unicodedata.normalize("NFKD", c)[0].lower()
    return ord(base) - 96 if "a" <= base <= "z" else 0


_code = np.zeros(0x250, np.uint8)
for _i in range(0x250):
    _code[_i] = _fold(chr(_i)) if chr(_i).isalpha() else 0


def pieces(texts: list[str], most: int = TOGETHER) -> Iterator[list[tuple[int, str]]]:
    """The texts as lists of (number, piece), each list of about ``most`` characters.
    Pieces end behind a line's end, across which nothing is looked for."""
    some, held = [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = t.find("\n", at + most) + 1 if len(t) - at > most else 0
            part = t[at : end or len(t)]
            some.append((i, part))
            held += len(part)
            if held >= most:
                yield some
                some, held = [], 0
            if not end:
                break
            at = end
    if some:
        yield some


def letters(text: str) -> np.ndarray:
    """1 to 26 for Latin letters less their accents, else 0."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _code[np.where(points < 0x250, points, 0)].astype(np.int32)


def trigrams(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over all documents (very long ones in pieces of whole lines), each
    with two spaces before and behind, from 27**3 counts, as float32[27, 27, 27]."""

    def run(batches):
        total = np.zeros(27**3, np.int64)
        for b in batches:
            for group in pieces(b.column(0).to_pylist()):
                x = letters("  " + "  ".join([t for _, t in group]) + "  ")
                total += np.bincount(x[:-2] * 729 + x[1:-1] * 27 + x[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    n = np.zeros(27**3)
    for r in counted.collect():
        n[r.code] = r.n
    n = n.reshape(27, 27, 27) + 0.5
    return np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32)


def tokens(text: str, begin: int = 0, end: int | None = None) -> Iterator[str]:
    """Suspicious tokens of text[begin:end]."""
    for m in TOKEN.finditer(text, begin, len(text) if end is None else end):
        if ODD.search(m[0]) or SPACED.fullmatch(m[0]) and WORD.search(m[0]):
            yield m[0]


def lattice(token: str, breaks: bool) -> list[list[tuple[str, float]]]:
    """(letters, cost) of what each character, run or separator may stand for; with
    ``breaks``, a separator may also be a word's end, written as a space."""
    low = token.lower()
    gap = " .-_*" if SPACED.fullmatch(low) else ".-_"
    pieces = [m[0] for m in re.finditer(rf"[{re.escape(gap)}]+|([^{re.escape(gap)}])\1*", low)]
    narrow = min((len(x) for x in pieces if x[0] in gap), default=0)
    slots: list[list[tuple[str, float]]] = []
    for piece in pieces:
        c, run = piece[0], len(piece)
        if c in gap:
            if breaks:
                slots.append([("", 0.0), (" ", BREAK if run == narrow else 0.0)])
        elif c in LEET:
            slots.append([("", SKIP)] + [(a, ALIKE + SHORTEN * (run - 1)) for a in LEET[c]])
        elif c.isalpha() and (k := int(_code[ord(c)]) if ord(c) < 0x250 else 0):
            a = chr(96 + k)
            slots.append([(a, 0.0)] if run == 1 else [(a, SINGLE if run == 2 else SHORTEN * run), (a * 2, SHORTEN * (run - 2))])
    return slots


def restore(token: str, lm: np.ndarray, breaks: bool = False) -> str:
    """The Viterbi path through the token's lattice. A state is the last two letters,
    with the path to it as a chain."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(token, breaks):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for word, cost in options:
                x, y, s = a, b, score - cost
                for ch in word:
                    k = max(0, ord(ch) - 96)
                    s += float(lm[x, y, k])
                    x, y = y, k
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, (path, word) if word else path)
        best = new
    at, out = max(((s + float(lm[a, b, 0]), p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])[1], []
    while at:
        at, word = at
        out.append(word)
    return "".join(reversed(out))


def readings(token: str, lm: np.ndarray) -> set[str]:
    """Words the token may be: with and without its last look-alikes (they may be
    punctuation), in one and split where the model has a word end."""
    core, found = token if SPACED.fullmatch(token) else token.rstrip("".join(LEET)), set()
    for form in {token, core}:
        if form == token or ODD.search(form):
            found.add(restore(form, lm))
            if GAP.search(form):
                found.update(restore(form, lm, True).split())
    return found - {""}


class Restorer:
    """Restores texts; remembers tokens, within a bound."""

    def __init__(self, lm: np.ndarray, most: int = 30_000):
        self.lm, self.most, self.known = lm, most, {}

    def token(self, token: str) -> set[str]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = readings(token, self.lm)
            if len(token) <= KNOWN:
                self.known[token] = found
        return found

    def words(self, texts: list[str]) -> list[set[str]]:
        """The words of each text, as it stands and as restored."""
        found: list[set[str]] = [set() for _ in texts]
        for group in pieces(texts):
            for i, t in group:
                found[i].update(WORD.findall(t.lower()))
            parts = [t for _, t in group]
            for k, begin, end in suspects(parts):
                for token in tokens(parts[k], begin, end):
                    found[group[k][0]] |= self.token(token)
        return found


_letter = np.array([bool(re.fullmatch(LETTER, chr(i))) for i in range(0x250)] + [True])
_alnum = np.array([chr(i).isalnum() for i in range(0x250)] + [False])
_leet = np.array([chr(i) in LEET for i in range(0x250)] + [True])
_join = np.array([chr(i) in LEET or chr(i) in ".-_" for i in range(0x250)] + [True])
_gap = np.array([chr(i) in " .-_*" for i in range(0x250)] + [False])


def _runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(member.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def suspects(texts: list[str]) -> list[tuple[int, int, int]]:
    """Stretches (text, begin, end) that hold all suspicious tokens whole, found by
    whole-array comparison: runs of the characters a joined token is made of, with
    something odd in them, and runs of separators and single characters, three or
    more; those that touch are one. Two more characters follow each, by which a
    token's end is known."""
    points = np.frombuffer("\n\n\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    if len(points) < 2:
        return []
    small = np.minimum(points, 0x250)
    letter, leet, join, alnum = _letter[small], _leet[small], _join[small], _alnum[small]
    odd = np.zeros(len(points), bool)
    odd[1:] = join[:-1] & letter[1:]
    odd[:-1] |= letter[:-1] & leet[1:]
    odd[:-2] |= letter[:-2] & (points[:-2] == points[1:-1]) & (points[1:-1] == points[2:])
    single = letter | leet
    single[1:] &= ~alnum[:-1]
    single[:-1] &= ~alnum[1:]
    found = []
    for member, counted, least in ((letter | join, odd, 1), (single | _gap[small], single, 3)):
        begin, end = _runs(member)
        total = np.append(0, np.cumsum(counted))
        enough = total[end] - total[begin] >= least
        found.append((begin[enough], end[enough]))
    begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.append(True, begin[1:] > end[:-1])
    begin, end = begin[first], end[np.append(first[1:], True)]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(size + 3) - size - 3
    owner = np.searchsorted(begins, begin, side="right") - 1
    return list(zip(owner.tolist(), (begin - begins[owner]).tolist(), (end - begins[owner] + 2).tolist(), strict=True))


def features(words: set[str]) -> set[str]:
    """Words, and the beginnings of words, marked by a dash."""
    return {named(w) for w in words} | {w[:k] + "-" for w in words for k in BEGINNINGS if len(w) >= k}


def named(word: str) -> str:
    return word if len(word) <= PLAIN else word[:PLAIN] + hashlib.sha256(word.encode("utf-8", "replace")).hexdigest()


def learn(docs: DataFrame, labels: DataFrame, lm: np.ndarray, train) -> tuple[dict[str, float], float]:
    """{feature: share of toxic documents}, base rate; from documents with a training label."""
    sample = label_sample(labels, "toxic", train, LABELLED)
    if not sample:
        return {}, 0.0
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((lm, sample))

    def run(batches):
        model, known = sent.value
        restorer, counts = Restorer(model), {}
        for b in batches:
            mine = [(known[d], i) for i, d in enumerate(b.column(0).to_pylist()) if d in known]
            for lo in range(0, len(mine), 64):
                part = mine[lo : lo + 64]
                for (y, _), words in zip(part, restorer.words([b.column(1)[i].as_py() for _, i in part]), strict=True):
                    for f in features(words):
                        c = counts.setdefault(f, [0, 0])
                        c[y] += 1
                if len(counts) > COUNTED:
                    yield batch(counts)
                    counts = {}
        yield batch(counts)

    def batch(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["f", "n0", "n1"])

    base = sum(sample.values()) / len(sample)
    if not 0 < base < 1:
        return {}, base
    n = F.col("n0") + F.col("n1")
    gain = F.col("n1") * F.log(F.col("n1") / (n * base)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (n * (1 - base)))).otherwise(0.0)
    counted = (
        docs.select("doc_id", text_of().alias("text"))
        .mapInArrow(run, "f string, n0 long, n1 long")
        .groupBy("f")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(n >= LEAST)
        .withColumn("share", (F.col("n1") + F.lit(SHRINK * base)) / (n + F.lit(SHRINK)))
    )
    counted = stored(counted, "features")
    # Features in too few documents to be kept are not counted as looked at.
    least = math.log(max(1, counted.count())) + SURE
    enough = 1 - (1 - CUT) / (1 - base) if base < CUT else base
    rows = counted.where((F.col("n1") >= LEAST) & (F.col("share") >= enough)).withColumn("gain", gain).where(F.col("gain") >= least).orderBy(F.desc("gain"), "f").collect()
    shares = {r.f: r.share for r in rows}
    order = list(shares)  # best first
    number = {f: i for i, f in enumerate(order)}

    def held(batches):
        model, known = sent.value
        restorer = Restorer(model)
        for b in batches:
            mine = [i for i, d in enumerate(b.column(0).to_pylist()) if known.get(d)]
            for lo in range(0, len(mine), 64):
                words = restorer.words([b.column(1)[i].as_py() for i in mine[lo : lo + 64]])
                yield pa.RecordBatch.from_arrays([pa.array([sorted(number[f] for f in features(w) if f in number) for w in words], pa.list_(pa.int32()))], ["held"])

    strong = {r.f for r in rows if (r.n1 + DOUBT * base) / (r.n0 + r.n1 + DOUBT) >= STRONG}
    # Features of at most LABELLED documents. Of weaker features, one that explains fewer than NEW of the toxic ones that better ones leave unexplained is left out.
    left = [r.held for r in docs.select("doc_id", text_of().alias("text")).mapInArrow(held, "held array<int>").where(F.size("held") > 0).collect()]
    sent.unpersist()
    kept = strong | {order[i] for i in cover(left, [math.log(p / (1 - p)) for p in shares.values()])}
    return {f: p for f, p in shares.items() if f in kept}, base


def cover(rows: list[list[int]], weight: list[float]) -> list[int]:
    """Items chosen greedily by the weight of the rows that they are the first to
    explain; none that explains fewer than NEW. A row is looked at twice."""
    holding: dict[int, list[int]] = {}
    for k, row in enumerate(rows):
        for i in row:
            holding.setdefault(i, []).append(k)
    n = {i: len(ks) for i, ks in holding.items()}
    heap = [(-c * weight[i], i, c) for i, c in n.items()]
    heapq.heapify(heap)
    done, chosen = set(), []
    while heap:
        _, i, c = heapq.heappop(heap)
        if n[i] < NEW:
            continue
        if c != n[i]:  # others have explained some of its rows since
            heapq.heappush(heap, (-n[i] * weight[i], i, n[i]))
            continue
        chosen.append(i)
        for k in holding[i]:
            if k not in done:
                done.add(k)
                for j in rows[k]:
                    n[j] -= 1
    return chosen


def fit(docs: DataFrame, labels: DataFrame, train):
    """The model, broadcast: character model, features, base rate."""
    small_batches(docs.sparkSession)
    lm = trigrams(docs)
    shares, base = learn(docs, labels, lm, train)
    return docs.sparkSession.sparkContext.broadcast((lm, shares, base))


def judge(words: set[str], shares: dict[str, float], heads: set[str], base: float) -> float:
    """Noisy or over words; of a word's features the strongest counts. ``heads`` has
    the first four letters of all features."""
    doubt = 1 - base
    get = shares.get
    for w in words:
        if w[:4] in heads:
            doubt *= 1 - max(get(named(w), 0.0), *(get(w[:k] + "-", 0.0) for k in BEGINNINGS if len(w) >= k), 0.0)
    return 1 - doubt


def apply(docs: DataFrame, model, score: str = "score") -> DataFrame:
    """docs with a further column of the name ``score``, which none of theirs may have."""
    if unused(score, docs.columns) != score:
        raise ValueError(f"a column is named {score} already")
    at = docs.columns.index("text")

    small_batches(docs.sparkSession)

    def run(batches):
        lm, shares, base = model.value
        restorer, heads = Restorer(lm), {f[:4] for f in shares}
        for b in batches:
            scores = []
            for k in range(0, b.num_rows, 64):
                texts = [t or "" for t in b.column(at)[k : k + 64].to_pylist()]
                scores += [judge(words, shares, heads, base) for words in restorer.words(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def held_out():
    return id_crc() % 3 == 1


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    held = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return apply(docs, model).select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
