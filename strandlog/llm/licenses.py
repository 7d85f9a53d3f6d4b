"""License detection by ordered signature rules.

A rule has a keyword, a regular expression over words, a priority and a
confidence; ``license_rules`` has them, written by hand. One Aho-Corasick pass over the lower-cased text finds the keywords;
only rules whose keyword occurs are run. Of the detections, one that lies within
another of higher priority (or of equal priority and greater length, or as long
and earlier in the rules) is suppressed. The three base phrases are found at all
their places and their labels are never suppressed.

Words are runs of digits, lower-cased Latin letters and characters beyond ASCII.
Null text counts as empty: no words, no labels, score 0. Repeated rows give
repeated rows; other columns are left out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, text_of
from .license_rules import RULES

WORD = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"
GAP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

class Rule(NamedTuple):
    label: str
    keyword: str
    priority: int
    confidence: float
    regex: re.Pattern


class Found(NamedTuple):
    label: str
    start: int
    end: int
    rule: int


def compiled(expression: str) -> re.Pattern:
    """An expression of the rules, in which a blank is what lies between two words."""
    return re.compile(expression.replace("[ -]", GAP).replace(" ?", f"{GAP}*+").replace(" ", f"{GAP}++") + f"(?!{WORD})")


def build_rules(text: str = RULES) -> list[Rule]:
    """The rules, best first."""
    rules = []
    for line in text.split("\n"):
        if line and not line.startswith("#"):
            label, keyword, priority, confidence, expression = line.split(" | ", 4)
            rules.append(Rule(label, keyword, int(priority), float(confidence), compiled(expression)))
    return sorted(rules, key=lambda r: -r.priority)


_rules: tuple | None = None


def rules() -> tuple:
    """The rules, the automaton of their keywords and the base patterns; built once per worker."""
    global _rules
    if _rules is None:
        import ahocorasick

        ordered = build_rules()
        by: dict[str, list[int]] = {}
        for i, r in enumerate(ordered):
            by.setdefault(r.keyword, []).append(i)
        keywords = ahocorasick.Automaton()
        for k, ids in by.items():
            keywords.add_word(k, ids)
        keywords.make_automaton()
        _rules = ordered, keywords, {k: compiled(p) for k, p in BASE.items()}
    return _rules


def suppressed(found: list[Found], ordered: list[Rule]) -> list[Found]:
    """What is left, by start: a detection goes if a better one contains it. ``reach``
    is a tree of the farthest ends of better ones, by start."""
    starts = sorted({f.start for f in found})
    reach, kept = [0] * (len(starts) + 1), []
    for f in sorted(found, key=lambda f: (-ordered[f.rule].priority, f.start - f.end, f.rule, f.start)):
        i = at = bisect_right(starts, f.start)
        farthest = 0
        while i:
            farthest = max(farthest, reach[i])
            i &= i - 1
        if farthest >= f.end:
            continue
        kept.append(f)
        while at < len(reach):
            reach[at] = max(reach[at], f.end)
            at += at & -at
    return sorted(kept, key=lambda f: (f.start, f.end, f.rule))


_inside = re.compile(WORD).match


def places(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Matches that begin with a word. That is checked here, so that expressions may begin with what is searched for."""
    m = pattern.search(text)
    while m:
        start, end = m.span()
        if start and _inside(text, start - 1):
            end = start + 1
        else:
            yield start, end
        m = pattern.search(text, end)


def scan(text: str) -> tuple[list[Found], list[tuple[str, int]]]:
    """Detections left, and the places (label, offset) of the base phrases, in a lower-cased text."""
    ordered, keywords, base = rules()
    run = sorted({i for _, ids in keywords.iter(text) for i in ids})
    found = [Found(ordered[i].label, start, end, i) for i in run for start, end in places(ordered[i].regex, text)]
    return suppressed(found, ordered) if found else [], [(label, start) for label, p in base.items() for start, _ in places(p, text)] if "license" in text else []


_word = np.array([i >= 128 or 48 <= i < 58 or 97 <= i < 123 for i in range(129)])


def word_starts(text: str) -> np.ndarray:
    """Offsets of the words of a lower-cased text."""
    word = _word[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)]
    return np.flatnonzero(word & ~np.append(False, word[:-1]))


def examine(text: str) -> dict:
    """The columns of ``detect`` for one text."""
    low = text.encode("utf-8", "replace").lower().decode()
    starts = word_starts(low)
    found, phrases = scan(low)
    at = np.searchsorted(starts, [p for _, p in phrases]).tolist()
    ordered = rules()[0]
    sure: dict[str, float] = {}
    for f in found:
        sure[f.label] = max(sure.get(f.label, 0.0), ordered[f.rule].confidence)
    doubt = math.prod(1 - x for x in sure.values())
    base = sorted({label for label, _ in phrases})
    return {
        "n_words": len(starts), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *sure})),
        "score": max(1 - doubt, 0.8 * bool(at)), "detections": [{"label": f.label, "start": f.start, "end": f.end, "priority": ordered[f.rule].priority} for f in found],
    }


COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def detect(docs: DataFrame, *, detections: bool = True) -> DataFrame:
    """Per document: words, base phrases, labels, score; with ``detections``, also the
    spans (label, start, end, priority) left after suppression, in code points."""
    kinds = COLUMNS | ({"detections": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int64())]))} if detections else {})

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [examine(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in rows], t) for c, t in kinds.items())], ["doc_id", *kinds])

    schema = SCHEMA + ", detections array<struct<label:string,start:long,end:long,priority:long>>" * detections
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), detections=False)
