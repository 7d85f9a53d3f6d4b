"""Personal data in texts: patterns propose spans, checks confirm them, nearby
words move their score.

Kinds email, ip, card and phone are proposed leftmost first, without overlap, and
kept if they pass their check (parts at most 255, Luhn, number of digits). The
further kinds iban (mod 97), ssn and key (an assigned secret) need their check and
a score of at least ``THRESHOLD``. All patterns run in time linear in the text.

Offsets count code points, ends are exclusive. Null text counts as empty: no
spans. Repeated rows give repeated rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "key")
#: Score of a confirmed span without context; what a context word that begins and ends within WINDOW characters before or behind adds (words against it count before only); least score of the further kinds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "key": 0.6}
CONTEXT = {
    "email": {"mail", "email", "mails", "contact", "write", "reach"}, "ip": {"ip", "ips", "ipv4", "host", "address", "server", "ping", "login"},
    "card": {"card", "cards", "visa", "mastercard", "credit", "debit", "payment", "pay"}, "phone": {"phone", "telephone", "tel", "call", "fax", "mobile", "cell", "dial"},
    "iban": {"iban", "account", "bank", "transfer"}, "ssn": {"ssn", "social", "security"}, "key": {"key", "api", "token", "secret", "password", "credentials"},
}
AGAINST = {"example", "examples", "sample", "test", "version", "isbn", "order"}
NEAR = re.compile(r"[a-z0-9]+")
WINDOW, RAISE, LOWER, THRESHOLD = 40, 0.15, 0.2, 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
#: A run of digits is entered at its begin only: if a match fails there, it fails further on.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: As far as an IBAN may go; where it ends, ``ibans`` decides.
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+))")
WORD_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
#: Characters of an IBAN, by country.
IBAN_SIZE = {c: int(n) for n, codes in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT "
    "26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC").split()) for c in codes.split(",")}  # fmt: skip
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
KEY = re.compile(r"(?i)(?<![a-z])(?:api_key|token|secret|password)\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9_/+-]{16,}+)")
NOT_DIGITS = {i: None for i in range(128) if not 48 <= i < 58}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The part before an @ is a run of its characters, behind the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of the ends of words that an IBAN may have, its country's length is tried
    first, then the longest."""
    done = 0
    for m in IBAN.finditer(text):
        if (start := m.start()) < done:
            continue
        ends = [(len(text[start : w.end()].replace(" ", "")), w.end()) for w in WORD_END.finditer(text, start, m.end(1) + 1) if w.end() <= m.end(1)]
        size = IBAN_SIZE.get(text[start : start + 2])
        for n, end in sorted(ends, key=lambda x: (x[0] != size, -x[0])):
            if n >= 15 and mod97(text[start:end].replace(" ", "")):
                done = end
                yield start, end
                break


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that passed their check."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := m[0].translate(NOT_DIGITS)) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(m[0].translate(NOT_DIGITS)) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", m.start(), m.end()
    for m in KEY.finditer(text):
        if any(c.isdigit() for c in m[1]):
            yield "key", m.start(1), m.end(1)


def words_near(text: str, begin: int, end: int) -> set[str]:
    """The words of text[begin:end] that neither end cuts in two; parts of a name joined by _ are words."""
    while begin < end and begin and text[begin - 1].isalnum() and text[begin].isalnum():
        begin += 1
    while begin < end and end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end -= 1
    return set(NEAR.findall(text[begin:end].lower()))


def find(text: str) -> list[Span]:
    """All spans, by start, then kind in the order of KINDS."""
    spans = []
    for kind, start, end in proposed(text):
        near, behind = words_near(text, max(0, start - WINDOW), start), words_near(text, end, min(len(text), end + WINDOW))
        score = PRIOR[kind] + RAISE * (not CONTEXT[kind].isdisjoint(near | behind)) - LOWER * (not AGAINST.isdisjoint(near))
        if kind in BASE or score >= THRESHOLD:
            spans.append(Span(kind, start, end, round(min(1.0, max(0.0, score)), 4)))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the kind of its first."""
    out, done = [], 0
    for s in spans:
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join(out) + text[done:]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>> of each row."""

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            spans = [[s._asdict() for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the personal data in column text replaced; other columns stay as they are."""
    at = docs.columns.index("text")

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [t if t is None else redact(t, find(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [find(t) for t in b.column(1).to_pylist()]
            base = [[s for s in f if s.kind in BASE] for f in found]
            counts = [pa.array([sum(s.kind == k for s in f) for f in base], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string())
            top = pa.array([max((s.score for s in f), default=0.0) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array(map(joined, found), pa.string()), top], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double"
    names = [x.split()[0] for x in schema.split(", ")]
    return table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
