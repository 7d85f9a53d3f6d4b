"""Entity ids: arrays of strings, and their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(parts: Column) -> Column:
    """Injective text key: each part as <bytes>:<part>;"""
    return F.array_join(F.transform(parts, lambda p: F.concat(F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(";"))), "")


def has_prefix(parts: Column, prefix: list[str]) -> Column:
    want = F.array(*map(F.lit, prefix)) if prefix else F.expr("cast(array() as array<string>)")
    return F.slice(parts, 1, len(prefix)) == want if prefix else F.lit(True)


def escaped(parts: Column, sep: str) -> Column:
    """Parts joined by sep; backslash and sep in them are escaped."""
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit(sep), F.lit("\\" + sep))), sep)


def parse_escaped(text: str, sep: str) -> list[str]:
    parts, now, i = [], "", 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            now += text[i + 1]
            i += 2
            continue
        if c == sep:
            parts.append(now)
            now = ""
        else:
            now += c
        i += 1
    return [*parts, now]


def display(parts: Column) -> Column:
    return F.to_json(parts)


def base64url(text: Column) -> Column:
    return F.translate(F.rtrim(F.base64(F.encode(text, "utf-8")), F.lit("=")), "+/\r\n", "-_")


def padded(sequence: Column) -> Column:
    return F.lpad(sequence.cast("string"), 20, "0")
