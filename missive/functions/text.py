"""Text normalization and cutting, in Catalyst expressions. Null texts count as empty unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tokens are runs of letters and digits, subjects lose these prefixes.
TOKEN = r"[\p{L}\p{N}]+"
REPLY = r"^((re|fw|fwd|aw|sv)\s*:\s*)+"
# A line that begins earlier text or a signature.
BOUNDARY = r"(?i)^(>.*|-{2,}\s*(original message|forwarded message|forwarded by)\b.*|on .{4,}\s+wrote:\s*|from:\s+\S.*|--\s*)$"
# Slots of a template, in the order they are filled.
SLOTS = (
    (r"https?://\S+|www\.\S+", "<url>"), (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "<email>"),
    (r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b", "<date>"), (r"\b\d+([.,]\d+)*\b", "<number>"),
)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def plain_lines(c: Column) -> Column:
    """CRLF and CR as LF, no-break spaces as spaces, zero-width characters removed."""
    s = F.regexp_replace(text(c), r"\r\n?", "\n")
    return F.translate(s, "  ​﻿", "  ")


def collapsed(c: Column) -> Column:
    """Lower case with runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " "))


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """Compatibility forms composed (NFKC) and case folded; Spark has neither, so texts go through Arrow once. Null as empty."""
    return s.map(lambda x: "" if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold())


def squeezed(c: Column) -> Column:
    """Text with runs of white space, as Unicode has it, as one space, and none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def words_of(c: Column) -> Column:
    """The runs of letters and digits in a text that is folded already."""
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"))


def subject_of(c: Column) -> Column:
    """The words of a folded subject without its reply and forward prefixes."""
    return F.array_join(words_of(F.regexp_replace(squeezed(c), REPLY, "")), " ")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(f"({TOKEN})"))


def subject_key(c: Column) -> Column:
    """The words of a subject without its reply and forward prefixes."""
    return F.array_join(tokens(F.regexp_replace(F.trim(F.lower(text(c))), REPLY, "")), " ")


def authored(c: Column) -> Column:
    """The text before the first line, not counting the first, that begins earlier text or a signature."""
    lines = F.split(plain_lines(c), "\n")
    cut = F.array_position(F.transform(lines, lambda x, i: (i > 0) & F.trim(x).rlike(BOUNDARY)), F.lit(True))
    kept = F.when(cut > 0, F.slice(lines, F.lit(1), (cut - 1).cast("int"))).otherwise(lines)
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", ""))


def template(c: Column) -> Column:
    """collapsed() with addresses, links, dates and numbers as slots."""
    s = collapsed(c)
    for pattern, slot in SLOTS:
        s = F.regexp_replace(s, pattern, slot)
    return s


def addresses(c: Column) -> Column:
    """The distinct mail addresses in a text, in lower case, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"([a-z0-9._%+'-]+@[a-z0-9.-]+\.[a-z]{2,})")))


def shingles(words: Column, k: int = 5) -> Column:
    """The distinct windows of k words, joined by spaces; none for fewer words."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    return F.when(n >= k, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text(c)) + F.length(F.regexp_replace(text(c), r"[^\x{10000}-\x{10FFFF}]", ""))


def rank_key(seed: str, *parts: Column) -> Column:
    """A deterministic random order: the hex digest of the seed and the parts, in which text order is number order."""
    return F.sha2(F.concat_ws("\u0000", F.lit(seed), *[p.cast("string") for p in parts]), 256)
