"""Identifiers as they are compared: case, blanks, brackets and stand-ins for no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for no value.
NO_VALUE = (
    "", "-", "--", "0", "?", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "(none)", "(null)", "<none>", "<null>",
    "undefined", "unknown", "unspecified", "und", "tbd", "xx", "xxx",
)

BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0            ​    　﻿"


def squeezed(c: Column) -> Column:
    """Lower case, without outer blanks of any kind."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def valued(c: Column) -> Column:
    """The identifier in lower case without outer blanks; null if it stands for no value."""
    s = squeezed(c)
    return F.when(~s.isin(*NO_VALUE), s)


def bare(c: Column) -> Column:
    """As valued(), also without outer angle brackets; what stands for no value inside them is null too."""
    return valued(F.btrim(c, F.lit(BLANKS + "<>")))


def packed(c: Column) -> Column:
    """Lower case without any blanks; null if it stands for no value."""
    s = F.lower(F.translate(c, BLANKS, ""))
    return F.when(~s.isin(*NO_VALUE), s)


def message_ids(c: Column) -> Column:
    """The distinct message ids named in a text (bare, a JSON list, or a references line), normalised.

    Ids are what stands between brackets, quotes, commas and blanks and holds an at-sign. Null gives no ids.
    """
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\s\u00a0\u200b<>\[\]\",;]+")
    return F.array_distinct(F.filter(parts, lambda x: x.contains("@")))
