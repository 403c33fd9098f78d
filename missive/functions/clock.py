"""Instants out of mixed notations, in Catalyst expressions."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from missive.functions.ids import BLANKS

# Zone abbreviations in mail headers and their offsets in minutes.
ABBREVIATIONS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570,
    "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Months as mails write them, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

MICROS = 1_000_000
TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?m\.?)?"
ZONE = r"(?:\s*(z|[+-]\d{2}:?\d{2}|[a-z]{1,5}))?(?:\s*\([a-z ]+\)|\s*\[[a-z0-9_/+-]+\]|\s+[a-z]+(?:/[a-z_]+)+|\s+[a-z]{2,5})?"
WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
#: notation -> pattern over the lower-case text; groups: three date parts, then TIME's five, then the zone.
NOTATIONS = {
    "ymd": rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[t\s]+{TIME})?{ZONE}$",
    "slash": rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{TIME})?{ZONE}$",
    "dot": rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}})(?:,?\s+{TIME})?{ZONE}$",
    "dmy": rf"^{WEEKDAY}(\d{{1,2}})[-\s]+([a-z]{{3,9}})\.?[-,\s]+(\d{{4}}|\d{{2}})(?:,?\s+(?:at\s+)?{TIME})?{ZONE}$",
    "mdy": rf"^{WEEKDAY}([a-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{TIME})?{ZONE}$",
    "asc": rf"^{WEEKDAY}([a-z]{{3,9}})\s+(\d{{1,2}})\s+{TIME}(?:\s+(z|[+-]\d{{4}}|[a-z]{{1,5}}))?\s+(\d{{4}})$",
    "basic": r"^(\d{4})(\d{2})(\d{2})[t\s]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?(?:\s*(z|[+-]\d{2}:?\d{2}))?$",
}
#: notation -> groups of year, month, day, hour, minute, second, fraction, half of the day, zone (0: it has none).
GROUPS = {
    "ymd": (1, 2, 3, 4, 5, 6, 7, 8, 9), "slash": (3, 2, 1, 4, 5, 6, 7, 8, 9), "dot": (3, 2, 1, 4, 5, 6, 7, 8, 9),
    "dmy": (3, 2, 1, 4, 5, 6, 7, 8, 9), "mdy": (3, 1, 2, 4, 5, 6, 7, 8, 9), "asc": (9, 1, 2, 3, 4, 5, 6, 7, 8),
    "basic": (1, 2, 3, 4, 5, 6, 7, 0, 8),
}


def _number(c: Column, least: int, most: int, blank: int | None = None) -> Column:
    n = F.when(c != "", c.cast("int"))
    n = n if blank is None else F.coalesce(n, F.lit(blank))
    return F.when(n.between(least, most), n)


#: names of zones that the tables of this Python know.
ZONES = tuple(sorted(zoneinfo.available_timezones()))


def with_instant(df, text: str, day_first: str, zone: str, into: str = "utc_micros", wall: str = "_wall"):
    """Adds the instant that column ``text`` denotes, as microseconds since 1970, or null if it denotes none.

    Bare numbers count from 1970: seconds up to eleven digits, then milli-, micro- and nanoseconds. ``day_first``
    settles dates with slashes. Impossible dates, hours, minutes, offsets and unknown zone letters give null, digits
    beyond microseconds are dropped, and a missing time of day is midnight. Without a written zone the wall time
    counts in column ``zone`` (an IANA name; null: unknown instant): its first occurrence where it occurs twice, and
    moved on by the gap where it doesn't occur. ``wall`` keeps the wall time of rows without a zone. Stages stand in
    columns of their own, so that each pattern is matched once a row.
    """
    known = set(df.columns)
    df = df.withColumn("_s", F.lower(F.btrim(F.translate(F.col(text), "\u00a0\u2009\u202f", "   "), F.lit(BLANKS))))
    s, kind = F.col("_s"), F.col("_kind")
    form = F.lit(None).cast("string")
    for name in reversed(NOTATIONS):
        form = F.when(s.rlike(NOTATIONS[name]), F.lit(name)).otherwise(form)
    number = s.rlike(r"^-?\d+(?:\.\d+)?$") & ~s.rlike(r"^\d{1,2}\.\d{1,2}$|^(?:19|20)\d{6}$|^(?:19|20)\d{12}$")
    df = df.withColumn("_kind", F.when(number, F.lit("number")).otherwise(form))

    told = F.lit(None).cast("string")
    for name, groups in GROUPS.items():
        told = F.when(kind == name, F.regexp_replace(s, NOTATIONS[name], "|".join(f"${g}" if g else "" for g in groups))).otherwise(told)
    df = df.withColumn("_pt", F.split(told, r"\|", -1))
    p = [F.col("_pt")[k] for k in range(9)]
    swap = (kind == "slash") & ~F.coalesce(F.col(day_first), F.lit(False))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(p[1], 1, 3)).cast("string")
    words = kind.isin("dmy", "mdy", "asc")
    month = F.when(words, named).when(swap, p[2]).otherwise(p[1])
    day = F.when(swap, p[1]).otherwise(p[2])
    year = _number(p[0], 0, 9999)
    year = F.when(F.length(p[0]) == 2, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year)
    half = p[7]
    hour = F.when(half == "", _number(p[3], 0, 23, 0)).otherwise(_number(p[3], 1, 12) % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second = _number(p[4], 0, 59, 0), _number(p[5], 0, 60, 0)
    frac = F.rpad(F.substring(p[6], 1, 6), 6, "0").cast("int")
    date = F.when(
        F.when(year > 0, year).isNotNull() & _number(month, 1, 12).isNotNull(),
        F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"),
    )
    at = F.unix_date(date).cast("long") * 86400 + hour * 3600 + minute * 60 + second
    df = df.withColumn("_w", at * MICROS + F.coalesce(frac, F.lit(0)))
    z = p[8]
    digits = F.regexp_replace(z, r"[^0-9]", "")
    signed = F.when(
        z.rlike(r"^[+-]") & F.substring(digits, 1, 2).cast("int").between(0, 15) & F.substring(digits, 3, 2).cast("int").between(0, 59),
        (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")) * F.when(z.startswith("-"), -1).otherwise(1),
    )
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k.lower()), F.lit(v))])
    offset = F.coalesce(signed, F.try_element_at(table, z))
    number = F.when(kind == "number", F.regexp_extract(s, r"^(-?\d+)", 1))
    size = F.length(F.regexp_replace(number, "-", ""))
    whole = F.when(size <= 20, number.cast("decimal(20,0)"))
    micros = (
        F.when(size <= 11, whole * MICROS + F.coalesce(F.rpad(F.substring(F.regexp_extract(s, r"\.(\d+)$", 1), 1, 6), 6, "0").cast("int"), F.lit(0)) * F.when(number.startswith("-"), -1).otherwise(1))
        .when(size <= 14, whole * 1000)
        .when(size <= 17, whole)
        .when(size <= 20, F.floor(whole / 1000))
        .cast("long")
    )
    named_zone = F.regexp_extract(F.col(text), r"([A-Z][A-Za-z]+(?:/[A-Z][A-Za-z_-]+)+)", 1)
    df = df.withColumn("_tz", F.when((z == "") & (named_zone != "") & (F.instr(F.lit(f"|{'|'.join(ZONES)}|"), F.concat(F.lit("|"), named_zone, F.lit("|"))) > 0), named_zone))
    df = df.withColumn(wall, F.when((z == "") & F.col("_tz").isNull(), F.col("_w")))
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("_w")), F.coalesce(F.col("_tz"), F.col(zone))))
    out = F.when(kind == "number", micros).when(z == "", local).otherwise(F.col("_w") - offset.cast("long") * (60 * MICROS))
    df = df.withColumn(into, out)
    return df.select(*[c for c in df.columns if c in known or c in (into, wall)])
