"""Mixed timestamps to one UTC instant, with missing zones estimated from the order of events."""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.clock import ZONES, with_instant
from missive.functions.ids import bare
from missive.session import Cut, table

#: A time without seconds may stand for any instant of its minute.
PRECISION = 60_000_000


def at_zone(wall: Column, zone: Column) -> Column:
    """Microseconds since 1970 of a wall time (microseconds, as if UTC) in an IANA zone."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def read_times(df: DataFrame, stated: DataFrame) -> DataFrame:
    """Rows (origin, row_id, source_name, text, message_id, received) with what their text says.

    Adds ``instant`` (texts with a zone, and numbers) or ``wall`` (texts without). ``stated`` gives day_first of a
    source; a source without it has its months first. Rows that say neither have both null; filter them once the rows
    are written, since a filter pushed through these stages would repeat each of them for every use.
    """
    order = stated.groupBy("source_name").agg(F.max("day_first").alias("_day_first"))
    df = df.join(order, "source_name", "left").withColumn("_zone", F.lit(None).cast("string"))
    df = with_instant(df, "text", "_day_first", "_zone", "instant", "wall")
    return df.drop("_day_first", "_zone", "text")


def zone_scores(times: DataFrame, candidates: list[str]) -> DataFrame:
    """(source_name, zone, rows_compared, violations) for each source and each zone that might be its own.

    A wall time read in the right zone lies neither after its row was received nor apart from the instant that
    another copy of the message (same message_id, other origin) states. Each row outside those bounds is a violation.
    A zone's rules are its offset history, so changes to daylight-saving time count. Rows are aggregated before any
    shuffle but that of the copies; a source with most of the rows costs no more than others.
    """
    copies = times.where("instant is not null and message_id is not null").groupBy("origin", "message_id").agg(F.min("instant").alias("copy"))
    copies = copies.select(F.col("origin").alias("_other"), "message_id", "copy")
    naive = times.where("wall is not null").select("origin", "source_name", "wall", "received", "message_id")
    pairs = naive.where("message_id is not null").join(copies, "message_id").where("origin <> _other")
    low, high = F.col("copy") - PRECISION, F.col("copy") + PRECISION
    checks = [naive.select("source_name", "wall", F.lit(None).cast("long").alias("low"), F.col("received").alias("high")).where("high is not null"), pairs.select("source_name", "wall", low.alias("low"), high.alias("high"))]
    checks = reduce(DataFrame.unionAll, checks)
    each = checks.select("source_name", "wall", "low", "high", F.explode(F.array(*map(F.lit, candidates)).cast("array<string>")).alias("zone"))
    utc = at_zone(F.col("wall"), F.col("zone"))
    wrong = F.coalesce(utc < F.col("low"), F.lit(False)) | F.coalesce(utc > F.col("high"), F.lit(False))
    return each.groupBy("source_name", "zone").agg(F.count("*").alias("rows_compared"), F.count_if(wrong).alias("violations"))


def choose_zones(scores: DataFrame, stated: DataFrame) -> DataFrame:
    """(source_name, zone, is_stated, rows_compared, violations): the offset history of each source.

    A stated home zone binds; otherwise the zone with the fewest violations wins, ties by name.
    """
    home = stated.groupBy("source_name").agg(F.max("home_zone").alias("home_zone"))
    both = scores.join(home, "source_name", "full")
    zone = F.coalesce("zone", "home_zone")
    fits = F.col("home_zone").isNull() | (zone == F.col("home_zone"))
    best = F.min(F.struct((~fits).alias("unfit"), F.coalesce("violations", F.lit(0)).alias("violations"), F.when(fits, zone).otherwise(F.col("home_zone")).alias("zone"), F.coalesce("rows_compared", F.lit(0)).alias("rows_compared"), F.col("home_zone").isNotNull().alias("is_stated")))
    out = both.groupBy("source_name").agg(best.alias("b"))
    return out.select("source_name", "b.zone", "b.is_stated", "b.rows_compared", "b.violations")


def normalise(times: DataFrame, zones: DataFrame) -> DataFrame:
    """(origin, row_id, utc_micros) of read_times() rows, distinct; wall times count in the source's chosen zone."""
    df = times.select("origin", "row_id", "source_name", "instant", "wall").join(zones.select("source_name", "zone"), "source_name", "left")
    utc = F.coalesce("instant", at_zone(F.col("wall"), F.col("zone")))
    return df.select("origin", "row_id", utc.alias("utc_micros")).where("utc_micros is not null").distinct()


def instants(rows: DataFrame, stated: DataFrame, cut: Cut) -> DataFrame:
    """normalise() of rows as read_times() takes them, their zones chosen from the same rows."""
    times = cut.keep(read_times(rows, stated)).where("instant is not null or wall is not null")
    return normalise(times, cut.keep(choose_zones(zone_scores(times, _candidates(times, stated)), stated)))


@cache
def histories() -> tuple[str, ...]:
    """One zone, the first by name, of each offset history since 1970 that the zones of this Python have, weekly."""
    weeks = [datetime.fromtimestamp(t, UTC) for t in range(0, 2_145_000_000, 7 * 86_400)]
    first: dict[tuple, str] = {}
    for name in ZONES:
        if "/" in name and not name.startswith(("Etc/", "SystemV/")):
            zone = zoneinfo.ZoneInfo(name)
            first.setdefault(tuple(t.astimezone(zone).utcoffset() for t in weeks), name)
    return tuple(sorted(first.values()))


def _candidates(times: DataFrame, stated: DataFrame) -> list[str]:
    """The zones that sources may have: those stated, and all histories() if some source with wall times states none."""
    zones = {r[0] for r in stated.select("home_zone").where("home_zone is not null").distinct().collect()}  # no more than there are zones
    open_ = times.where("wall is not null").select("source_name").distinct().join(stated.where("home_zone is not null"), "source_name", "left_anti")
    return sorted(zones | (set() if open_.isEmpty() else set(histories())))


def mail_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = table(spark, sf_dir, "emails").select(
        F.lit("emails").alias("origin"), F.col("source_id").alias("row_id"), "source_name", F.col("sent_timestamp").alias("text"),
        bare(F.col("message_id")).alias("message_id"), F.unix_micros(F.col("imported_at").cast("timestamp")).alias("received"),
    )
    parsed = table(spark, sf_dir, "parsed_messages").select(
        F.lit("parsed_messages").alias("origin"), F.col("email_id").alias("row_id"), "source_name", F.col("sent_at").alias("text"),
        bare(F.col("message_id")).alias("message_id"), F.lit(None).cast("long").alias("received"),
    )
    return read_times(mails.unionAll(parsed), table(spark, sf_dir, "source_clocks"))


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Cut]:
    cut = Cut(spark)
    return cut.keep(mail_times(spark, sf_dir)).where("instant is not null or wall is not null"), table(spark, sf_dir, "source_clocks"), cut


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value that denotes an instant: origin, row_id, utc_micros."""
    times, clocks, cut = _read(spark, sf_dir)
    return normalise(times, cut.keep(choose_zones(zone_scores(times, _candidates(times, clocks)), clocks)))


def p7_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone that each source's rows alone suggest, of all there are, beside the stated one, with the violations of both."""
    times, clocks, cut = _read(spark, sf_dir)
    none = clocks.limit(0)
    homes = {r[0] for r in clocks.select("home_zone").where("home_zone is not null").distinct().collect()}
    scores = cut.keep(zone_scores(times, sorted(homes | set(_candidates(times, none)))))
    guess = choose_zones(scores, none).select("source_name", F.col("zone").alias("estimated_zone"), "rows_compared", "violations")
    stated = scores.select("source_name", F.col("zone").alias("home_zone"), F.col("violations").alias("home_violations"))
    return guess.join(clocks.select("source_name", "home_zone"), "source_name", "left").join(stated, ["source_name", "home_zone"], "left")
