import os
from datetime import datetime
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from missive.operators.timestamps import choose_zones, histories, normalise, p7_zones, read_times, zone_scores
from missive.session import Cut

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

STATED = "source_name string, home_zone string, day_first boolean"
ROWS = "origin string, row_id string, source_name string, text string, message_id string, received long"


def micros(*args, tz="UTC", fold=0):
    return int(datetime(*args, tzinfo=ZoneInfo(tz), fold=fold).timestamp() * 1_000_000)


CASES = [
    ("2016-06-29T03:38:23Z", micros(2016, 6, 29, 3, 38, 23)), ("  2019-03-31t18:47:40.450140440z ", micros(2019, 3, 31, 18, 47, 40) + 450140), ("Wed, 7 Jun 2017 16:17:23 +0900", micros(2017, 6, 7, 7, 17, 23)),
    ("Thu, 18 Jun 2015 19:29:15 -0400 (EDT)", micros(2015, 6, 18, 23, 29, 15)), ("24/09/2019 11:57:03 CEST", micros(2019, 9, 24, 9, 57, 3)), ("05/10/2015 06:15 PM", micros(2015, 10, 5, 18, 15, tz="Europe/Berlin")),
    ("12.03.2017 11:16", micros(2017, 3, 12, 11, 16, tz="Europe/Berlin")), ("Mon Nov  2 02:19:46 2020", micros(2020, 11, 2, 2, 19, 46, tz="Europe/Berlin")), ("April 23, 2022 at 12:16 AM", micros(2022, 4, 23, 0, 16, tz="Europe/Berlin")),
    ("15-JUL-2019 02:13:26", micros(2019, 7, 15, 2, 13, 26, tz="Europe/Berlin")), ("20160511T234514Z", micros(2016, 5, 11, 23, 45, 14)), ("1598185792", 1598185792 * 10**6), ("1459058878395", 1459058878395 * 1000), ("1604491055531558", 1604491055531558),
    ("2020-05-22 18:20:16+09:00 Asia/Tokyo", micros(2020, 5, 22, 9, 20, 16)), ("2020-05-22T18:20:16+09:00[Asia/Tokyo]", micros(2020, 5, 22, 9, 20, 16)), ("2020-05-22 18:20:16 Asia/Tokyo", micros(2020, 5, 22, 9, 20, 16)),
    ("2019-10-27 02:30:00", micros(2019, 10, 27, 2, 30, tz="Europe/Berlin", fold=0)), ("2017-01-02", micros(2017, 1, 2, tz="Europe/Berlin")), ("6/12/18 6:36 pm", micros(2018, 12, 6, 18, 36, tz="Europe/Berlin")),
    ("2019-02-30T10:00:00Z", None), ("31/31/2018 25:61", None), ("0000-00-00 00:00:00", None), ("yesterday", None), ("n/a", None), ("", None), (None, None), ("2018-13-04 09:15", None), ("10:00", None), ("2020-01-01 10:00 QQQ", None), ("9" * 4000, None),
]


def test_notations(spark):
    rows = spark.createDataFrame([("e", str(i), "a", t, None, None) for i, (t, _) in enumerate(CASES)], ROWS)
    stated = spark.createDataFrame([("a", "Europe/Berlin", True), ("a", "Europe/Berlin", True)], STATED)
    times = Cut(spark).keep(read_times(rows.withColumn("extra", F.lit(1)), stated))
    zones = choose_zones(zone_scores(times, ["Europe/Berlin"]), stated)
    got = {r["row_id"]: r["utc_micros"] for r in normalise(times, zones).collect()}
    assert got == {str(i): v for i, (_, v) in enumerate(CASES) if v is not None}


def test_zone_is_estimated_from_receipt_and_copies(spark):
    rows, zone = [], ZoneInfo("America/Denver")
    for k in range(40):
        t = datetime(2020, 1 + k % 12, 1 + k % 27, 9, 5, tzinfo=zone)
        rows.append(("e", f"e{k}", "lab", t.strftime("%Y-%m-%d %H:%M:%S"), f"m{k}", int(t.timestamp() * 1e6) + 60_000_000))
        if k % 3 == 0:
            rows.append(("p", f"p{k}", "other", t.astimezone(ZoneInfo("UTC")).strftime("%Y-%m-%dT%H:%M:%SZ"), f"m{k}", None))
    none = spark.createDataFrame([], STATED)
    times = Cut(spark).keep(read_times(spark.createDataFrame(rows, ROWS), none))
    chosen = choose_zones(zone_scores(times, ["America/Denver", "UTC", "Europe/Berlin", "America/Chicago", "America/Los_Angeles"]), none)
    assert [(r["zone"], r["violations"]) for r in chosen.where("source_name = 'lab'").collect()] == [("America/Denver", 0)]


@pytest.mark.parametrize("candidates", [["UTC"], []])
def test_empty(spark, candidates):
    times = Cut(spark).keep(read_times(spark.createDataFrame([], ROWS), spark.createDataFrame([], STATED)))
    assert normalise(times, choose_zones(zone_scores(times, candidates), spark.createDataFrame([], STATED))).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_withheld_zones_are_found_among_all(spark):
    got = p7_zones(spark, SF).collect()
    assert len(histories()) > 200 and len(got) >= 10
    assert all(r["violations"] <= r["home_violations"] for r in got) and all(r["violations"] <= 1 + r["rows_compared"] // 500 for r in got)
