"""Extra columns, whatever their names, change no result."""

import pytest
from pyspark.sql import functions as F

from missive.llm.authored import authored
from missive.llm.consensus import usable
from missive.llm.conversations import conversations
from missive.llm.groups import consolidate
from missive.llm.language import fit, languages
from missive.llm.leakage import leaked
from missive.llm.packing import pack, token_counts
from missive.llm.pii import found
from missive.llm.splits import related, units
from missive.session import Cut

NAMES = ("node", "component", "label", "rec", "key", "_key", "rank", "mask", "last", "text2", "told", "_run", "_pos", "first", "at", "m", "n", "row", "word", "declared", "instant", "wall", "_s", "_zone")


def wide(df):
    return df.withColumns({n: F.lit(1) for n in NAMES if n not in df.columns})


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def mails(spark):
    schema = "source_id string, source_name string, thread_id string, message_id string, in_reply_to string, references_json string, subject string, sender string, recipients_json string, sent_timestamp string, body_raw string, imported_at timestamp_ntz"
    data = [("a", "s", "t", "<1@x>", None, None, "Plan", "A <a@x.example>", '["b@x.example"]', "2020-01-01 10:00", "Hello Bob.\n-- \nA"), ("b", "s", "t", "<2@x>", "<1@x>", "", "Re: Plan", "b@x.example", '["a@x.example"]', "2020-01-02T10:00Z", "On 1/1/2020, A wrote:\n> Hello Bob.\n\nFine."), ("c", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame([(*r, None) for r in [*data, data[0]]], schema)


def test_mail_operators(spark, mails):
    clocks = spark.createDataFrame([("s", "Europe/Berlin", True)], "source_name string, home_zone string, day_first boolean")
    done = [authored(f(mails), f(clocks), Cut(spark)) for f in (lambda x: x, wide)]
    assert rows(done[0]) == rows(done[1]) == ["Row(source_id='a', told=[2, 3], n_own=1)", "Row(source_id='b', told=[1, 2], n_own=1)", "Row(source_id='c', told=[], n_own=0)"]
    times = spark.createDataFrame([("a", 1), ("b", 2)], "row_id string, utc_micros long")
    got = [rows(conversations(f(mails), f(times), f(done[0]), Cut(spark))) for f in (lambda x: x, wide)]
    assert got[0] == got[1] and len(got[0]) == 2
    assert rows(found(mails)) == rows(found(wide(mails)))
    for f in (lambda x: x, wide):
        assert authored(f(mails.limit(0)), clocks.limit(0), Cut(spark)).count() == 0


def test_other_operators(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "en"), (2, None, None), (1, "one two three four five six seven eight nine ten", "en")], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(7, "two three four five six seven eight nine")], "item_id long, passage string")
    tree = fit([("en", "one two three four five six"), ("de", "eins zwei drei vier fünf sechs")])
    records = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "record_id string")
    links = spark.createDataFrame([("X", "y")], "left_id string, right_id string")
    ties = spark.createDataFrame([("x", "k"), ("z", "k")], "record_id string, key string")
    reviews = spark.createDataFrame([("s", "u", '{"labels":["MEETING"]}', "submitted", 1)], "source_id string, user_id string, annotation_json string, status string, revision int")
    sizes = spark.createDataFrame([(1, 5), (2, 7)], "doc_id long, n_tokens int")
    for one in (
        lambda f: leaked(f(docs), f(items)), lambda f: languages(f(docs), tree), lambda f: consolidate(f(records), f(links), Cut(spark)), lambda f: units(related(f(records), f(ties), Cut(spark))).select("record_id", "unit_id"),
        lambda f: usable(f(reviews)), lambda f: pack(f(sizes), 10, Cut(spark)), lambda f: token_counts(f(docs)),
    ):
        plain = rows(one(lambda x: x))
        assert plain and plain == rows(one(wide))
