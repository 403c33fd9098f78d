import random
from datetime import datetime

import numpy as np
import pytest

from pyspark.sql import functions as F

from missive.llm.authored import DISTANCE, authored, bags, boilerplate, fingerprints, inherited, near_matches, sentences
from missive.llm.conversations import conversations, sessionized
from missive.llm.mailparts import parts
from missive.llm.pii import Finder, found, p6_masked
from missive.session import Cut

BODY = """Hi Ann,

New text of mine, on two
lines.
> 78% of it is older, which is the real worry.
Sent from the old scanner, the pages came out upside down.
On Tuesday the vendor wrote: no parts before June.

Best regards,
Tom Oakby
Planner | Cedar

Sent from my handset

On Wed, Jun 7, 2017 at 06:54, Ann Elm
<ann@x.example> wrote:
>
> Earlier text,
> of hers."""


def told(body):
    return [i for i, (s, k) in enumerate(parts(body), 1) if k and s]


def test_parts():
    assert told(BODY) == [9, 10, 11, 13, 15, 16, 18, 19]
    assert told("Mine.\n\n-----Original Message-----\nFrom: A B\nSent: x\nTo: c\n\nTheirs.\nAll of it.") == [3, 4, 5, 6, 8, 9]
    assert told("Am 20.08.2022 um 20:53 schrieb Ann Elm:\n> alt\n\nNeu von mir.") == [1, 2]
    assert told("a\r\nb\r> c\n") == [3] and told("") == told(None) == []
    assert told("| Marrow | 38 | 58 | is how the row should read.\nText.") == []
    assert told("AE> Hello\nAE> there\nYes.\n- Tom") == [1, 2, 4]
    assert told("x" * 300_000) == []


def test_simhash_is_close_for_close_sentences():
    base = "the steering meeting covers the load forecast the combined report and the open risks of the whole quarter".split()
    near, far = [*base[:-1], "year"], "please send the night shift two copies of every signed form before the crane permit lapses again today".split()
    a, b, c = (int(np.uint64(x)) for x in fingerprints([base, near, far]).view(np.uint64))
    assert bin(a ^ b).count("1") < bin(a ^ c).count("1") and fingerprints([base])[0] == fingerprints([far, base])[1] and len(fingerprints([])) == 0


LINES = "source_id string, line_no int, subject long, sender string, people array<string>, at long, print long, text string, last boolean"


def test_inherited(spark):
    s = "the steering meeting covers the load forecast the combined report and the open risks"
    near = 0b1011 ^ (1 << 20)
    rows = [
        ("m1", 1, 7, "a@x", 10, 0b1011, s, True), ("m2", 4, 7, "b@x", 20, near, s + " x", False), ("m3", 2, 8, "c@x", 30, 0b1011, s, False), ("m4", 1, 7, "a@x", 40, 0b1011, s, False),
        ("m5", 1, 7, "d@x", 50, ~0b1011, s, False), ("m6", 1, 7, "e@x", 60, 0b1011, "quite another text with the same print", False), ("m7", 3, 7, None, 5, 1 << 40, "alone", True),
    ]
    rows = [(*r[:4], ["b@x"] if r[0] == "m4" else ["a@x", "a@x"], *r[4:]) for r in rows] + [("m8", 5, 7, "h@x", ["b@x", "z@x"], 70, 0b1011, s, False), ("m9", 5, 7, "h@x", ["z@x"], 70, 0b1011, s, False)]
    rows += [(f"n{k}", 9, 100 + k, "z@x", [], k, 77, "our own motto at the end", True) for k in range(6)]
    got = {(r["source_id"], r["why"]) for r in inherited(*[spark.createDataFrame(rows, LINES)] * 2, Cut(spark)).collect()}
    assert got == {("m2", "inherited"), ("m4", "inherited"), ("m8", "inherited"), *((f"n{k}", "boilerplate") for k in range(6))} and DISTANCE >= 1
    assert inherited(*[spark.createDataFrame([], LINES)] * 2, Cut(spark)).count() == 0


MAILS = "source_id string, thread_id string, message_id string, in_reply_to string, references_json string, sender string, imported_at long"


def test_conversations(spark):
    rows = [
        ("a1", "t1", "<1@x>", None, "[]", "Ann <A@x.example>", 1), ("a2", None, "<2@x>", " 1@X ", None, "b@x.example", 2), ("a3", " T1", "<3@x>", None, '["<2@x>"]', "a@x.example", 3), ("a3", " T1", "<3@x>", None, '["<2@x>"]', "other", 9),
        ("b1", "none", "<4@x>", None, "", "a@x.example", 1), ("b2", "none", "<5@x>", None, "", "b@x.example", 1),  # no tie
        ("c1", "t2", "<6@x>", None, None, "a@x.example", 1), ("c2", "t2", "<7@x>", "<gone@x>", None, "b@x.example", 2),  # names a mail that isn't there
        ("d1", "t3", "<8@x>", None, None, "a@x.example", 1), ("d2", "t3", "<9@x>", None, None, "A <a@X.example>", 2),  # one sender
        ("e1", "t4", "<10@x>", None, None, "a@x.example", 1), ("e2", "t4", "<11@x>", None, None, None, 2),  # no sender
        ("f1", "t5", "<12@x>", None, None, "a@x.example", 1), ("f2", "t5", "<13@x>", "<12@x>", None, "b@x.example", 2),  # earlier than what it replies to
        ("g1", "t6", "<14@x>", None, None, "a@x.example", 1), ("g2", "t6", "<15@x>", None, None, "b@x.example", 2),  # nothing written
    ]
    at = {"a1": 10, "a2": 20, "a3": 20, "f1": 50, "f2": 40}
    mails = spark.createDataFrame(rows, MAILS)
    ids = sorted({r[0] for r in rows})
    times = spark.createDataFrame([(i, at.get(i, 100 + k)) for k, i in enumerate(ids)], "row_id string, utc_micros long")
    written = spark.createDataFrame([(i, 0 if i == "g2" else 1) for i in ids], "source_id string, n_own int")
    got = sorted(tuple(r) for r in conversations(mails, times, written, Cut(spark)).collect())
    assert got == [("a1", "a1", 1, 1), ("a2", "a1", 2, 2), ("a3", "a1", 3, 1)]
    assert conversations(mails.limit(0), times, written, Cut(spark)).count() == 0


TEXTS = [
    ("Ask T. Oakby or Will Elmstead.", [("T. Oakby", "NAME"), ("Will Elmstead", "NAME")]), ("Will the April figures hold? I hope so.", []), ("Hi April -", [("April", "NAME")]), ("Dr. Newman moved to PO Box 12, Dunwater last spring.", [("Newman", "NAME"), ("PO Box 12, Dunwater", "ADDRESS")]),
    ("use ann.elm [at] x.example instead, or mail <Bob@X.example>.", [("ann.elm [at] x.example", "EMAIL"), ("Bob@X.example", "EMAIL")]), ("use ann at mail dot x dot example now", [("ann at mail dot x dot example", "EMAIL")]), ("meet at noon dot", []),
    ("Cell (469) 555-0116, office +44 (0)20 7946 0498, 472-555-0106 ext. 686.", [("(469) 555-0116", "PHONE"), ("+44 (0)20 7946 0498", "PHONE"), ("472-555-0106 ext. 686", "PHONE")]), ("030/23125-663 and 01 99 00 85 91", [("030/23125-663", "PHONE"), ("01 99 00 85 91", "PHONE")]),
    ("Ticket #76899, invoice INV-2019-0681, build 9.5.4.533, part 0049-5923-A, 3 215 254 units, 2016-06-07 10:00, 06/06/2017 09:47", []), ("SSN 943-50-1692, NI no. QQ 95 58 79 C, passport Z6411870, DNI 00000073T", [("943-50-1692", "ID_NUMBER"), ("QQ 95 58 79 C", "ID_NUMBER"), ("Z6411870", "ID_NUMBER"), ("00000073T", "ID_NUMBER")]),
    ("at 59 bis, rue du Vieux Lavoir, 67553 Valbrune, please", [("59 bis, rue du Vieux Lavoir, 67553 Valbrune", "ADDRESS")]), ("Am Mühlgraben 63a, 18253 Falkenau", [("Am Mühlgraben 63a, 18253 Falkenau", "ADDRESS")]), ("Unit 40, 69 Saltmarsh Way, Ashcombe Bay", [("Unit 40, 69 Saltmarsh Way, Ashcombe Bay", "ADDRESS")]),
    ("ANN OAKBY, İstanbul", [("ANN OAKBY", "NAME")]), ("", []), (None, []), ("word " * 100_000 + "x@y.example", [("x@y.example", "EMAIL")]),
]


@pytest.mark.parametrize(("text", "want"), TEXTS)
def test_items(text, want):
    f = Finder({"ann", "april", "will", "hope"}, {"oakby", "elmstead"})
    assert [(text[a:b], k) for a, b, k in f.items(text)] == want


def test_found_by_both_routes(spark, monkeypatch):
    rows = [("1", "Ann Oakby <a@x.example>", '["\\"Elmstead, Will\\" <w@x.example>"]', "Ann and Will Elmstead"), ("2", None, None, None), ("3", "b@x.example", "junk", "")]
    df = spark.createDataFrame(rows, "source_id string, sender string, recipients_json string, body_raw string")
    first = sorted(tuple(r) for r in found(df).collect())
    assert first[0][1:3] == ([0, 8], [3, 21])
    monkeypatch.setattr("missive.llm.pii.MAX_NAMES", 0)
    assert sorted(tuple(r) for r in found(df).collect()) == first
    assert found(df.limit(0)).count() == 0


def test_parts_never_lose_lines():
    rnd = random.Random(1)
    pool = ["", ">", "> x", "--", "From: a", "To: b", "Subject: c", "Best,", "Tom", "On 1/1/2020, A B wrote:", "text here.", "____________", "|", "* A B [2020-01-01 10:00]:"]
    for _ in range(300):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 14))]
        assert len(parts("\n".join(lines))) == max(1, len(lines))


EMAILS = "source_id string, source_name string, thread_id string, message_id string, in_reply_to string, references_json string, subject string, sender string, recipients_json string, sent_timestamp string, body_raw string, imported_at timestamp_ntz"
CLOCKS = "source_name string, home_zone string, day_first boolean"


def told_of(spark, rows, only=None):
    """rows: (source_id, fields that differ from those of a plain mail of day n)."""
    plain = {"source_name": "s", "subject": "Plan", "sender": "a@x.example", "recipients_json": '["b@x.example"]'}
    names = [f.split()[0] for f in EMAILS.split(", ")]
    data = [tuple({**plain, "sent_timestamp": f"2020-01-{n:02d} 10:00", "imported_at": datetime(2020, 2, n), **r, "source_id": i}.get(k) for k in names) for n, (i, r) in enumerate(rows, 1)]
    done = authored(spark.createDataFrame(data, EMAILS), spark.createDataFrame([("s", "UTC", True)], CLOCKS), Cut(spark), only=only)
    return {r["source_id"]: (sorted(r["told"]), r["n_own"]) for r in done.collect()}


PASSED = "The crane permit covers the north yard until the end of the second week. Ask at the gate for the two spare keys before noon."
B = {"sender": "b@x.example", "recipients_json": '["a@x.example"]', "subject": "Re: Plan"}


def test_sentences_are_inherited_across_line_ends(spark):
    assert sentences([(1, "Hi Ann,"), (2, "One two"), (3, "three. Dr. Four"), (5, "five"), (6, "- six")]) == [(1, 1, "Hi Ann,"), (2, 3, "One two three."), (3, 3, "Dr. Four"), (5, 5, "five"), (6, 6, "- six")]
    wrapped = "Hi Ann,\nThe crane permit covers the north yard until\nthe end of the first week. Ask at the gate for the two spare\nkeys before noon.\nThis is mine."
    got = told_of(spark, [("m1", {"body_raw": PASSED + "\nHi Ann,\nNo drums."}), ("m2", {**B, "body_raw": wrapped}), ("m3", {**B, "body_raw": "Hi Ann,\nNo drums.\nNo drums here."})])
    assert got == {"m1": ([], 3), "m2": ([2, 3, 4], 2), "m3": ([2], 2)}


def test_prints_reach_the_edit_bound():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    far = []
    for n in (12, 15, 20, 30) * 100:
        a = [word() for _ in range(n)]
        b = list(a)
        b[rnd.randrange(n)] = word()
        x, y = fingerprints([a, b]).view(np.uint64)
        far.append(int(x ^ y).bit_count())
    assert np.mean(np.array(far) <= DISTANCE) > 0.99


def test_sentences_are_inherited_within_a_conversation(spark):
    to_c = {"sender": "b@x.example", "recipients_json": '["c@x.example"]', "body_raw": PASSED + "\nMine."}
    got = told_of(spark, [
        ("m1", {"body_raw": PASSED, "thread_id": "t1", "message_id": "<1@x>"}), ("m2", {**to_c, "subject": "Other", "thread_id": " T1"}), ("m3", {**to_c, "subject": "Other", "references_json": '["<1@x>"]'}),
        ("m4", {**to_c, "recipients_json": '["Ann Elm"]'}), ("m5", {**to_c, "recipients_json": None}), ("m6", {**to_c, "subject": "Other"}),
    ])
    assert got == {"m1": ([], 1), **{m: ([1], 1) for m in ("m2", "m3", "m4", "m5")}, "m6": ([], 2)}


def test_boilerplate_stands_anywhere_and_varies(spark):
    body = "The harbour office answers letters on working days between nine and four.\n{} is what I wrote.\nOur offices in the old mill stay closed for visitors until the {} of May this year.\nBye now, that is all of it."
    ordinals = ["first", "third", "fifth", "sixth", "ninth", "tenth"]
    got = told_of(spark, [(f"m{k}", {"subject": f"S{k}", "body_raw": body.format("x" * (k + 1), w)}) for k, w in enumerate(ordinals[:5])])
    assert got == {f"m{k}": ([1, 3], 2) for k in range(5)}
    got = told_of(spark, [(f"m{k}", {"subject": f"S{k}", "body_raw": body.format("x" * (k + 1), w)}) for k, w in enumerate(ordinals[:4])])
    assert got == {f"m{k}": ([], 4) for k in range(4)}


def test_masked_with_more_names_than_are_sent(spark, monkeypatch, tmp_path):
    rows = [("1", "Ann Oakby <a@x.example>", '["\\"Elmstead, Will\\" <w@x.example>"]', "Ann and Will Elmstead"), ("2", None, None, None)]
    spark.createDataFrame(rows, "source_id string, sender string, recipients_json string, body_raw string").write.parquet(f"{tmp_path}/emails.parquet")
    first = sorted(map(str, p6_masked(spark, str(tmp_path)).collect()))
    assert "body_raw='[NAME] and [NAME]'" in first[0]
    monkeypatch.setattr("missive.llm.pii.MAX_NAMES", 0)
    assert sorted(map(str, p6_masked(spark, str(tmp_path)).collect())) == first


def test_hot_parts_are_split_and_lose_nothing(spark, monkeypatch):
    rnd = random.Random(3)
    words = [["".join(rnd.choice("abcdefghijk") for _ in range(6)) for _ in range(14)] for _ in range(4)]
    rows = []
    for k in range(40):  # families of sentences that differ in a word, and some that stand alone
        w = list(words[k % 4]) if k < 32 else ["".join(rnd.choice("lmnopqr") for _ in range(6)) for _ in range(14)]
        w[k % 4] = f"number{k:02d}"
        rows.append((f"m{k:02d}", 1, 7, "a@x", [], k, int(fingerprints([w])[0]), " ".join(w), True))
    df = spark.createDataFrame(rows, LINES)
    plain = sorted(map(tuple, boilerplate(df, df, Cut(spark)).collect()))
    asked = df.select(F.lit(1).cast("long").alias("place"), F.col("at").alias("node"), "print", F.length("text").alias("size"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    pairs = sorted(map(tuple, near_matches(asked, asked, Cut(spark)).collect()))
    assert len(pairs) > 200 and len(set(pairs)) == len(pairs)
    monkeypatch.setattr("missive.llm.authored.HOT", 3)
    monkeypatch.setattr("missive.llm.authored.FIRST", 2)
    assert sorted(map(tuple, boilerplate(df, df, Cut(spark)).collect())) == plain and len(plain) >= 28 and all(i < "m32" for i, _ in plain)
    assert sorted(map(tuple, near_matches(asked, asked, Cut(spark)).collect())) == pairs


def test_tables_find_what_differs_in_a_word():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    met = []
    for n in (12, 15, 20, 30) * 100:
        a = [word() for _ in range(n)]
        b = list(a)
        b[rnd.randrange(n)] = word()
        x, y = fingerprints([a, b]).view(np.uint64)
        met.append(any(int(x ^ y) >> k & 0xFF == 0 for k in range(0, 64, 8)))
    assert np.mean(met) > 0.95


def test_mails_that_are_not_asked_about_are_told_by_form(spark):
    rows = [("m1", {"body_raw": PASSED}), ("m2", {**B, "body_raw": PASSED}), ("m3", {**B, "body_raw": PASSED})]
    assert told_of(spark, rows) == {"m1": ([], 1), "m2": ([1], 0), "m3": ([1], 0)}
    only = spark.createDataFrame([("m3",)], "source_id string")
    assert told_of(spark, rows, only=only) == {"m1": ([], 1), "m2": ([], 1), "m3": ([1], 0)}


def test_sessions_have_roles_and_replies(spark):
    kind = MAILS.replace("imported_at", "recipients_json string, imported_at")
    to = lambda *x: str(list(x)).replace("'", '"')
    rows = [("a1", None, "<1@x>", None, None, "Ann <a@x.example>", to("b@x.example"), 1), ("a2", None, "<2@x>", "<1@x>", None, "b@x.example", to("A@x.example"), 1), ("a3", None, "<3@x>", "<2@x>", None, "a@x.example", to("b@x.example"), 1), ("a4", None, "<4@x>", None, None, "a@x.example", to("b@x.example"), 1), ("b1", None, "<5@x>", None, None, None, None, 1)]
    times = spark.createDataFrame([("a1", 0), ("a2", 100), ("a3", 200), ("a4", 5000), ("b1", 0)], "row_id string, utc_micros long")
    mails = spark.createDataFrame(rows, kind)
    got = sorted((r["source_id"], r["session_no"], r["role"]) for r in sessionized(mails, times, Cut(spark)).collect())
    assert got == [("a1", 1, "opener"), ("a2", 1, "respondent"), ("a3", 1, "opener")]
    alone = sessionized(mails.withColumn("in_reply_to", F.lit(None).cast("string")), times, Cut(spark))
    assert {r["session_no"] for r in alone.collect()} == {1} and sessionized(mails.limit(0), times, Cut(spark)).count() == 0


def test_bags_bound_the_edits():
    rnd = random.Random(8)
    for _ in range(200):
        a = [rnd.choice("abcxyz éß𝛼,") for _ in range(rnd.randint(1, 60))]
        b = list(a)
        n = rnd.randint(0, 6)
        for _ in range(n):
            b[rnd.randrange(len(b))] = rnd.choice("abcxyz éß𝛼,")
        x, y = bags(["".join(a), "".join(b)]).view(np.uint8).astype(int)
        assert np.maximum(x - y, 0).sum() <= n and np.maximum(y - x, 0).sum() <= n and x.sum() == len(a)
    assert bags([]).shape == (0, 2)


def test_both_routes_find_the_same_names(spark, monkeypatch):
    senders = ["Anna Müller <a@x.example>", "Zoë Núñez <z@x.example>", "Ann Smith <s@x.example>", "Jean-Luc O'Neil <j@x.example>", "Željko Čapek <c@x.example>"]
    bodies = ["Please read Smith's note.", "Anna Müller's and Zoë Núñez’ part", "Jean-Luc O'Neil, Anna' and (Čapek)", "Željko Čapek", "Smith-Müller or SMITH", "x" * 200 + ".y@long.example and tel:5550116789"]
    df = spark.createDataFrame([(str(i), s, None, b) for i, (s, b) in enumerate(zip([*senders, None], bodies, strict=True))], "source_id string, sender string, recipients_json string, body_raw string")
    first = sorted(tuple(r) for r in found(df).collect())
    names = [[bodies[int(r[0])][a:b] for a, b in zip(r[1], r[2], strict=True)] for r in first]
    assert names[0] == ["Smith"] and names[1] == ["Anna Müller", "Zoë Núñez"] and "Jean-Luc O'Neil" in names[2] and "Čapek" in names[2] and names[3] == ["Željko Čapek"] and names[5] == ["x" * 200 + ".y@long.example", "5550116789"]
    monkeypatch.setattr("missive.llm.pii.MAX_NAMES", 0)
    assert sorted(tuple(r) for r in found(df).collect()) == first


def test_spans_are_kept_in_linear_time():
    assert Finder._keep([(0, 2, "A"), (5, 9, "A")], [(1, 3, "B"), (2, 5, "B"), (3, 4, "B"), (8, 10, "B"), (9, 10, "B")]) == [(0, 2, "A"), (2, 5, "B"), (5, 9, "A"), (9, 10, "B")]
    many = [(i, i + 1, "B") for i in range(200_000)]
    assert len(Finder._keep([], many)) == 200_000


def test_matches_without_enough_mails_are_let_go():
    """Near-matches that can't make a sentence boilerplate are not given; of split places all are."""
    import pandas as pd

    from missive.llm.authored import _enough

    rows = pd.DataFrame({"group": [1] * 4, "other": [False, False, True, True], "node": [1, 2, 3, 4], "print": [7, 7 << 40, 7, 7 << 40], "size": 50, "low": 0, "high": 0, "n": [1, 1, 4, 2], "table": -1})
    given = lambda r: sorted((a, b) for f in _enough(r, None) for a, b in zip(f["node"], f["node2"], strict=True))
    every = given(rows.assign(n=5))
    assert (1, 3) in every and (2, 4) in every
    assert given(rows.assign(n=1)) == [] and given(rows.assign(n=1, table=0)) != []


def test_long_sentences_keep_their_prints():
    from missive.llm.authored import fingerprints

    short, long = ["alpha", "beta", "gamma"] * 5, [f"w{k % 7}" for k in range(700)]
    assert fingerprints([short, long])[0] == fingerprints([short])[0] and fingerprints([short, long])[1] == fingerprints([long])[0]


def test_texts_are_written_once_and_only_open_questions_are_asked(spark):
    """Where pairs are sought, one written table has texts; with bare, sentences of mails that keep a line anyway are not sought."""

    class Watched(Cut):
        def __init__(self, spark):
            super().__init__(spark)
            self.live, self.texts, self.asked = {}, [], None

        def keep(self, df):
            if df.columns == ["node", "node2", "more"]:
                self.texts.append(sum("text" in c or "own_text" in c for c in self.live.values()))
            out = super().keep(df)
            self.live[out._cut_path] = out.columns
            if {"source_id", "place", "n"} == set(out.columns) and self.asked is None:
                self.asked = {r[0] for r in out.collect()}
            return out

        def drop(self, *frames):
            for f in frames:
                self.live.pop(getattr(f, "_cut_path", None), None)
            super().drop(*frames)

    rows = [("m1", {"body_raw": PASSED}), ("m2", {**B, "body_raw": "Hi Ann,\n" + PASSED}), ("m3", {**B, "body_raw": PASSED}), ("m4", {**B, "body_raw": ""})]
    plain = {"source_name": "s", "subject": "Plan", "sender": "a@x.example", "recipients_json": '["b@x.example"]'}
    data = [{**plain, "imported_at": datetime(2020, 2, n), **r, "source_id": i} for n, (i, r) in enumerate(rows, 1)]
    mails = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in EMAILS.split(", ")) for r in data], EMAILS)
    done = {}
    for bare in (False, True):
        cut = Watched(spark)
        found = authored(mails, spark.createDataFrame([("s", "UTC", True)], CLOCKS), cut, **({"bare": True} if bare else {}))
        done[bare] = {r["source_id"]: r["n_own"] for r in found.collect()}
        assert set(cut.texts) == {1} and ("m2" in cut.asked) is not bare and "m3" in cut.asked
    assert {k: n == 0 for k, n in done[True].items()} == {k: n == 0 for k, n in done[False].items()} == {"m1": False, "m2": False, "m3": True, "m4": True}


def test_sentences_move_without_their_texts(spark):
    """Texts stand with the parsed mails alone; what else is written of sentences has none."""
    kept = []

    class Watched(Cut):
        def keep(self, df):
            kept.append(df.columns)
            return super().keep(df)

    rows = [{"source_id": f"m{k}", "source_name": "s", "subject": "Plan", "sender": f"{'ab'[k % 2]}@x.example", "imported_at": datetime(2020, 2, k + 1), "body_raw": PASSED} for k in range(2)]
    rows += [{**rows[1], "imported_at": datetime(2020, 3, 1), "body_raw": "Another body.\n> quoted"}, {**rows[1], "source_id": None}]
    mails = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in EMAILS.split(", ")) for r in rows], EMAILS)
    done = authored(mails, spark.createDataFrame([("s", "UTC", True)], CLOCKS), Watched(spark))
    assert sorted((r["source_id"], r["told"], r["n_own"]) for r in done.collect()) == [("m0", [], 1), ("m1", [1], 0)]  # of m1 the first imported counts
    assert sum("text" in c and "body_hash" in c for c in kept) == 1 and not any("own_text" in c for c in kept) and not any("text" in c and "at" in c for c in kept)


def test_near_matches_are_all_pairs_within_bounds():
    """The pairs of two groups, held against a plain count over every two rows; with n, each pair has the mails of both."""
    import pandas as pd

    from missive.llm.authored import EDITS, TABLES, _enough, _near_pairs

    rnd, base = random.Random(9), [random.Random(k).getrandbits(64) for k in range(4)]
    prints = [base[k % 4] ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 24))) for k in range(120)]
    size, low = [rnd.randint(60, 75) for _ in prints], [rnd.randint(0, 12) for _ in prints]
    group, n = [k % 2 for k in range(120)], [rnd.randint(1, 6) for _ in prints]
    one = pd.DataFrame({"group": group, "node": range(120), "print": np.array(prints, dtype=np.uint64).view(np.int64), "size": size, "low": low, "high": 0, "n": n, "table": -1})
    rows = pd.concat([one.assign(other=False), one.assign(other=True)])
    want = set()
    for a in range(120):
        for b in range(120):
            x, most = prints[a] ^ prints[b], max(size[a], size[b]) * EDITS
            part = any((x >> (64 // TABLES * k)) & 0xFF == 0 for k in range(TABLES))
            if a != b and group[a] == group[b] and part and x.bit_count() <= DISTANCE and abs(size[a] - size[b]) <= most and abs(low[a] - low[b]) <= most:
                want.add((a, b))
    got = [(int(a), int(b)) for f in _near_pairs(rows, None) for a, b in zip(f["node"], f["node2"], strict=True)]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)
    counted = {(int(a), int(b)): (x, y, w) for f in _enough(rows, None) for a, b, x, y, w in zip(f["node"], f["node2"], f["n"], f["n2"], f["whole"], strict=True)}
    assert counted and all(v == (n[a], n[b], True) and (a, b) in want for (a, b), v in counted.items())


def test_tables_are_written_by_methods_that_are_compiled(spark, monkeypatch):
    """Stages whose methods the JVM would never compile are cut smaller while a table is written, and only then."""
    from missive.session import LIMIT

    cut, before, seen = Cut(spark), spark.conf.get(LIMIT), []
    plain = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path: (seen.append(spark.conf.get(LIMIT)), plain(self, path))[1])
    assert cut.keep(spark.range(3)).count() == 3 and seen == ["8000"] and spark.conf.get(LIMIT) == before
