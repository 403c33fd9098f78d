import random

import pytest

from missive.functions.ids import bare, message_ids, packed, valued
from missive.functions.text import authored, shingles, subject_key, tokens
from missive.operators.archive import upsert
from missive.operators.fingerprints import fingerprints
from missive.operators.joins import nearest_earlier, one_to_one, thread_ids
from missive.operators.matching import heaviest_assignment, iou, largest_matching, merged, runs
from missive.operators.sampling import bottom_k, largest_remainder, round_robin
from missive.operators.similarity import cosine_top, near_duplicates
from missive.session import Cut


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f("c").alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(("f", "value", "want"), [
    (valued, " None\t", None), (valued, "MESSAGE-THREAD:AB ", "message-thread:ab"), (valued, None, None), (bare, " <A@b> ", "a@b"), (bare, "<>", None), (packed, "PROJECT MAIL", "projectmail"),
    (message_ids, '["<A@b>", " c@d "]', ["a@b", "c@d"]), (message_ids, None, []), (subject_key, "Re: AW:  Site plan!", "site plan"), (tokens, "Über-Plan 4B", ["über", "plan", "4b"]), (tokens, None, []),
    (authored, "Hello\r\nthere\r\n> old\nnew", "Hello\nthere"), (authored, "> first stays\nx\n-- \nsig", "> first stays\nx"), (authored, None, ""),
])
def test_text(spark, f, value, want):
    from pyspark.sql import functions as F

    assert one(spark, value, lambda c: f(F.col(c))) == want


def test_shingles(spark):
    from pyspark.sql import functions as F

    assert one(spark, "a b c d e f", lambda c: shingles(tokens(F.col(c)))) == ["a b c d e", "b c d e f"]
    assert one(spark, "a b", lambda c: shingles(tokens(F.col(c)))) == []


def test_fingerprints_of_odd_rows(spark):
    long = "word " * 200_000
    rows = spark.createDataFrame([(1, "s", None), (2, None, ""), (3, "s", "short one"), (4, "s", long), (4, "s", long)], "id int, title string, text string")
    got = {r["id"]: r for r in fingerprints(rows, "id", "title", "text").collect()}
    assert got[1]["short_exact"] is None and got[3]["short_exact"] and not got[3]["eligible"] and got[4]["n_tokens"] == 200_000 and got[4]["subject_body"]
    assert fingerprints(rows.limit(0), "id", "title", "text").count() == 0


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [None, "", "a b", "a b", "A, b!"]
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 60))]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rnd.randint(0, 2)):
                other[rnd.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, "x")]
    sets = {}
    for k, t in enumerate(texts):
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        sets[k] = (tuple(w), {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    links = {k: set() for k in sets}
    for a in sets:
        for b in sets:
            (wa, sa), (wb, sb) = sets[a], sets[b]
            near = sa and sb and len(sa & sb) / len(sa | sb) >= 0.8
            if wa and (wa == wb or near):
                up[max(find(a), find(b))] = min(find(a), find(b))
            if near and wa != wb:
                links[a].add(wb)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", Cut(spark)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {k: (find(k), len(links[k])) for k in sets}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", Cut(spark)).count() == 0


def test_upsert_keeps_annotations(spark):
    rows = [("a", 1, "HUMAN", None, "x"), ("a", 2, "UNANNOTATED", "t", "y"), ("b", 1, "UNANNOTATED", None, None), ("b", 1, "UNANNOTATED", None, None), (None, 1, "HUMAN", "t", "z")]
    df = spark.createDataFrame(rows, "k string, at int, how string, text string, body string")
    got = {r["k"]: (r["at"], r["how"], r["text"], r["body"]) for r in upsert(df, "k", "at", {"how": "UNANNOTATED", "text": None}).collect()}
    assert got == {"a": (2, "HUMAN", "t", "y"), "b": (1, "UNANNOTATED", None, None)}


@pytest.mark.parametrize("many", [32, 0])
def test_nearest_earlier(spark, monkeypatch, many):
    monkeypatch.setattr("missive.operators.joins.MANY", many)
    rnd = random.Random(2)
    rows = [(k, rnd.choice("uv"), rnd.choice(["x", "y", "z", None]), rnd.choice([None, *range(100)])) for k in range(150)]
    want = {}
    for k, g, v, t in rows:
        before = [(t2, -k2) for k2, g2, v2, t2 in rows if g2 == g and None not in (v, v2, t, t2) and v2 != v and t - 9 <= t2 < t]
        if before:
            want[k] = -max(before)[1]
    got = nearest_earlier(spark.createDataFrame(rows, "id long, g string, v string, t long"), "id", ["g"], "v", "t", 9)
    assert {r["later_id"]: r["earlier_id"] for r in got.collect()} == want


def test_threads_through_missing_messages(spark):
    rows = [("a", ["<m1>", "gone@x"]), ("b", ["m2", "<GONE@x>"]), ("c", ["m3"]), ("d", [None, ""]), ("c", ["m3"])]
    got = {r["id"]: (r["thread_id"], r["n_members"]) for r in thread_ids(spark.createDataFrame(rows, "id string, names array<string>"), "id", "names", Cut(spark)).collect()}
    assert got["a"] == got["b"] and got["a"][1] == 2 and got["c"][1] == got["d"][1] == 1 and len({x for x, _ in got.values()}) == 3


def test_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (4, 5), (None, 9)], "a int, b int")
    assert [tuple(r) for r in one_to_one(pairs, "a", "b").collect()] == [(1, 2)]


def test_samples(spark):
    rows = spark.createDataFrame([("a" if k % 3 else "b", k) for k in range(300)], "s string, id long")
    got = bottom_k(rows, ["s"], "id", 4, "x")
    assert sorted(r["s"] for r in got.collect()) == ["a"] * 4 + ["b"] * 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bottom_k(rows.repartition(7), ["s"], "id", 4, "x").collect()))
    assert [r["s"] for r in round_robin(rows, "s", "id", 4, "x").orderBy("place").collect()] == ["a", "b", "a", "b"]
    quota = largest_remainder(spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "s string, n long"), "s", "n", 4)
    assert {r["s"]: r["quota"] for r in quota.collect()} == {"a": 2, "b": 1, "c": 1}


def test_cosine_neighbours(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [])], "id long, v array<double>")
    got = cosine_top(rows, rows.where("id < 3"), "id", "v", 1, block=1).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [(1, 1, 2), (2, 1, 1)]


def test_matching():
    assert merged([(5, 7), (0, 3), (2, 4), (9, 9)]) == [(0, 4), (5, 7)]
    assert iou([(0, 4)], [(2, 6)]) == pytest.approx(2 / 6) and iou([], []) == 0
    assert largest_matching([[0.9, 0.5], [0.8, 0.0]]) == [(0, 1), (1, 0)]
    assert heaviest_assignment([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [(0, 0), (1, 2), (2, 1)] and heaviest_assignment([]) == []
    assert runs(["B-x", "I-X", "O", "I-y", "B-y"]) == [("x", 0, 2, False), ("y", 3, 4, True), ("y", 4, 5, False)]


def test_heaviest_assignment_against_brute_force():
    from itertools import permutations

    rnd = random.Random(9)
    for _ in range(30):
        w = [[rnd.randint(0, 9) for _ in range(4)] for _ in range(4)]
        best = max(sum(w[i][p[i]] for i in range(4)) for p in permutations(range(4)))
        assert sum(w[i][j] for i, j in heaviest_assignment(w)) == best
