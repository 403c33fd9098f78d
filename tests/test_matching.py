import itertools
import random
import unicodedata

import numpy as np
import pytest

from missive.functions.text import folded, squeezed, subject_of, words_of
from missive.operators.joins import nearest_earlier, reciprocal_links
from missive.operators.matching import heaviest_assignment, ranked_assignment
from missive.operators.sampling import balanced_pick, whole_groups
from missive.operators.similarity import similar_pairs
from missive.plans.decision_queries import paired_bootstrap
from missive.session import Cut


def every(n, m):
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for columns in itertools.permutations(range(m), k):
                yield list(zip(rows, columns, strict=True))


def test_assignments_against_every_one():
    rnd = random.Random(7)
    for _ in range(150):
        n, m = rnd.randint(0, 4), rnd.randint(0, 4)
        w = [[rnd.choice([0, 0, 1, 2, 3.5, rnd.random()]) for _ in range(m)] for _ in range(n)]
        got = heaviest_assignment(w)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert sum(w[i][j] for i, j in got) == pytest.approx(max(sum(w[i][j] for i, j in p) for p in every(n, m)))
        s = [[(1.0, rnd.choice([0.25, 0.5, 1.0]), rnd.choice([0.0, 1.0])) if rnd.random() < 0.7 else () for _ in range(m)] for _ in range(n)]
        total = lambda p: tuple(round(sum(s[i][j][k] for i, j in p), 6) for k in range(3))  # noqa: B023, E731
        assert total(ranked_assignment(s)) == max(total(p) for p in every(n, m) if all(s[i][j] for i, j in p))
    assert heaviest_assignment([[], [1.0]]) == [(1, 0)] and ranked_assignment([]) == []


def test_folding_is_that_of_python(spark):
    texts = ["Straße ﬁn Ⅷ", "ΣΑΣ ς", "ſ  x y", "é É", None, "", "RE: Fw:  AW:Ünter_Plan ２", "İ ǰ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folded("t").alias("f"))
    for r in df.select("t", "f", squeezed("f").alias("s"), words_of("f").alias("w"), subject_of("f").alias("j")).collect():
        want = unicodedata.normalize("NFKC", r["t"] or "").casefold()
        assert r["f"] == want and r["s"] == " ".join(want.split())
    assert df.select(subject_of("f").alias("j")).collect()[6]["j"] == "ünter plan 2"


def test_earlier_rows_and_links_against_pairs(spark):
    rnd = random.Random(9)
    rows = [(k, rnd.choice("ab"), rnd.choice("xyz"), rnd.randint(0, 60)) for k in range(150)]
    got = {tuple(r) for r in nearest_earlier(spark.createDataFrame(rows, "key long, g string, u string, at long"), "key", ["g"], "u", "at", 7).collect()}
    want = set()
    for k, g, u, at in rows:
        before = [(t, -i) for i, h, v, t in rows if h == g and v != u and at - 7 <= t < at]
        if before:
            want.add((k, -max(before)[1]))
    assert got == want
    mails = [(f"m{k}", rnd.choice(["s", "t", None]), rnd.choice("abcd"), rnd.sample("abcd", rnd.randint(0, 2)), rnd.randint(0, 80), rnd.random() < 0.5) for k in range(120)]
    df = spark.createDataFrame(mails, "key string, subject string, sender string, people array<string>, at long, is_reply boolean")
    edges = [(a[0], b[0]) for a in mails for b in mails if a[1] and a[1] == b[1] and a[2] != b[2] and a[2] in b[3] and b[2] in a[3] and b[5] and b[4] - 5 <= a[4] < b[4]]
    ends = [x for e in edges for x in e]
    assert {(r["earlier_id"], r["later_id"]) for r in reciprocal_links(df, 5).collect()} == {e for e in edges if ends.count(e[0]) == ends.count(e[1]) == 1}
    assert reciprocal_links(df.limit(0), 5).count() == 0


def test_similar_pairs_against_all(spark):
    rnd = random.Random(2)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(4, 60))] for _ in range(8)]
    texts = {}
    for k in range(60):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = "other"
        texts[k] = " ".join(rnd.choice([w, w + rnd.choice(base)]))
    texts |= {100: None, 101: "", 102: "one two three"}
    pairs, members = similar_pairs(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", "t", Cut(spark))
    first = {}
    for k in sorted(texts):
        if texts[k]:
            first.setdefault(texts[k], k)
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t, k in first.items()}
    want = {}
    for a, b in itertools.permutations(first.values(), 2):
        if sets[a] and (len(sets[a]), a) < (len(sets[b]), b) and len(sets[a] & sets[b]) >= 0.9 * len(sets[a]):
            want[a, b] = f" {texts[a]} " in f" {texts[b]} "
    assert {(r["a"], r["b"]): r["ordered"] for r in pairs.collect()} == want and len(want) > 20
    assert {(r["key"], r["representative"]) for r in members.collect()} == {(k, first[t]) for k, t in texts.items() if t}


def test_balanced_pick_and_whole_groups(spark):
    rows = [(f"{c}{k}", c, k) for c, n in (("a", 9), ("b", 2), ("c", 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "key string, cat string, rank long")
    prior = spark.createDataFrame([("a", 3)], "cat string, taken long")
    got = sorted(r["key"] for r in balanced_pick(df, "cat", "cat", "rank", "key", 9, prior).collect())
    taken, left = {"a": 3, "b": 0, "c": 0}, {c: [r for r in rows if r[1] == c] for c in "abc"}
    want = []
    for _ in range(9):
        c = min((c for c in "abc" if left[c]), key=lambda c: (taken[c], c))
        want.append(left[c].pop(0)[0])
        taken[c] += 1
    assert got == sorted(want)
    groups = spark.createDataFrame([(1, 4), (2, 3), (3, 5), (4, 1)], "k long, n long")
    assert [r["k"] for r in whole_groups(groups, "n", ["k"], 8).orderBy("k").collect()] == [1, 2, 3]


def test_paired_bootstrap(spark):
    rnd = random.Random(3)
    rows = [(str(k), ["x"] if k % 2 else ["y"], [rnd.choice("xy")], ["x"] if k % 2 else ["y"]) for k in range(60)]
    df = spark.createDataFrame(rows, "key string, expected array<string>, first array<string>, second array<string>")
    got = {r["metric"]: r for r in paired_bootstrap(df, ["x", "y"], 200).collect()}
    right = np.mean([e == f for _, e, f, _ in rows])
    assert got["micro"]["delta"] == pytest.approx(1 - right, abs=1e-5) and 0 < got["micro"]["low"] < got["micro"]["delta"] < got["micro"]["high"] < 1
    assert sorted(map(tuple, paired_bootstrap(df.repartition(5), ["x", "y"], 200).collect())) == sorted(map(tuple, got.values()))
    assert paired_bootstrap(df.limit(0), ["x", "y"], 20).count() == 0


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_bits_bound_the_overlap(spark, least):
    """Bits let go most pairs that are too far apart, and none that is near, whatever the sizes of the sets."""
    from missive.operators.similarity import _bits, _lacking

    rnd = random.Random(3)
    rows = []
    for n in (1, 9, 40, 150, 900):
        base = [rnd.getrandbits(64) - 2**63 for _ in range(n)]
        for changed in (0, 0.05, 0.1, 0.9):
            rows.append((base, [rnd.getrandbits(64) - 2**63 if rnd.random() < changed else x for x in base]))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = df.withColumns({"ma": _bits(df.a), "mb": _bits(df.b)}).select("a", "b", _lacking("ma", "mb").alias("k"))
    for a, b, k in got.collect():
        assert k <= len(set(a) - set(b))
        if 9 <= len(a) <= 150 and len(set(a) & set(b)) < len(a) / 2:
            assert len(a) - k < len(a) * least


def test_kept_tables_leave_no_shuffle_files(spark):
    import time

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, cut = files(), Cut(spark)
    kept = cut.keep(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    end = time.time() + 10
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and kept.count() == 7


@pytest.mark.parametrize("buckets", [64, 1 << 16])
def test_near_duplicates_move_no_whole_sets(spark, monkeypatch, buckets):
    """However common shingles are held to be, no link is lost, and less is written than one table of all shingles."""
    from pathlib import Path

    from missive.operators import similarity

    monkeypatch.setattr(similarity, "BUCKETS", buckets, raising=False)
    rnd = random.Random(8)
    phrases = [" ".join(f"p{k}x{i}" for i in range(9)) for k in range(12)]
    texts = []
    for k in range(120):
        own = [" ".join(f"v{rnd.randrange(5000)}" for _ in range(30)) for _ in range(20 if k % 3 else 2)]
        texts.append(" ".join(rnd.sample(phrases, 5) + own))
        if k % 4 == 0:
            w = texts[-1].split()
            for _ in range(k % 5):
                w[rnd.randrange(len(w))] = "changed"
            texts += [" ".join(w), texts[-1].upper() + "!"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, ""), (5, "a b c d e f"), (5, texts[6]), (400, texts[0])]
    of: dict[int, tuple] = {}
    for k, t in rows:
        of[k] = max(of.get(k, ()), tuple(t.lower().replace("!", "").split()))
    sets = {w: {w[i : i + 5] for i in range(len(w) - 4)} for w in of.values()}
    links = {w: sum(1 for v in sets if v != w and len(sets[v] & sets[w]) / len(sets[v] | sets[w]) >= 0.8) for w in sets}
    written = []
    keep = Cut.keep

    def kept(self, df):
        back = keep(self, df)
        written.append(sum(p.stat().st_size for p in Path(back._cut_path.removeprefix("file:")).glob("*.parquet")))
        return back

    monkeypatch.setattr(Cut, "keep", kept)
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {r["id"]: r["n_links"] for r in similarity.near_duplicates(df, "id", "text", Cut(spark)).collect()}
    assert got == {k: links[w] for k, w in of.items()} and any(links.values())
    assert max(written) < 4 * sum(map(len, sets.values()))


@pytest.mark.parametrize("postings", [3000, 1 << 21])
def test_similar_pairs_write_few_others(spark, monkeypatch, postings):
    """Texts of the same phrases share rare shingles with many; hardly any pair is written that isn't one, in however many blocks."""
    from missive.operators import similarity

    monkeypatch.setattr(similarity, "POSTINGS", postings, raising=False)
    rnd = random.Random(5)
    phrases = [" ".join(f"p{k}x{i}" for i in range(9)) for k in range(12)]
    texts = [" ".join(rnd.sample(phrases, 5)) for _ in range(150)] + [" ".join(rnd.choice(phrases) for _ in range(400)), "x " * 400]
    for t in texts[:20]:
        texts += [t.upper() + " and more", t.replace("x8", "y", 1), " ".join(f"v{rnd.randrange(5000)}" for _ in range(900)) + " " + t]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, ""), (9, texts[0] + " zz"), (300, texts[1])]
    of, first = {}, {}
    for k, t in rows:
        of[k] = max(of.get(k, ()), tuple(t.lower().split()))
    for k in sorted(of):
        first.setdefault(of[k], k)
    sets = {k: {w[i : i + 5] for i in range(len(w) - 4)} for w, k in first.items()}
    joined = {k: f" {' '.join(w)} " for w, k in first.items()}
    want = {}
    for a, b in itertools.permutations(sets, 2):
        if (len(sets[a]), a) < (len(sets[b]), b) and (n := len(sets[a] & sets[b])) >= 0.9 * len(sets[a]):
            want[a, b] = (len(sets[a]), len(sets[b]), n, joined[a] in joined[b], len(joined[b].split()), max(len(t.strip()) for k, t in rows if k == a))
    written = []
    keep = Cut.keep

    def kept(self, df):
        back = keep(self, df)
        if {"a", "b"} <= set(back.columns):
            written.append(back.count())
        return back

    monkeypatch.setattr(Cut, "keep", kept)
    pairs, _ = similarity.similar_pairs(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t", Cut(spark))
    assert {(r["a"], r["b"]): (r["n_a"], r["n_b"], r["n_shared"], r["ordered"], r["words_b"], r["chars_a"]) for r in pairs.collect()} == want and len(want) > 60
    assert max(written) < 2 * len(want)
