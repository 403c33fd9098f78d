import random

import numpy as np
import pytest

from missive.llm.language import SPELLINGS, fit, label_code, languages, sentences, stretches
from missive.llm.leakage import leaked
from missive.llm.packing import pack, plan
from missive.session import Cut

VOCABULARY = [f"term{k}" for k in range(400)]


def test_leaked(spark):
    rnd = random.Random(2)
    passage = [rnd.choice(VOCABULARY) for _ in range(60)]
    other = [rnd.choice(VOCABULARY) for _ in range(50)]
    noise = lambda n: [rnd.choice(VOCABULARY) for _ in range(n)]
    changed = list(passage)
    for k in range(4, 60, 9):
        changed[k] = "else"
    shuffled = list(passage)
    rnd.shuffle(shuffled)
    docs = {
        1: noise(50) + passage + noise(50), 2: noise(30) + changed + noise(20), 3: noise(40) + passage[:27], 4: noise(9) + passage[:14] + noise(30) + passage[14:30] + noise(9), 5: noise(20) + shuffled + noise(20),
        6: noise(80) + passage[10:20], 7: noise(3000) + [w.upper() + "," for w in passage] + noise(3000), 8: noise(100), 9: passage[:14] + noise(400) + passage[14:26], 10: passage[:5] + passage[8:30] + passage[33:] + other,
    }
    rows = [(k, "  ".join(v)) for k, v in docs.items()] + [(1, " ".join(docs[1])), (20, None), (21, ""), (22, "--- ...")]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(other)), (3, "two words"), (4, None), (5, "")], "item_id long, passage string")
    got = sorted(tuple(r) for r in leaked(spark.createDataFrame(rows, "doc_id long, text string"), items).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 1), (10, 1), (10, 2)]
    assert leaked(spark.createDataFrame(rows, "doc_id long, text string"), items.limit(0)).count() == 0


def test_two_stretches_need_no_more_than_one(spark):
    rnd = random.Random(6)
    passage = [f"word{k}" for k in range(54)]
    noise = lambda n: [rnd.choice(VOCABULARY) for _ in range(n)]
    changed = [w if k % 5 != 2 else "else" for k, w in enumerate(passage)]
    docs = {1: noise(9) + passage[:15] + noise(30) + passage[30:37], 2: noise(9) + passage[:13] + noise(30) + passage[30:39], 3: changed[:16] + noise(20) + changed[30:46], 4: passage[30:39] + noise(30) + passage[:13], 5: passage[:9] + noise(30) + passage[30:39]}
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, passage string")
    got = leaked(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string"), items).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3]


def test_leaked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("missive.llm.leakage.BLOCK", 2)
    rnd = random.Random(3)
    passages = [[rnd.choice(VOCABULARY) for _ in range(40)] for _ in range(5)]
    items = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id long, passage string")
    docs = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "doc_id long, text string")
    assert sorted(tuple(r) for r in leaked(docs, items).collect()) == [(k, k) for k in range(5)]


WORDS = {
    "en": "the of and to in is that for it with as was on are this be have from or by which will not but all their there would".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "nl": "de van het een en in is dat op te zijn met voor die niet aan er om ook als dan maar bij nog naar uit worden werd door wordt".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus leur avec tout".split(),
    "es": "el la de que y a en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este ir muy también".split(), "pt": "o a de que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito".split(),
}


def sentence(rnd, code):
    return " ".join(rnd.choice(WORDS[code]) for _ in range(12)).capitalize() + "."


def test_languages(spark):
    rnd = random.Random(4)
    tree = fit([(c, sentence(rnd, c)) for c in WORDS for _ in range(60)])
    held = [(c, sentence(rnd, c)) for c in WORDS for _ in range(50)]
    assert np.mean([stretches(s, tree)[0][2] == c for c, s in held]) > 0.97
    a, b = " ".join(sentence(rnd, "fr") for _ in range(3)), " ".join(sentence(rnd, "nl") for _ in range(3))
    mixed = f"  {a}\n{b} \n"
    got = [(s[0], s[1], s[2]) for s in stretches(mixed, tree)]
    assert got == [(2, 2 + len(a), "fr"), (3 + len(a), 3 + len(a) + len(b), "nl")]
    rows = [(1, mixed, None), (2, "123 456", "en"), (3, None, "en"), (4, "", "xx"), (5, a * 3000, "French")]
    found = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), tree).collect()
    assert sorted({(r["doc_id"], r["declared"]) for r in found}) == [(1, None), (5, "fr")] and all(0 <= r["confidence"] <= 1 for r in found)
    assert languages(spark.createDataFrame([], "doc_id long, text string, lang string"), tree).count() == 0
    assert sentences("One. Two! three\nFour") == [(0, 4), (5, 9), (10, 15), (16, 20)]


def test_labels(spark):
    from pyspark.sql import functions as F

    cases = [("en-US", "en"), (" German ", "de"), ("por", "pt"), ("klingon", "other"), ("", None), ("und", None), (None, None)]
    got = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, c string").select("k", label_code(F.col("c")).alias("x")).collect()
    assert [r["x"] for r in sorted(got)] == [w for _, w in cases] and len(SPELLINGS) == 6


def test_plan_is_whole_and_tight():
    rnd = np.random.default_rng(1)
    counts = np.bincount(np.clip(rnd.gamma(2, 60, 5000).astype(int), 1, 512), minlength=513)
    left = counts.copy()
    n = 0
    for lengths, many in plan(counts):
        assert sum(lengths) <= 512
        for x in lengths:
            left[x] -= many
        n += many
    assert not left.any() and n <= np.ceil((counts * np.arange(513)).sum() / 512) * 1.02 + 1
    assert plan(np.zeros(9, dtype=int)) == []


def test_pack(spark):
    rnd = random.Random(7)
    rows = [(k, rnd.choice([7, 7, 7, 30, 55, 99, 250])) for k in range(400)] + [(3, 1), (900, 0), (901, None), (None, 5)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens int"), 100, Cut(spark)).collect()
    room, size = {}, {}
    for r in got:
        room[r["container_no"]] = room.get(r["container_no"], 0) + r["n_tokens"]
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_tokens"]
    want = {}
    for d, n in rows:
        if d is not None and n:
            want[d] = max(n, want.get(d, 0))
    assert size == want and max(room.values()) <= 100 and sorted(room) == list(range(len(room)))
    assert all(sum(r["doc_id"] == d for r in got) == 1 for d, n in list(want.items())[:50] if n <= 100)
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens int"), 100, Cut(spark)).count() == 0


def test_languages_without_labels(spark):
    text = {"en": "We will send the plan and the figures to you from here. This is for the board with all of it.", "de": "Der Plan ist nicht für die Leitung und das Werk. Wir werden ihn mit der Post auch an sich senden.", "fr": "Nous avons les plans et des notes dans une boîte pour vous. Ils ne sont pas avec le reste sur la table."}
    rows = [(10 * i + k, f"{v} {v}", None) for i, v in enumerate(text.values()) for k in range(8)]
    found = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r["doc_id"] // 10, r["lang_code"]) for r in found} == set(enumerate(text))
    with pytest.raises(ValueError, match="common words"):
        languages(spark.createDataFrame([(1, "qwx zzk " * 20, None)], "doc_id long, text string, lang string"))
