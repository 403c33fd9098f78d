import random

from missive.llm.consensus import LABELS, consensus, infer, usable
from missive.llm.groups import consolidate
from missive.llm.splits import related, split, units
from missive.session import Cut


def closure(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a in up and b in up:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_consolidate(spark):
    rnd = random.Random(4)
    ids = [f"r:{k:03}" for k in range(120)]
    edges = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(60)] + [("r:000", f"r:{k:03}") for k in range(60, 100)]
    links = [(a.upper() if k % 4 == 0 else f" {a}\t", b) for k, (a, b) in enumerate(edges)] + [(None, "r:001"), ("r:002", "none"), ("r:003", "r:003"), *edges[:9]]
    records = spark.createDataFrame([(i, "x") for i in [*ids, "r:005", None]], "record_id string, group_id string")
    want = closure(ids, edges)
    got = consolidate(records, spark.createDataFrame(links, "left_id string, right_id string"), Cut(spark)).collect()
    assert {r["record_id"]: r["group_id"] for r in got} == want and len(got) == len(ids)
    none = spark.createDataFrame([], "left_id string, right_id string")
    assert {r["group_size"] for r in consolidate(records, none, Cut(spark)).collect()} == {1}
    assert consolidate(records.limit(0), none, Cut(spark)).count() == 0


def test_related_against_closure(spark):
    rnd = random.Random(8)
    ids = [f"i{k:03}" for k in range(200)]
    ties = [(i, f"k{rnd.randrange(150)}") for i in ids for _ in range(rnd.randint(0, 2))] + [(i, "hot") for i in ids[:70]]
    first, edges = {}, []
    for i, k in ties:
        edges.append((first.setdefault(k, i), i))
    rows = spark.createDataFrame([(i,) for i in [*ids, ids[3], None]], "record_id string")
    keys = spark.createDataFrame([*ties, *ties[:5], (None, "hot"), ("unknown", "hot"), (ids[150], None)], "record_id string, key string")
    cut = Cut(spark)
    found = cut.keep(related(rows, keys, cut))
    assert {r["record_id"]: r["unit_id"] for r in units(found).collect()} == closure(ids, edges)
    parts = {r["record_id"]: r["split"] for r in split(found, {"train": 0.6, "test": 0.4}, cut).collect()}
    want = closure(ids, edges)
    assert len(parts) == len(ids) and all(len({parts[i] for i in ids if want[i] == u}) == 1 for u in set(want.values()))
    empty = rows.limit(0)
    assert related(empty, keys, cut).count() == 0


REVIEW = "source_id string, user_id string, annotation_json string, status string, revision int"


def test_usable(spark):
    j = '{"labels": ["Follow Up", "odd", "MEETING"]}'
    rows = [("s", " REV-1 ", j, "submitted", 1), ("s", "rev-1", '{"labels":["NON-PROJECT"]}', "submitted", 2), ("s", "rev-1", j, "draft", 3), ("s", "rev-2", j, "submitted", 1), ("s", "rev-2", j, "submitted", 1), ("s", "rev-3", j[:20], "submitted", 1), ("s", "rev-4", None, "submitted", 1), (None, "rev-5", j, "submitted", 1), ("s", "rev-6", "[]", "submitted", None)]
    got = {r["user"]: r["mask"] for r in usable(spark.createDataFrame(rows, REVIEW)).collect()}
    bit = {x: 1 << k for k, x in enumerate(LABELS)}
    assert got == {"rev-1": bit["NON_PROJECT"], "rev-2": bit["FOLLOW_UP"] | bit["MEETING"]}


def test_consensus_beats_votes(spark):
    rnd = random.Random(6)
    truth, rows = {}, []
    for s in range(300):
        truth[s] = {rnd.randrange(8) for _ in range(rnd.choice([1, 1, 2]))}
        for u in rnd.sample(range(12), 4):
            good = u < 5
            said = set(truth[s]) if good and rnd.random() < 0.9 else {rnd.randrange(8)} if u < 10 else {5}
            rows.append((f"s{s}", f"u{u}", sum(1 << k for k in said)))
    cut = Cut(spark)
    posterior, users = infer(spark.createDataFrame(rows, "source_id string, user string, mask int"), cut)
    got = {r["source_id"]: set(r["labels"]) for r in consensus(posterior).collect()}
    votes = {}
    for s, _, m in rows:
        votes.setdefault(s, []).append(m)
    majority = {s: {LABELS[k] for k in range(9) if sum(m >> k & 1 for m in ms) * 2 > len(ms)} for s, ms in votes.items()}
    right = lambda guess: sum(guess[f"s{s}"] == {LABELS[k] for k in t} for s, t in truth.items()) / len(truth)
    assert right(got) > 0.8 and right(got) > right(majority) + 0.2
    assert users.count() == 12
    posterior, users = infer(spark.createDataFrame([], "source_id string, user string, mask int"), cut)
    assert consensus(posterior).count() == 0 and users.count() == 0
