import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from missive.operators.graph import components
from missive.operators.ordering import numbered, sessions
from missive.session import Cut


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def run(spark, edges):
    return {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Cut(spark)).collect()}


def test_shapes(spark):
    chain = [(i, i + 1) for i in range(60)]
    ids = list(range(1000, 1060))
    random.Random(3).shuffle(ids)
    shuffled = list(zip(ids, ids[1:], strict=False))
    star = [(5000, k) for k in range(5001, 5200)]
    edges = chain + shuffled + star + star[:50] + [(b, a) for a, b in star[:20]] + [(7, 7), (9000, 9000), (None, 3), (4, None)]
    assert run(spark, edges) == brute(edges)
    assert run(spark, []) == {}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_any_graph(spark, edges):
    assert run(spark, edges) == brute(edges)


def test_numbers_and_sessions_in_hot_groups(spark):
    rnd = random.Random(1)
    rows = [("hot" if k % 3 else (None if k % 2 else "b"), rnd.choice([None, *range(400)]), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, at long, id long")
    low = lambda v: -1 if v is None else v
    got = {r["id"]: r["n"] for r in numbered(df, ["g"], ["at", "id"], "n", Cut(spark)).collect()}
    want, last, sess = {}, {}, {}
    for g, at, i in sorted(rows, key=lambda r: (str(r[0]), low(r[1]), r[2])):
        want[i] = last.setdefault(g, [0, None, 1])[0] + 1
        state = last[g]
        state[0] += 1
        if at is not None:
            if state[1] is not None and at - state[1] > 5:
                state[2] += 1
            state[1] = at
        sess[i] = state[2]
    assert got == want
    assert {r["id"]: r["s"] for r in sessions(df, ["g"], "at", ["id"], 5, "s", Cut(spark)).collect()} == sess
    assert numbered(df.limit(0), ["g"], ["at"], "n", Cut(spark)).count() == 0
