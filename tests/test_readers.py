"""Graphs cut to a reader: what only a hidden record connects stays unknown."""

from datetime import datetime

from tidemark.operators import graph
from tidemark.plans import readers


def test_a_hidden_record_is_no_bridge(spark):
    edges = spark.createDataFrame([(1, 2, "a", "why"), (2, 3, "b", "why"), (1, 4, "b", "why"), (4, 5, "a", "why"), (5, 3, "a", "why"), (1, 4, "a", "why"), (6, 1, "a", "why"), (1, 1, "a", "why")], "src long, dst long, type string, note string")
    seen = spark.createDataFrame([("all", i) for i in range(1, 7)] + [("few", i) for i in (1, 3, 4, 5, 6)] + [("less", i) for i in (1, 3, 6)], "reader string, id long")
    starts = spark.createDataFrame([(1,), (2,)], "id long")
    got = {(x["reader"], x["start"], x["id"]): (x["hops"], x["via"]) for x in graph.reader_hops(edges, seen, starts, 2).collect()}
    assert {k: v for k, v in got.items() if k[:2] == ("all", 1)} == {("all", 1, 2): (1, "a"), ("all", 1, 3): (2, "b"), ("all", 1, 4): (1, "a"), ("all", 1, 5): (2, "a"), ("all", 1, 6): (1, "a")}
    assert {k[2]: v for k, v in got.items() if k[0] == "few"} == {4: (1, "a"), 5: (2, "a"), 6: (1, "a")}  # 3 is two hops away through 2 alone
    assert {k[2] for k in got if k[0] == "less"} == {6} and not any(k[1] == 2 for k in got if k[0] != "all")
    assert {k[2]: v[0] for k, v in {(x["reader"], x["start"], x["id"]): (x["hops"],) for x in graph.reader_hops(edges, seen, starts, 3).collect()}.items() if k[0] == "few"}[3] == 3
    assert set(graph.reader_edges(edges, seen).columns) == {"reader", "src", "dst", "type"}


def test_steps_up_to_a_bound_on_chains_of_any_length(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200)], "key long, next long")
    starts = spark.createDataFrame([(0,), (95,), (200,), (300,)], "key long")
    for most in (0, 1, 5, 32):
        got = sorted(map(tuple, graph.within(links, starts, most).collect()))
        want = [(s, s + k, k) for s in (0, 95) for k in range(most + 1) if s + k <= 100] + [(200, 200 + k % 2, k) for k in range(most + 1)] + [(300, 300, 0)]
        assert got == sorted(want)


def test_chains_end_at_hidden_records_and_do_not_tell_of_them(spark):
    end = datetime(2024, 1, 1)
    rows = [(i, None if i == 6 else end, i - 1 if i > 1 else None) for i in range(1, 7)]
    records = spark.createDataFrame(rows, "id long, valid_to timestamp, supersedes_id long")
    seen = spark.createDataFrame([("all", i) for i in range(1, 7)] + [("few", i) for i in (1, 3, 4, 6)], "reader string, id long")
    got = {(x["reader"], x["requested"], x["place"]): (x["id"], x["valid_to"], x["supersedes_id"], x["superseded_by"], x["current"]) for x in readers.histories(records, seen, records).collect()}
    assert {k[2]: v[0] for k, v in got.items() if k[:2] == ("all", 3)} == {-2: 1, -1: 2, 0: 3, 1: 4, 2: 5, 3: 6}
    assert {k: v for k, v in got.items() if k[:2] == ("few", 3)} == {("few", 3, 0): (3, end, None, 4, False), ("few", 3, 1): (4, None, 3, None, True)}
    assert {k: v for k, v in got.items() if k[:2] == ("few", 4)} == {("few", 4, -1): (3, end, None, 4, False), ("few", 4, 0): (4, None, 3, None, True)}
    assert got["few", 1, 0] == (1, None, None, None, True) and got["few", 6, 0] == (6, None, None, None, True) and ("few", 2, 0) not in got
    short = {(x["requested"], x["place"]): x["supersedes_id"] for x in readers.histories(records, seen, records, 1).collect() if x["reader"] == "all"}
    assert short[4, -1] is None and short[4, 0] == 3 and (4, -2) not in short


def test_components_of_long_chains_stars_and_cycles(spark):
    import random

    r = random.Random(8)
    names = r.sample(range(10_000), 260)
    chain = list(zip(names[:120], names[1:121], strict=False))
    star = [(names[130], x) for x in names[131:180]]
    ring = [(names[180 + i], names[180 + (i + 1) % 30]) for i in range(30)]
    loose = [(names[215], names[216]), (names[216], names[215]), (names[217], names[217])]
    edges = chain + star + ring + loose
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {x["id"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).collect() == []
