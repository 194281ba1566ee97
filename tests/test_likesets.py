"""Sets that are alike against brute force, with blocks so small that words span several cells."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import likesets as L
from tidemark.plans import catalogue

NEAR = 0.72


@pytest.fixture
def sets(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 3)
    r = random.Random(3)
    base = [[f"w{r.randrange(60)}" for _ in range(9)] for _ in range(6)]
    out = {}
    for n in range(150):
        ws = set(base[n % 6])
        for _ in range(r.randrange(4)):
            ws ^= {r.choice(sorted(ws)), f"w{r.randrange(60)}"}
        if len(ws) >= 4:
            out[tuple(sorted(ws))] = 1000 - n
    return {i: set(ws) for ws, i in out.items()}


def frame(spark, sets):
    return spark.createDataFrame([(i, i % 3 + 1, sorted(ws)) for i, ws in sets.items()], "id long, copies long, ws array<string>")


def brute(sets):
    return {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= NEAR}


def test_each_pair_once(spark, sets):
    got, want = L.alike(frame(spark, sets), NEAR).collect(), brute(sets)
    assert len(got) == len(want) > 40 and {(x["a"], x["b"]): x["likeness"] for x in got} == want
    assert all((x["a_copies"], x["b_copies"]) == (x["a"] % 3 + 1, x["b"] % 3 + 1) for x in got)


def test_links_and_classes(spark, sets):
    each, want = L.linked(frame(spark, sets), NEAR), brute(sets)
    got = {x["id"]: x["n"] for x in each.groupBy("id").agg(F.sum("links").alias("n")).collect()}
    assert got == {i: n for i in sets if (n := sum(i in p for p in want))}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    edges = each.where("id <> root").select(F.col("root").alias("src"), F.col("id").alias("dst"))
    assert {x["id"]: x["component"] for x in G.components(edges).collect()} == {i: root[i] for i in got}


def test_judges(spark, sets):
    r = random.Random(5)
    texts = {i: ". ".join(" ".join(r.choice(["abc", "abcd", "xabcy", "not", "12345", "é", "ok"]) for _ in range(r.randrange(5))) for _ in range(r.randrange(4))) for i in sets}
    rows = spark.createDataFrame(list(texts.items()), "id long, content string")
    words = lambda t: re.findall("[a-z0-9]{3,}", t)
    column = F.array_distinct(F.regexp_extract_all("content", F.lit("[a-z0-9]{3,}"), F.lit(0)))
    claims = F.transform(F.filter(F.split("content", r"\. "), lambda x: F.trim(x) != ""), lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("[a-z0-9]{3,}"), F.lit(0))))
    got = {(x["src"], x["dst"]): (x["claims"], x["good"]) for x in L.judged(frame(spark, sets), NEAR, rows, {"runs": column, "claims": claims}, L.supported(0.6), "claims long, good long").collect()}
    want = {}
    for a, b in brute(sets):
        each = [set(words(c)) for c in texts[b].split(". ") if c.strip()]
        if each:
            want[a, b] = len(each), sum(not ws or sum(w in texts[a] for w in ws) >= 0.6 * len(ws) for ws in each)
    assert got == want
    denied = F.when(F.array_contains(column, "not"), "not").otherwise("")
    got = {(x["src"], x["dst"]): (x["relation"], x["conflict"]) for x in L.judged(frame(spark, sets), NEAR, rows, {"words": column, "denied": denied}, L.restated(0.72), "relation string, conflict boolean").collect()}
    want = {}
    for a, b in brute(sets):
        old, new = set(words(texts[a])), set(words(texts[b]))
        both, differ = old & new, ("not" in old) != ("not" in new)
        same = both == new and len(both) / max(len(old | new), 1) >= 0.72 and not differ
        want[a, b] = ("unrelated" if not both else "unchanged" if same else "extends"), bool(both) and differ
    assert got == want


def test_no_set_is_alike(spark):
    few = frame(spark, {1: {"a1", "b1", "c1", "d1"}, 2: {"e1", "f1", "g1", "h1"}})
    assert L.alike(few, NEAR).isEmpty() and L.linked(few.where("false"), NEAR).isEmpty()


@pytest.mark.parametrize("name", ["jaccard_near_dup", "near_relations", "near_grounds"])
def test_pairs_are_not_shuffled(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and not any(x in top for x in ("Join", "Aggregate", "Repartition", "Window"))
