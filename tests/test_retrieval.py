"""Arms, blocks of vectors and chains on small fixtures."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.plans import search

DIR = "/root/testdata/sf0.001"


def test_arms_answer_the_same_questions(spark):
    """Where two arms never agree, fusing them shows nothing."""
    arms = search._arms(spark, DIR).toPandas()
    both = arms.groupby(["query_id", "id"]).size()
    assert set(arms["arm"]) == {"lexical", "semantic"} and (both == 2).mean() >= 0.1


def test_blocks_of_vectors_find_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    r = np.random.default_rng(3)
    v = r.normal(size=(90, 5))
    v[7], v[8] = v[3], 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None)], "id long, embedding array<double>")
    asked = rows.where("id % 20 = 0").toDF("query_id", "q")
    got = {(x["query_id"], x["id"]): (x["score"], x["rank"]) for x in R.top_k(R.nearest(asked, rows, 4), 4).collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    for q in range(0, 90, 20):
        best = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(90) if i not in (q, 8))[:4]
        assert [got[q, i] for _, i in best] == [(-s, n) for n, (s, _) in enumerate(best, 1)]
    assert R.nearest(asked, rows, least=0.5).count() == sum(float(unit[q] @ unit[i]) >= 0.5 - 5e-7 for q in range(0, 90, 20) for i in range(90) if i != q)


def test_chains_of_any_length_and_cycles(spark):
    r = random.Random(4)
    parent = {i: (r.randrange(i) if i % 97 else None) for i in range(300)} | {i: i - 1 for i in range(1001, 1100)} | {1000: None}
    rows = spark.createDataFrame(list(parent.items()), "id long, up long")
    for x in G.chains(rows, "up").collect():
        at, n = x["id"], 0
        while parent[at] is not None:
            at, n = parent[at], n + 1
        assert (x["root"], x["steps"]) == (at, n)


def test_types_of_edges_are_walked_one_by_one(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (2, 4, "a")], "src long, dst long, type string")
    got = {(x["start"], x["id"]): x["hops"] for x in G.k_hops(edges, spark.createDataFrame([(1,)], "id long"), 3).collect()}
    assert got == {(1, 2): 1, (1, 4): 2}


def test_running_results_of_words_are_those_of_all_pairs(spark, monkeypatch):
    """Few rows leave a task, ties at the edge of a result go by id, and parts of queries and small blocks change nothing."""
    monkeypatch.setattr(R, "HELD", 40)
    r = random.Random(5)
    texts = {i: " ".join(r.choice("aa bb cc dd ee ff".split()) for _ in range(r.randrange(9))) for i in range(120)} | {i: "aa bb" for i in range(200, 260)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    docs = spark.createDataFrame([(i, t, f"k{i % 2}") for i, t in texts.items()], "id long, content string, kind string").repartition(3)
    asked = spark.createDataFrame([(0, "aa zz bb", None), (210, "aa bb", "k0"), (3, "cc", "k1"), (4, "", None)], "query_id long, text string, wanted string")
    found = R.bm25(asked, docs, {"content": F.col("content")}, 5, whole=True, own=True, kind="kind").cache()
    got = {(x["query_id"], x["rank"]): (x["id"], x["score"], x["all_terms"]) for x in R.top_k(found.withColumn("s", F.col("score") + 1e6 * F.col("all_terms").cast("int")), 5, "s").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = {i: t.split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    for q, terms, kind in ((0, {"aa", "bb", "zz"}, None), (210, {"aa", "bb"}, "k0"), (3, {"cc"}, "k1")):
        rows = []
        for i, w in words.items():
            if i != q and kind in (None, f"k{i % 2}") and terms & set(w):
                df = {t: sum(t in x for x in words.values()) for t in terms}
                s = sum(np.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in terms & set(w))
                rows.append((not terms <= set(w), -round(s, 6), i))
        assert [got[q, n] for n in range(1, 6)] == [(i, -s, not part) for part, s, i in sorted(rows)[:5]]
    assert (4, 1) not in got and found.count() <= 3 * 5 * 3


def test_no_round_of_chains_goes_through_the_driver(spark):
    from tidemark.plans import records

    for made in (records.supersession_history, records.open_head):
        assert "Broadcast" not in made(spark, DIR)._jdf.queryExecution().executedPlan().toString()
