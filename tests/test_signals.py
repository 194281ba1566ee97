"""Signals of texts on hand-written lines and on random ones, where the synthetic tables hold none."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import plain

from tidemark.functions import signals as S
from tidemark.operators import matching as M
from tidemark.plans import judging

LINES = [
    "We decided to ship on Monday morning", "we decided to ship on monday morning again", "- I never use tabs in this project", "Please stop in the end doing all of it",
    "3. **v2.10** went out to everyone today", "The bug is back and it doesn't work at all", "That is a beautiful and important day for us", "import nothing that was decided and shipped",
    "short", "12345 67890 !!! ??? 0000 bug", "debugging is no word of the list, nor is éissue", "It turns out, perhaps maybe, we love what you know... to be fair, I think so!", "",
    "Thanks! I miss you, haha", "ICH HASSE DAS, UGH! UGH!", "WE TRUST YOU AND US AND OURS", "what if they stop it and find that out later ❤ 😢",
]


@pytest.fixture(scope="module")
def said(spark, tmp_path_factory):
    r = random.Random(5)
    rows = [(i, t, "user", "\n".join(r.choices(LINES, k=r.randint(1, 7)))) for i in range(40) for t in range(3)] + [(99, 0, "user", None), (99, 1, "user", ""), (100, 0, "user", "x " * 50_000)]
    rows += [(101, n, "user", line) for n, line in enumerate(LINES)]
    folder = str(tmp_path_factory.mktemp("said"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(i, f"small bolt {i}") for i in range(24)], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["extract_moments", "bloom_gate", "emotion_detect"])
def test_same_as_sql_on_lines(spark, said, name):
    db = duckdb.connect()
    for t in ("conversations", "part"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{said}/{t}.parquet/*.parquet')")
    f, sql = judging.REGISTERED[name]
    got = f(spark, said).toPandas()
    assert len(got) > 40 and plain(got) == plain(db.sql(sql).df())


def test_moments_by_hand(spark, said):
    got = {r["turn"]: (r["kind"], r["sentence"]) for r in judging.extract_moments(spark, said).where("conv_id = 101").collect()}
    assert got == {
        0: ("decision", LINES[0]), 1: ("decision", LINES[1]), 2: ("preference", "I never use tabs in this project"), 4: ("milestone", "v2.10 went out to everyone today"), 5: ("problem", LINES[5]),
        6: ("emotional", LINES[6]), 11: ("problem", LINES[11]), 3: ("preference", LINES[3]), 16: ("preference", "what if they stop it and find that out later ❤ 😢"),
    }


def test_feelings_by_hand(spark):
    f = S.feeling(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in ("I love it", "haha!", "so sad", "SO VERY ANGRY!", None, "ok ❤", "thanks, I wonder")], "t string")
    got = [(r["l"], r["i"], r["v"]) for r in rows.select(f["labels"].alias("l"), f["intensity"].alias("i"), f["valence"].alias("v")).collect()]
    assert got == [(["love"], 7.0, 0.9), (["joy"], 6.0, 0.7), (["sadness"], 4.0, -0.3), (["anger"], 8.0, -0.5), (["neutral"], 0.0, 0.0), (["love"], 7.0, 0.9), (["curiosity", "gratitude"], 6.0, 0.8)]


def test_quadrants_by_hand(spark):
    rows = spark.createDataFrame([("fix the bug", ["x"], 1.0, False), ("nothing", ["Idea"], 1.0, False), ("nothing", [], 8.0, True), (None, None, None, None), ("bond bug", [], 0.0, False)], "t string, tags array<string>, i double, p boolean")
    none = F.lit(None).cast("string")
    q = S.quadrant(F.col("t"), F.col("tags"), F.col("i"), F.col("p"), F.lit(None).cast("array<string>"), none, none)
    assert [r[0] for r in rows.select(q).collect()] == ["work", "wild", "soul", "work", "core"]


def test_differences(spark):
    better = spark.createDataFrame([(i, 0.5 if i % 4 else -0.1) for i in range(40)], "query_id long, diff double")
    r = M.paired_delta(better, 400).first()
    assert r["n"] == 40 and r["wins"] == 30 and r["losses"] == 10 and 0 < r["low"] < r["mean"] < r["high"] and r["beats_noise"]
    r = M.paired_delta(better.where("false"), 50).first()
    assert r["n"] == 0 and r["mean"] is None and not r["beats_noise"]


def test_anchors_without_match(spark):
    a = spark.createDataFrame([("a", "joy", None), ("b", "fear", 0.4)], "anchor string, emotion string, weight double")
    m = spark.createDataFrame([(1, "joy", 0.7), (2, "calm", 1.0)], "id long, emotion string, weight double")
    assert [tuple(r) for r in M.anchors(m, a).collect()] == [(1, "a", 1.0, 1)]
