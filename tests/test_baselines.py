"""Baselines grow with turns: a stream, or states that were kept, give what one pass over all turns gives."""

import random

from tidemark.operators import baselines as B


def turns(n):
    r = random.Random(6)
    words = ["we", "you", "our", "is", "run", "sweetheart", "tree", "the", "house", "your"]
    return [(r.choice(["a", "b", "c"]), ". ".join(" ".join(r.choice(words) for _ in range(r.randrange(1, 20))) for _ in range(r.randrange(1, 5)))) for _ in range(n)] + [("d", "we run"), ("a", None), ("a", "..."), (None, "you")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_states_of_any_split_add_up(spark):
    all_ = turns(120)
    frame = lambda x: spark.createDataFrame(x, "agent string, text string").repartition(3)
    whole = rows(B.state(B.measured(frame(all_))).select("agent", "measure", "bucket", "n", "total", "squares"))
    for parts in (2, 5):
        states = [B.state(B.measured(frame(all_[i::parts]))) for i in range(parts)]
        kept = states[0]
        for s in states[1:]:
            kept = B.merged(kept, s)
        assert rows(kept.select("agent", "measure", "bucket", "n", "total", "squares")) == whole


def test_a_stream_equals_one_pass(spark, tmp_path):
    all_ = turns(60)
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(all_[i::3], "agent string, text string").coalesce(1).write.mode("append").parquet(source)
        out = str(tmp_path / f"out{i}")
        keep = lambda df, n, out=out: df.write.mode("overwrite").parquet(out)
        B.growing(spark.readStream.schema("agent string, text string").parquet(source)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        assert rows(spark.read.parquet(out)) == rows(B.state(B.measured(spark.createDataFrame([t for k in range(i + 1) for t in all_[k::3]], "agent string, text string"))))


def test_medians_are_close_and_few_turns_have_the_common_baseline(spark):
    values = [(a, "we", v) for a, n in (("a", 501), ("b", 4)) for v in [random.Random(n).randrange(0, 100_000) for _ in range(n)]]
    got = {x["agent"]: x for x in B.baseline(B.state(spark.createDataFrame(values, "agent string, measure string, value long"))).collect()}
    own = sorted(v for a, _, v in values if a == "a")
    assert abs(got["a"]["median"] - own[250] / 1000) <= B.ERROR * own[250] / 1000 + 1e-6 and abs(got["a"]["mean"] - sum(own) / 501 / 1000) < 1e-6
    assert got["b"]["usual"] == B.USUAL["we"] and got["a"]["usual"] == got["a"]["mean"]
