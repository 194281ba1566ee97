"""Every stage of the pipeline by itself, and all together."""

import random

import corpus_pipeline
from corpus_pipeline import STAGES
from tidemark.llm import line_dedup, packing, pii, quality

KIND = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DIR = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t in texts], KIND).repartition(3)


def test_stages_are_those_that_are_asked_for():
    assert [n for n, _ in STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "PII", "best-fit packing"]


def test_rejected_documents_go(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    scores = {x["doc_id"]: x["predicted"] for x in quality.quality_scores(docs, spark.read.parquet(f"{DIR}/labels.parquet")).collect()}
    kept = corpus_pipeline.good_quality(spark, docs, DIR)
    assert kept.columns == COLUMNS and sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, p in scores.items() if p) and 0 in scores.values()


def test_repeated_lines_and_personal_data_go_and_columns_stay(spark):
    r = random.Random(1)
    passage = "\n".join(" ".join(f"w{r.randrange(99)}" for _ in range(12)) for _ in range(4))
    texts = [(1, passage + "\nmail ada@x.org"), (2, "other\n" + passage), (3, None), (None, "call +1 (642) 555-8592"), (5, "same"), (5, "same")]
    docs = docs_of(spark, texts)
    lines = {(x["doc_id"], x["text"]) for x in line_dedup.line_dedup(docs).collect()}
    got = corpus_pipeline.no_repeated_lines(spark, docs, DIR)
    rows = got.collect()
    assert got.columns == COLUMNS and len(rows) == 6 and {(x["doc_id"], x["text"]) for x in rows} == lines and (2, "other") in lines
    assert all(x["source"] == f"s{x['doc_id']}" and x["n_chars"] == len(x["text"]) for x in rows)
    key = pii.Pseudonyms(pii.key_of(spark))
    hidden = corpus_pipeline.no_personal_data(spark, docs, DIR)
    want = sorted((str(i), str(t if t is None else pii.pseudonymise(t, key)[0])) for i, t in texts)
    assert hidden.columns == COLUMNS and sorted((str(x["doc_id"]), str(x["text"])) for x in hidden.collect()) == want


def test_all_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, DIR).toPandas()
    known = {x["doc_id"] for x in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()}
    assert set(out["doc_id"]) < known and len(out) > 50
    sums = out.groupby(["shard", "bin"]).agg(held=("n_tokens", "sum"), capacity=("capacity", "first"))
    assert (sums["held"] <= sums["capacity"]).all() and set(sums["capacity"]) <= set(packing.CAPACITIES)


def test_columns_with_clashing_names(spark):
    """Columns that the stages use inside are left behind, and change nothing."""
    line = "some words of a line that is long enough to matter in a document"
    texts = [(1, line + "\nmail ada@x.org"), (2, line + "\nmail ada@x.org"), (None, None), (3, "")]
    docs = docs_of(spark, texts)
    more = docs.selectExpr("*", "7 as id", "8 as k", "9 as t", "1 as _k", "2 as _t", "3 as component", "4 as h", "'x' as s", "5 as score")
    for stage in (corpus_pipeline.no_repeated_lines, corpus_pipeline.no_near_duplicates, corpus_pipeline.no_personal_data):
        got = stage(spark, more, DIR)
        assert got.columns == COLUMNS and sorted(map(str, got.collect())) == sorted(map(str, stage(spark, docs, DIR).collect()))
    scored = corpus_pipeline.good_quality(spark, more, DIR)
    assert scored.columns == COLUMNS
    assert sorted(map(str, scored.collect())) == sorted(map(str, corpus_pipeline.good_quality(spark, docs, DIR).collect()))
