"""Resampling and the source audit against SQL over the tables and plain Python over awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import divergence, queries, resampling

DIR = "/root/testdata/sf0.001"
ID = "doc_id long, text string, k long, n long, score long, line string, term string"


def rows_of(frame):
    return sorted((tuple(None if v is None or v is pd.NA or v != v else v for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", ["op11_warc", "op12_resampling", "op13_divergence"])
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got, want = queries.queries()[name](spark, DIR).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def docs_of(spark, texts):
    """Documents with columns whose names clash with those that the operators add."""
    return spark.createDataFrame([(i, t, 1, 2, 3, "a", "b") for i, t in texts], ID).repartition(3)


def test_features_of_lines_and_borders_are_those_of_the_text():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["a", "b", "Ü", " ", " ", "\n", "\n\n", "9", "."]) for _ in range(r.randrange(60))).encode()
        for n in (1, 2, 3, 5):
            lines = Counter(f for x in text.split(b"\n") for f in resampling.features_of(resampling.words_of(x), n))
            assert lines + Counter(resampling.crossing(text, n) if n > 1 else []) == Counter(resampling.features_of(resampling.words_of(text), n))


@pytest.mark.parametrize("n", [1, 3])
def test_draw_is_that_of_a_plain_version(spark, n):
    r = random.Random(n)
    line = " ".join(f"w{r.randrange(9)}" for _ in range(8))
    texts = [(i, "\n".join(r.choice([line, " ".join(f"W{r.randrange(40)}" for _ in range(r.randrange(12)))]) for _ in range(r.randrange(6)))) for i in range(60)]
    texts += [(60, None), (61, ""), (None, line * 9), (None, line * 9), (63, " .. "), (64, "é" * 50_000), (65, "z " * 30_000)]
    target = [(1, "w1 w2 w3"), (2, None), (3, "W1 W2")]
    got = resampling.resample(docs_of(spark, texts), docs_of(spark, target), max_words=n, buckets=97, least_words=10, percent=30).collect()
    hashed = lambda rows: Counter(zlib.crc32(f) % 97 for _, t in rows for f in resampling.features_of(resampling.words_of((t or "").encode()), n))
    s, t = hashed(texts), hashed(target)
    want, able = [], []
    for i, text in texts:
        words = resampling.words_of((text or "").encode())
        f = resampling.features_of(words, n)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 97) / ((s[b] + 1) * (sum(t.values()) + 97)))) for b in (zlib.crc32(x) % 97 for x in f)]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        able += [want[-1]] if len(words) >= 10 else []
    for rank, row in enumerate(sorted(able, key=lambda x: (-x[3], x[0] is None, x[0]))[: 30 * len(able) // 100], 1):
        row[4] = rank
    assert sorted(map(repr, map(list, got))) == sorted(map(repr, want)) and any(x[4] for x in want)


def test_draw_from_nothing_and_without_a_target(spark):
    none = docs_of(spark, [])
    assert resampling.resample(none, none).collect() == []
    alone = resampling.resample(docs_of(spark, [(1, "a b c d"), (2, "a a a a")]), none, least_words=2, percent=50).collect()
    assert sorted(x["rank"] or 0 for x in alone) == [0, 1]


def audit(rows, least, top):
    term_docs, group, lang_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        own = Counter(divergence.terms_of((text or "").encode()))
        lang, source = lang or "", source or ""
        term_docs[lang].update(own.keys()), group[lang, source].update(own), lang_n[lang].update(own)
    out = []
    for (lang, source), n in group.items():
        kept = [t for t in lang_n[lang] if term_docs[lang][t] >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        own, whole = p(n), p(lang_n[lang])
        pairs = [(s.encode(), sum(f(own[t], x[t]) for t in kept)) for (k, s), m in group.items() if k == lang and s != source for x in [p(m)]]
        terms = [(t, f(own[t], whole[t])) for t in kept if n[t] and own[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0]))
            out += [(lang, source, part, i.decode(), v, r) for r, (i, v) in enumerate(ranked[: None if part == "pair" else top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [256, 2])
def test_audit_is_that_of_a_plain_version(spark, monkeypatch, block):
    r = random.Random(9)
    text = lambda words: " ".join(f"{r.choice('abcdé')}{r.choice('XyZß')}" * r.randrange(1, 3) for _ in range(words))
    rows = [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "S3", "", None, "t5"]), text(r.randrange(30))) for _ in range(120)]
    rows += [("fr", "a", "rare words"), ("fr", "b", None), ("it", "only", "one source"), ("en", "empty", ""), ("en", "s1", "É" * 20_000), ("en", "s1", "same same"), ("en", "s1", "same same")]
    docs = spark.createDataFrame([(a, b, t, "x", 1, 2, 3) for a, b, t in rows], "lang string, source string, text string, term string, n long, p long, place long").repartition(4)
    monkeypatch.setattr(divergence, "_BLOCK", block)
    got = divergence.source_divergence(docs, least_docs=5, top=4).collect()
    assert sorted(map(tuple, got)) == audit(rows, 5, 4)
    assert divergence.source_divergence(docs.limit(0)).collect() == []


def test_skyband_keeps_what_few_dominate():
    r = np.random.default_rng(2)
    for k in (1, 3, 10):
        n, m, t = r.integers(0, 40, 1500), r.integers(0, 40, 1500), r.permutation(1500)
        over = (n[:, None] >= n) & (m[:, None] <= m) & (t[:, None] < t)
        assert (divergence.dominated(n, m, t, k) == (over.sum(0) >= k)).all()
