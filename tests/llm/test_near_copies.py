"""The near-dedup stage of the pipeline against all pairs."""

import itertools
import random

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(x, y):
    return (len(x & y) / len(x | y) if x | y else 1.0) >= 0.8


def kept(rows):
    """Positions of the first of each class, by doc_id with nulls last."""
    s, parent = [sets(t or "") for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if similar(s[i], s[j]):
            parent[root(j)] = root(i)
    best = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0])):
        best.setdefault(root(i), i)
    return sorted((rows[i] for i in best.values()), key=str)


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND).repartition(3)
    return sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.no_near_duplicates(spark, docs, "").collect()), key=str)


def edited(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.randrange(10**9)}"
    return out


def test_stage_finds_planted_near_copies(spark):
    r = random.Random(8)
    new = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, texts = new(40), []
    for n in (30, 90, 200, 400) * 4:
        base = new(n)
        texts += [base, *(base[: round(n * share)] + new(round(n * (1 - share))) for share in (0.95, 0.92, 0.9, 0.88))]
        texts += [edited(r, base, max(1, n // 60)), base[n // 9 :], base[n // 12 : -n // 30]]
    hot = new(60)
    texts += [edited(r, hot, 1) for _ in range(70)]  # buckets over PAIRWISE, with pairs below 0.8
    texts += [passage + new(60) for _ in range(60)]  # a common passage, no copies
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    assert sum(0.8 <= len(a & b) / len(a | b) < 0.95 for a, b in itertools.combinations([sets(t) for _, t in rows], 2)) > 50
    assert stage(spark, rows) == kept(rows)


def test_stage_with_odd_rows(spark):
    words = " ".join(f"a{i}" for i in range(60))
    rows = [(None, words + " b"), (None, "no copy of anything that is here"), (4, words), (5, "Hello"), (6, "hello"), (7, ""), (8, None), (9, " \n")]
    assert stage(spark, rows) == kept(rows)
    assert stage(spark, []) == []


def test_sketches_differ_in_no_more_bits_than_sets_differ():
    import numpy as np

    from tidemark.llm import near_copies

    r = np.random.default_rng(3)
    for _ in range(200):
        x, y = (np.unique(r.integers(0, 1 << 62, r.integers(0, 400), dtype=np.uint64)) for _ in range(2))
        y = np.union1d(r.permutation(x)[: r.integers(0, len(x) + 1)], y[: r.integers(0, len(y) + 1)])
        bits = int(np.unpackbits((near_copies.sketch(x) ^ near_copies.sketch(y)).view(np.uint8)).sum())
        assert bits <= len(np.setxor1d(x, y))


def test_blocks_and_rounds_lose_no_pair(spark, monkeypatch):
    from tidemark.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", 3)
    monkeypatch.setattr(near_copies, "PAIRWISE", 4)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(edited(r, base, r.randrange(4)))) for i in range(40)]
    rows += [(100 + i, " ".join(base[: 40 + i] + [f"x{i}{j}" for j in range(20 - i)])) for i in range(20)]
    assert stage(spark, rows) == kept(rows)
