"""The corpus operators against brute force, SQL, another implementation, and on awkward rows."""

import collections
import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
import xxhash

from brute import brute_force
from tidemark.llm import language, line_dedup, packing, pii, quality, simhash, stream_dedup, suffix_dedup, unigram, weighted_minhash
from tidemark.llm.common import connected_components
from tidemark.llm.queries import OP3_SQL, OP4_SQL, PIECES

KIND = "doc_id long, text string, lang string, source string, n_chars long, k long, component string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, a long text, and extra columns whose names operators use."""
    long = " ".join(f"word{i % 997}" for i in range(40_000))
    rows = [(1, "Hello there my good friends of old", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "de"), (5, "Hello there my good friends of old", "en"), (5, "Hello there my good friends of old", "en"), (None, "no identifier here", "en"), (7, long, "en"), (8, long + " more", "de")]
    return spark.createDataFrame([(i, t, lang, "s", 0, 9, "x") for i, t, lang in rows], KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def _labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None)], "doc_id long, quality int")


APPLY = {
    "quality": lambda d, s: quality.quality_scores(d, _labels(s)),
    "pii": lambda d, s: pii.pii_pseudonyms(d, b"key"),
    "lines": lambda d, s: line_dedup.line_dedup(d),
    "simhash": lambda d, s: simhash.simhash_components(d),
    "language": lambda d, s: language.identify_languages(d),
    "packing": lambda d, s: packing.pack(d).where("piece = 0"),
    "pieces": lambda d, s: unigram.encode_pieces(d, PIECES),
    "suffix": lambda d, s: suffix_dedup.suffix_dedup(d),
    "cws": lambda d, s: weighted_minhash.edited_fingerprints(d),
}


@pytest.mark.parametrize("name", APPLY)
def test_odd_rows_and_empty_tables(spark, odd, empty, name):
    got = APPLY[name](odd, spark).select("doc_id").toPandas()["doc_id"]
    assert sorted(got.fillna(0)) == [0, 1, 2, 3, 4, 5, 5, 7, 8]
    assert APPLY[name](empty, spark).count() == 0


def test_exact_dedup_reads_odd_rows(spark, odd, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd")
    got = {r["doc_id"]: r for r in stream_dedup.stream_exact_dedup(spark, f"{tmp_path}/odd").collect()}
    assert got[5]["keep_id"] == 1 and got[5]["group_size"] == 3 and not got[5]["kept"]
    assert got[3]["keep_id"] == 2 and got[4]["keep_id"] == 4 and got[None]["kept"]
    empty.write.parquet(f"{tmp_path}/none")
    assert stream_dedup.stream_exact_dedup(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("digits", [64, 1])
def test_exact_dedup_tells_colliding_digests_apart(spark, tmp_path, digits):
    r = random.Random(1)
    rows = [(i, r.choice(["a b", "a  b", "a\tb", "c", "d e f", "", None, "g"])) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    got = sorted(map(tuple, stream_dedup.stream_exact_dedup(spark, f"{tmp_path}/t", digits=digits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas()  # noqa: F841
    c = duckdb.connect()
    c.register("documents", documents)
    assert got == sorted(c.sql(OP4_SQL).fetchall())


def test_stream_state_goes_on(spark, tmp_path):
    part = lambda rows, mode: spark.createDataFrame(rows, "doc_id long, text string").write.mode(mode).parquet(f"{tmp_path}/t")
    part([(5, "x"), (6, "y")], "overwrite")
    stream_dedup.digest_state(spark, f"{tmp_path}/t", checkpoint=f"{tmp_path}/c")
    part([(2, "x"), (7, "z")], "append")
    state = {r["first_k"]: r["seen"] for r in stream_dedup.digest_state(spark, f"{tmp_path}/t", checkpoint=f"{tmp_path}/c").collect()}
    assert state == {2: 2, 6: 1, 7: 1}


def test_components_of_a_random_graph(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root(n) == c for n, c in got.items())
    assert set(got) == {n for e in edges for n in e if e[0] != e[1]}


def test_links_keep_all_near_pairs_together(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(8):
            prints.add(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    prints |= {base[0] ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(12), 2)}  # many within a bit of one another
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {x["node"]: x["component"] for x in connected_components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    for a, b in itertools.combinations(prints, 2):
        s, t = (x - (1 << 64) if x >> 63 else x for x in (a, b))
        if (a ^ b).bit_count() <= 2:
            assert got[s] == got[t]


def test_fingerprint_by_hand():
    text = "Ab c\tD e"
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"ab c d", b"c d e")]
    assert simhash.fingerprint(text) == sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(" \n") == 0 and simhash.fingerprint("Éa B") == xxhash.xxh64_intdigest("Éa b".encode(), 42)


def test_suffix_dedup_against_all_strings(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abü") for _ in range(6))
    shared = ["".join(word() for _ in range(9)) for _ in range(4)]
    texts = ["".join(r.choice([word(), word(), r.choice(shared)]) for _ in range(r.randrange(0, 40))) for _ in range(60)] + ["ab" * 200, "ab" * 150]
    old, suffix_dedup.CHUNK = suffix_dedup.CHUNK, 200  # long texts are cut
    try:
        rows = [(i, t) for i, t in enumerate(texts)]
        want = brute_force([(i, t.encode()) for i, t in rows], 30)
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=30, q=8).collect()
        assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in got} == want
    finally:
        suffix_dedup.CHUNK = old


def test_anchors_with_chunks_match_whole_texts():
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcd") for _ in range(n)) for n in (10, 400, 99, 100, 1500)]
    old = suffix_dedup.CHUNK
    try:
        suffix_dedup.CHUNK = 1 << 17
        keys = np.stack([np.arange(5), np.zeros(5, int)], axis=1)
        whole = suffix_dedup.anchors(texts, keys, 100, 20)
        suffix_dedup.CHUNK = 128
        cut = suffix_dedup.anchors(texts, keys, 100, 20)
    finally:
        suffix_dedup.CHUNK = old
    key = lambda items: {(int(k), int(x), int(q)) for k, x, q in zip(items["k"], items["x"], items["q"], strict=True)}
    assert key(whole) == key(cut)


def test_line_dedup_same_as_sql(spark):
    r = random.Random(4)
    lines = ["alpha", " beta ", "gamma", "", "delta", " ".join(f"w{i}" for i in range(55))]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 9)))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_lines"], x["n_removed"], x["n_runs"], hashlib.sha256(x["text"].encode()).hexdigest()) for x in line_dedup.line_dedup(df).collect())
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    assert got == sorted(c.sql(OP3_SQL).fetchall())


def test_pseudonyms_keep_format_and_link():
    p = pii.Pseudonyms(b"key")
    text = "card 4102209839270622, +1 (642) 555-8592 at 23.184.127.85, ada.77@mail2.example.com, 1980-02-29; token = \"24be64439e3e49cf\""
    new, kinds = pii.pseudonymise(text, p)
    assert sorted(kinds) == ["card", "date", "email", "ip", "phone", "secret"]
    assert pii.pseudonymise(text, pii.Pseudonyms(b"key"))[0] == new != text and pii.pseudonymise(text, pii.Pseudonyms(b"other"))[0] != new
    card = new.split()[1].rstrip(",")
    assert len(card) == 16 and pii.luhn_digit(card[:-1]) == card[-1]
    for private in ("4102209839270622", "555-8592", "23.184.127.85", "ada.77@", "1980-02-29", "24be64439e3e49cf"):
        assert private not in new
    assert pii.pseudonymise("serial 4102209839270623 and 999.1.1.1", p) == ("serial 4102209839270623 and 999.1.1.1", [])


@pytest.mark.parametrize("size", [2, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    p = pii.Pseudonyms(b"k")
    assert sorted(p.permute(i, size, "t") for i in range(size)) == list(range(size))


def test_best_fit_fills_and_shrinks():
    r = random.Random(9)
    lengths = [r.randrange(0, 8193) for _ in range(500)]
    bins, offsets, caps = packing.best_fit(lengths)
    held = collections.defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        held[b].append((o, n))
    for b, items in held.items():
        end = 0
        for o, n in sorted(items):
            assert o == end
            end += n
        assert caps[b] == min(c for c in packing.CAPACITIES if c >= end)


def test_packing_keeps_every_token(spark):
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate([0, 5, 20_000, 8191, 700])], "doc_id long, text string")
    rows = packing.pack(docs, shard_tokens=3000).toPandas()
    assert rows.groupby("doc_id")["n_tokens"].sum().tolist() == [1, 6, 20_001, 8192, 701] and rows["n_tokens"].max() == 8192


def test_pieces_round_trip_and_score():
    pieces = unigram.log_scores(unigram.read_pieces(PIECES))
    e = unigram.Unigram(pieces)
    texts = ["Hello  world", " x", "日本語 🎉\n\tü", "a" * 300, "", "$$$ 123"]
    ids = e.encode(texts)
    assert [e.decode(i) for i in ids] == texts

    def best(word):  # plain dynamic programming over characters
        known = {p: s for p, s, kind in pieces if kind == unigram.NORMAL}
        score = [0.0] + [-1e9] * len(word)
        for i, j in itertools.combinations(range(len(word) + 1), 2):
            s = known.get(word[i:j], float(e.unknown) if j == i + 1 else None)
            if s is not None:
                score[j] = max(score[j], score[i] + s)
        return score[-1]

    for t, i in zip(texts[:1] + texts[5:], ids[:1] + ids[5:], strict=True):
        assert sum(e.scores[i]) == pytest.approx(best("▁" + t.replace(" ", "▁")), abs=1e-2)


def test_collision_rate_is_generalised_jaccard(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(12)]
    n = weighted_minhash.SAMPLES
    got = {x["doc_id"]: x["fingerprint"] for x in weighted_minhash.cws_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    errors = []
    for a, b in itertools.combinations(range(12), 2):
        x, y = collections.Counter(texts[a].split()), collections.Counter(texts[b].split())
        d = weighted_minhash.DIGITS
        same = sum(got[a][i : i + d] == got[b][i : i + d] for i in range(0, n * d, d)) / n
        errors.append(same - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.085


def test_edited_texts(spark):
    texts = {1: "one two three four", 2: None, 4: "äöü x", 9: "one two three four"}
    got = {x["doc_id"]: x for x in weighted_minhash.edited_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        own, other = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        h = len(own) // 2
        assert got[k]["edited_sha256"] == hashlib.sha256((own[: len(own) - h] + other[:h]).encode()).hexdigest() and got[k]["n_chars"] == len(own)
    assert got[1]["fingerprint"] == got[9]["fingerprint"] and got[1]["near_next"] == 1.0


def test_classifiers_hold_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert len(q) > 50 and (q["predicted"] == q["quality"]).mean() > 0.95
    p = language.identify_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(p) > 200 and (p["lang_pred"] == p["lang"]).mean() > 0.95
