"""The corpus operators against plain versions of themselves, and the values that they give awkward rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import brute_force
from pyspark.sql import functions as F

from tidemark.llm import language, line_dedup, packing, pii, quality, simhash, suffix_dedup, unigram, weighted_minhash
from tidemark.llm.common import identified
from tidemark.llm.queries import PIECES


def held_out(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def words(r, n, of=300):
    return " ".join(f"w{r.randrange(of)}" for _ in range(n))


def test_quality_is_a_shrunk_quadratic_discriminant(spark):
    r = random.Random(1)
    texts = {i: words(r, r.randrange(5, 60)) + (" !!! $$ 99" * r.randrange(1, 6) if i % 2 else ". ") for i in range(90)}
    labels = {i: int(i % 2 == 0) for i in range(70)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = lambda y: spark.createDataFrame(list(y.items()), "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.quality_scores(docs, rows(labels)).collect()}
    x = {i: quality.statistics(t) for i, t in texts.items()}
    own = [np.array([x[i] for i, y in labels.items() if y == c and not held_out(i, 5, 0)]) for c in (0, 1)]
    pooled = sum(np.cov(o.T, bias=True) for o in own) / 2
    cov = []
    for o in own:
        c = (1 - quality.POOLED) * np.cov(o.T, bias=True) + quality.POOLED * pooled
        cov.append((1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + quality.FLOOR**2 * np.eye(len(c)))
    share = (len(own[1]) + 1) / (len(own[0]) + len(own[1]) + 2)
    for i, v in x.items():
        logs = [-0.5 * ((v - o.mean(0)) @ np.linalg.inv(c) @ (v - o.mean(0)) + np.linalg.slogdet(c)[1]) for o, c in zip(own, cov, strict=True)]
        want = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / quality.TEMPERATURE + np.log(share / (1 - share)), -40, 40)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["held_out"] == held_out(i, 5, 0) and got[i]["predicted"] == int(got[i]["score"] >= quality.THRESHOLD)
    turned = {i: 1 - y if held_out(i, 5, 0) else y for i, y in labels.items()}
    assert {x["doc_id"]: x["score"] for x in quality.quality_scores(docs, rows(turned)).collect()} == {i: g["score"] for i, g in got.items()}


@pytest.mark.parametrize("n", [1, 2, 9, 100, 511, 512, 513, 700, 5000])
def test_pseudonyms_of_every_length_can_be_restored(n):
    r, there, back = random.Random(n), pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", inverse=True)
    for alphabet in ("0123456789", "abcXYZ0123", "0123456789abcdef"):
        value = "".join(r.choice(alphabet) for _ in range(n))
        new = there.characters(value, "secret")
        assert back.characters(new, "secret") == value and len(new) == n
        assert n < 9 or sum(a == b for a, b in zip(new, value, strict=True)) < max(6, n / 4)  # no part is left in clear
        if alphabet.endswith("f"):
            assert back.hexadecimal(there.hexadecimal(value)) == value
    text = f"token = {'4f' * n}aa1bb2cc3, 2024-03-05T10:00, 4102209839270622, +1 (162) 555-6820, a{n}@x.org, 10.2.3.4, 219-09-9999"
    new, kinds = pii.pseudonymise(text, there)
    assert kinds == ["secret", "date", "card", "phone", "email", "ip", "ssn"] and pii.pseudonymise(new, back) == (text, kinds)


def test_ibans_are_linked_with_and_without_spaces():
    r, p, back = random.Random(5), pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", inverse=True)
    for _ in range(1000):
        rest = "".join(r.choice("0123456789") for _ in range(18))
        flat = "DE" + pii._iban_check("DE", rest) + rest
        spaced = " ".join(flat[i : i + 4] for i in range(0, 22, 4))
        (a, ka), (b, kb) = pii.pseudonymise(f"pay {flat} now", p), pii.pseudonymise(f"pay {spaced} NOW", p)
        assert ka == kb == ["iban"] and a[4:-4] == b[4:-4].replace(" ", "") and pii._iban_end(a[4:-4]) == 22
        assert pii.pseudonymise(b, back)[0] == f"pay {spaced} NOW"


def test_words_of_prose_are_no_secrets():
    p = pii.Pseudonyms(b"k")
    assert pii.pseudonymise("the secret: everything works", p)[1] == [] and pii.pseudonymise("password = hunterhunter", p)[1] == ["secret"]
    assert p.key != pii.Pseudonyms(b"other").key


def test_components_of_whole_texts(spark):
    r = random.Random(6)
    texts = [words(r, r.randrange(0, 12), 6) for _ in range(80)] + ["", None, "A b", "a B", "a b"]
    base = words(r, 300, 100).split()
    for _ in range(25):
        edited = list(base)
        edited[r.randrange(300)] = "x"
        texts.append(" ".join(edited))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts, 1)]
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            parent[root(j)] = root(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    want = sorted(((k, f"{p:016x}", least.get(root(i))) for i, ((k, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})


def test_kernel_of_shared_grams():
    a, b = (language.presence(t) for t in ("Der Hund läuft", "Der Mund, läuft!"))
    x = language.spread([a, b])
    parts, base = [], 0
    for bits in language.GRAMS.values():
        one, two = (set(p[(p >= base) & (p < base + (1 << bits))].tolist()) for p in (a, b))
        parts.append(len(one & two) / np.sqrt(len(one) * len(two)))
        base += 1 << bits
    assert float(x[0] @ x[1]) == pytest.approx(np.mean(parts), abs=1e-5) and float(x[0] @ x[0]) == pytest.approx(1, abs=1e-5)


def test_languages_are_sampled_by_least_hash(spark):
    rows = [(i, f"text {i}", "en" if i % 10 else "de") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = language.sample(docs, F.lit(True), "lang", 7, 100).select("lang", "at").collect()
    assert sorted((x["lang"], x["at"]) for x in got) == [(c, n) for c in ("de", "en") for n in range(1, 8)]
    hashes = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    best = {c: {np.packbits(np.isin(np.arange(language._WIDTH), language.presence(f"text {i}"))).tobytes() for i in sorted((i for i, _, g in rows if g == c), key=hashes.get)[:7]} for c in ("de", "en")}
    bits = language.sample(docs, F.lit(True), "lang", 7, 100).collect()
    assert all(bytes(x["bits"]) in best[x["lang"]] for x in bits)
    with pytest.raises(ValueError):
        language.sample(docs, F.lit(True), "lang", 7, 1)


def cheapest(lengths):
    """The cost of the best packing of a few pieces, over all ways to part them."""
    best = [float("inf")]

    def rec(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(packing.cost(packing._downsized(h, packing.CAPACITIES)) for h in bins))
            return
        for j, h in enumerate(bins):
            if h + lengths[i] <= max(packing.CAPACITIES):
                rec(i + 1, [*bins[:j], h + lengths[i], *bins[j + 1 :]])
        rec(i + 1, [*bins, lengths[i]])

    rec(0, [])
    return best[0]


def test_packing_against_all_ways_and_single_lengths():
    r, ratios = random.Random(3), []
    for _ in range(60):
        lengths = [r.choice((r.randrange(1, 8193), r.randrange(1, 1200), r.randrange(1, 600))) for _ in range(r.randrange(2, 7))]
        ratios.append(sum(map(packing.cost, packing.best_fit(lengths)[2])) / cheapest(lengths))
    assert np.mean(ratios) <= 1.02 and max(ratios) <= 1.2
    lengths = [min(8192, int(r.lognormvariate(6, 1.2))) for _ in range(1500)]
    cost = sum(map(packing.cost, packing.best_fit(lengths)[2]))
    for only in packing.CAPACITIES:
        _, held = packing._packed(lengths, packing.CAPACITIES, only)
        assert cost <= sum(packing.cost(packing._downsized(h, packing.CAPACITIES)) for h in held)


def test_sequences_of_identifiers_give_texts_back(spark):
    r = random.Random(8)
    rows = [(i if i else None, None if i == 3 else words(r, r.randrange(0, 900))) for i in range(30)] + [(5, words(r, 3000))]
    encoded = unigram.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).persist()
    seqs = packing.pack_ids(encoded, capacities=(256, 512, 1024), shard_tokens=4000).collect()
    assert all(len(s["ids"]) <= s["capacity"] and s["starts"][0] == 0 for s in seqs)
    total = encoded.selectExpr("sum(size(ids) + 1)").first()[0]
    assert sum(len(s["ids"]) for s in seqs) == total
    whole = {tuple(x["ids"]) for x in encoded.collect() if len(x["ids"]) < 1024}
    pieces = [tuple(s["ids"][a:b][:-1]) for s in seqs for a, b in zip(s["starts"], [*s["starts"][1:], len(s["ids"])], strict=True)]
    assert whole <= set(pieces)
    texts = {(x["doc_id"], x["text"]) for x in unigram.decode_pieces(encoded, PIECES).collect()}
    assert texts == {(i, t or "") for i, t in rows}
    encoded.unpersist()


@pytest.mark.parametrize("length", [100, 400])
def test_suffixes_with_a_hot_string(spark, length):
    r = random.Random(length)
    hot = words(r, 400)
    texts = [words(r, r.randrange(0, 60)) + (hot[r.randrange(50) : r.randrange(600, 1900)] if i % 3 == 0 else "") + words(r, r.randrange(0, 60)) for i in range(90)]
    rows = list(enumerate(texts + texts[:5]))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=length).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in got} == brute_force([(i, t.encode()) for i, t in rows], length)


def test_neighbours_of_a_repeated_run_are_dealt_together():
    r = random.Random(12)
    text = words(r, 60).encode()[:300]
    batches, found = [], [np.array([[150, 80, 0]])]  # (x, lo, hi) of an anchor: 81 windows
    for k in (1, 2):  # two batches, which hold one copy each
        items = suffix_dedup._settled_windows(suffix_dedup.windows([text], np.array([[k, 0]]), found, 100, 20))
        batches += list(suffix_dedup._deal(items, 1000, "shared"))
    rows = sorted((bucket, items) for b in batches for bucket, items in zip(*(c.to_pylist() for c in b.columns), strict=True))
    b = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "items"])
    out = [x for got in suffix_dedup._refine_windows(100)(iter([b])) for x in got.to_pylist()]
    assert len(out) <= 9 and {x["k"] for x in out} == {2}
    assert sorted(p for x in out for p in range(x["x"], x["x"] - x["hi"] + 1)) == list(range(70, 151))


def test_rows_that_share_an_identifier_keep_their_own_text(spark):
    r = random.Random(2)
    shared, unlike = words(r, 80), [words(r, 80) for _ in range(4)]
    rows = [(None, unlike[0] + "\nx\n" + shared), (None, unlike[1]), (7, unlike[2]), (7, unlike[3]), (9, shared), (9, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    gone = sorted((x["doc_id"] or 0, x["n_bytes"], x["n_removed"]) for x in suffix_dedup.suffix_dedup(docs).collect())
    size = len(shared)
    assert gone == sorted([(0, len(rows[0][1]), size), (0, len(rows[1][1]), 0), (7, len(unlike[2]), 0), (7, len(unlike[3]), 0), (9, size, 0), (9, size, 0)])
    lines = sorted((x["doc_id"] or 0, x["n_lines"], x["n_removed"]) for x in line_dedup.line_dedup(docs).collect())
    assert lines == [(0, 1, 0), (0, 3, 1), (7, 1, 0), (7, 1, 0), (9, 1, 0), (9, 1, 0)]


def test_values_of_odd_rows(spark):
    rows = [(1, "Hello there my good friends of old", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "de"), (5, "Hello there my good friends of old", "en"), (5, "Hello there my good friends of old", "en"), (None, "12 34", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    of = lambda df, *cols: sorted((tuple(x[c] for c in ("doc_id", *cols)) for x in df.collect()), key=str)
    prints = of(simhash.simhash_components(docs), "fingerprint", "component_id")
    assert {p[2] for p in prints if p[0] in (2, 3, 4)} == {2} and {p[2] for p in prints if p[0] in (1, 5)} == {1} and prints[-1][2] is None
    langs = of(language.identify_languages(docs), "lang_pred", "score", "held_out")
    assert all(p == "und" and s == 0 for i, p, s, _ in langs if i in (2, 3, 4, None)) and all(p == "en" for i, p, _, _ in langs if i in (1, 5))
    assert all(h == (i is not None and held_out(i, 4, 2)) for i, _, _, h in langs)
    packed = of(packing.pack(docs), "n_tokens", "capacity")
    assert packed == sorted([(1, 8, 512), (2, 1, 512), (3, 1, 512), (4, 1, 512), (5, 8, 512), (5, 8, 512), (None, 3, 512)], key=str)
    cws = {(i, f): (n, e) for i, f, n, e in of(weighted_minhash.edited_fingerprints(docs), "fingerprint", "n_chars", "near_edited")}
    none = "0" * weighted_minhash.DIGITS * weighted_minhash.SAMPLES
    assert {f for i, f in cws if i in (2, 3, 4)} == {none} and len({f for i, f in cws if i in (1, 5)}) == 1
    assert of(pii.pii_pseudonyms(docs, b"k"), "text", "n_pii")[1] == (2, None, 0)
    pieces = {i: n for i, n in of(unigram.encode_pieces(docs, PIECES).select("doc_id", F.size("ids").alias("n")), "n")}
    assert pieces[2] == pieces[3] == 0 and pieces[4] > 0
    assert identified(docs.withColumn("t", F.lit(1))).columns == ["k", "t", "text"]
