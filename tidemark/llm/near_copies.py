"""Near copies by SimHash over word shingles, completed to all pairs of a Jaccard similarity.

Fingerprints of five-word shingles are linked by simhash.links(), and each link is verified on the whole texts. Two texts
of Jaccard 0.8 differ in up to 10 and more of 64 bits, farther than balls within segments reach; the pairs that are
left are found under the shingles of which near copies must share one, and verified as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import NULL_KEY, connected_components, identified, materialise, remove, shuffles_removed

SEED, WORDS, THRESHOLD = 42, 5, 0.8
#: A shingle in more prefixes than this is put at the end of the order; so many of these are told apart by their counts, in so many rounds.
COMMON, RANKED, REORDERED = 24, 50_000, 2
#: A bucket up to this size is compared pair by pair; larger ones go through pivots first, for so many rounds at most.
PAIRWISE, ROUNDS = 24, 3
#: Rounds of contraction between two rounds of pivots, which need only labels that are connected; the last labels are worked out in full.
BETWEEN = 2
#: Bits of a sketch, and members of a bucket that meet in one task.
SKETCH, BLOCK = 256, 1024
_ODD = (2 * np.random.default_rng(SEED).integers(1 << 62, size=64, dtype=np.uint64) + 1).astype(np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending; fewer words are one shingle, and no words none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([digest(b" ".join(w), SEED)] if w else [], np.uint64)
    h = np.fromiter((digest(x, SEED) for x in w), np.uint64, len(w))
    n = len(w) - words + 1
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out += h[i : i + n] * _ODD[i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out ^ (out >> np.uint64(29)))


def _least(n: int, threshold: float) -> int:
    """The fewest shingles that a set of n shares with one of that similarity."""
    return math.ceil(threshold * n - 1e-9)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _prefix(x: np.ndarray, threshold: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in an order that all texts share, rare ones first: two near copies have one in common here."""
    keep = len(x) - _least(len(x), threshold) + 1 if len(x) else 0
    if not len(common):
        return x[:keep]
    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
    return x[np.lexsort((x, np.where(common[at] == x, rank[at], 0)))[:keep]]


def sketch(x: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each of SKETCH bits: sketches of two sets differ in at most as many bits as the sets have shingles that the other lacks."""
    odd = np.bincount((x >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_BITS = [f"q{i}" for i in range(SKETCH // 64)]
_SETS = "k long, t long, s long, n int, fp long, prefix array<long>, " + ", ".join(f"{q} long" for q in _BITS)


def _prefixes(words: int, threshold: float, common: np.ndarray, rank: np.ndarray):
    """Of each text: the hash of its set of shingles, their number, their SimHash, the prefix of the set, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(2)]
            bits = np.array([sketch(x) for x in sets], np.int64).reshape(-1, len(_BITS))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], pa.uint64()).view(pa.int64()),
                    pa.array([len(x) for x in sets], pa.int32()),
                    pa.array([simhash.majority(x) for x in sets], pa.uint64()).view(pa.int64()),
                    pa.array([_prefix(x, threshold, common, rank).view(np.int64) for x in sets], pa.list_(pa.int64())),
                    *map(pa.array, bits.T),
                ],
                names=["k", "t", "s", "n", "fp", "prefix", *_BITS],
            )

    return run


def _similar(words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.array([], np.uint64)
        for b in batches:
            keep = []
            for a, t, u in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if a != last:
                    last, x = a, shingles(t.as_py(), words)
                keep.append(jaccard(x, shingles(u.as_py(), words)) >= threshold - 1e-9)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of sets that are similar, from the whole texts of a document of each."""
    pairs, pairs_path = materialise(pairs.distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("s")).unionAll(pairs.select(F.col("b").alias("s"))).distinct()
    asked = sets.select("s", "k", "t").join(nodes, "s", "left_semi")
    texts = docs.join(asked, ["k", "t"]).dropDuplicates(["s"]).select("s", "text")
    texts, texts_path = materialise(texts, "texts")
    both = pairs.join(texts.select(F.col("s").alias("b"), F.col("text").alias("u")), "b").join(texts.select(F.col("s").alias("a"), F.col("text").alias("v")), "a")
    return _freed(materialise(both.select("a", "b", "v", "u").mapInArrow(_similar(words, threshold), "a long, b long"), "links")[0], pairs_path, texts_path)


def _alike(threshold: float) -> Column:
    """What holds for all similar sets: neither is much longer, and their sketches differ in no more bits than the shingles that they may not share."""
    long = F.least("n", "m") >= F.greatest("n", "m") * F.lit(threshold) - 1e-9
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(q).bitwiseXOR(F.col(f"r{q}"))) for q in _BITS))
    return long & (apart <= (F.col("n") + F.col("m")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)


def _pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b), a < b, of (h, size, s, n, component and sketch) on both sides: of one bucket, not yet connected, and alike as far as lengths and sketches tell.

    A bucket is dealt in blocks of about BLOCK members, and each two blocks meet in a task of their own.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("s"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    mine = left.select("h", own.alias("i"), every.alias("j"), "s", "n", "component", *_BITS)
    other = right.select("h", every.alias("i"), own.alias("j"), F.col("s").alias("r"), F.col("n").alias("m"), F.col("component").alias("of"), *(F.col(q).alias(f"r{q}") for q in _BITS))
    met = mine.join(other, ["h", "i", "j"]).where((F.col("component") != F.col("of")) & _alike(threshold))
    return met.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b"))


def _freed(df: DataFrame, *paths: str) -> DataFrame:
    """df, after the removal of the files that it no longer needs."""
    for path in paths:
        remove(df.sparkSession, path)
    return df


def _common_last(docs: DataFrame, words: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in many prefixes, ascending, and how many: the order puts them last, so other ones take their places.

    A few rounds settle it. At most RANKED shingles are told apart, which bounds what the tasks are sent; any order is exact.
    """
    known: dict[int, int] = {}
    common, rank = np.array([], np.uint64), np.array([], np.int64)
    for _ in range(REORDERED):
        posts = docs.mapInArrow(_prefixes(words, threshold, common, rank), _SETS).select(F.explode("prefix").alias("h"))
        often = posts.groupBy("h").count().where(F.col("count") > COMMON).orderBy(F.desc("count"), "h").limit(RANKED).collect()
        new = {r["h"]: r["count"] for r in often if r["h"] not in known}
        if not new or len(known) >= RANKED:
            break
        known |= new
        hashes = np.array(list(known), np.int64).view(np.uint64)
        order = np.argsort(hashes)
        common, rank = hashes[order], np.array(list(known.values()), np.int64)[order]
    return common, rank


def _in_components(posts: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings with the component of each set: itself where it is in none."""
    return posts.join(comps.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))


def _by_simhash(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or linked."""
    least = sets.groupBy("fp").agg(F.min("s").alias("of"))
    equal = sets.select("fp", "s").join(least, "fp").where("s <> of").select("of", "s")
    met = simhash.links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("of").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("of").alias("y")), "b").select("x", "y")
    return equal.unionAll(met).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(k, t, component): for each row its key of identified(), and its class.

    Classes are the connected components of all pairs of texts whose sets of word shingles have at least that Jaccard
    similarity. Pairs whose SimHashes are linked are verified. For the others: under any order of shingles two
    such sets share one of the first n - ceil(threshold n) + 1 of each, so these are the buckets; the order puts common
    shingles last. Pairs of a bucket whose lengths or sketches show that they cannot be similar go before anything moves. Buckets over PAIRWISE are linked through pivots first, and then whatever is outside the largest class
    of a bucket meets all others of it that it is not yet connected with: no pair is left out. Every link is verified on
    the whole texts. Texts with equal sets are worked on as one, and so are all texts without words. 64-bit hashes
    stand for shingles and for sets.
    """
    with shuffles_removed(docs.sparkSession):
        return _classes(identified(docs, id_col, text_col), words, threshold)


def _classes(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    common, rank = _common_last(docs, words, threshold)
    rows, rows_path = materialise(docs.mapInArrow(_prefixes(words, threshold, common, rank), _SETS), "shingles")
    keys, _ = materialise(rows.select("k", "t", "s"), "keys")
    sets = rows.groupBy("s").agg(F.min(F.struct("k", "t")).alias("at"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), *(F.first(q).alias(q) for q in _BITS))
    sets, sets_path = materialise(sets.select("s", "at.k", "at.t", "n", "fp", "prefix", *_BITS), "sets")
    remove(docs.sparkSession, rows_path)
    sizes, sizes_path = materialise(sets.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    posts, posts_path = materialise(sets.select("s", "n", *_BITS, F.explode("prefix").alias("h")).join(sizes, "h"), "buckets")
    remove(docs.sparkSession, sizes_path)
    small, large = posts.where(F.col("size") <= PAIRWISE), posts.where(F.col("size") > PAIRWISE)
    alone = small.withColumn("component", F.col("s"))
    links = _verified(_by_simhash(sets).unionAll(_pairs(alone, alone, threshold)), docs, sets, words, threshold)
    more = bool(large.head(1))
    for i in range(ROUNDS + 1 if more else 0):
        comps, _ = materialise(connected_components(links, rounds=BETWEEN), "components")
        now, path = materialise(_in_components(large, comps), "buckets")
        major = now.groupBy("h", "component").count().groupBy("h").agg(F.max_by("component", F.struct("count", "component")).alias("major"))
        outside = now.join(major, "h").where("component <> major").drop("major")
        work, n = outside.agg(F.sum("size")).first()[0] or 0, now.count()
        if last := i == ROUNDS or work <= 8 * n:
            found = _pairs(outside, now, threshold)
        else:
            by = F.xxhash64("s", F.lit(i))
            one = F.struct("s", "n", "size", "component", *_BITS)
            pivots = now.groupBy("h").agg(F.array(F.min_by(one, by), F.max_by(one, by)).alias("p"))
            found = _pairs(pivots.select("h", F.explode("p").alias("p")).select("h", "p.*"), now, threshold)
        if work:
            links = links.unionAll(_verified(found, docs, sets, words, threshold))
        remove(docs.sparkSession, path)
        if last:
            break
    comps, _ = materialise(connected_components(links), "components")
    for path in (sets_path, posts_path):
        remove(docs.sparkSession, path)
    return keys.join(comps.withColumnRenamed("node", "s"), "s", "left").select("k", "t", F.coalesce("component", "s").alias("component"))


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that come first in their class, by identifier with nulls last; repeated rows stay as many."""
    classes = near_copy_classes(docs, id_col, text_col, words, threshold)
    first = classes.groupBy("component").agg(F.min(F.struct("k", "t")).alias("first")).select(F.col("first.k").alias("_k"), F.col("first.t").alias("_t")).distinct()
    k = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY))
    t = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.join(first, (k == F.col("_k")) & (t == F.col("_t")), "left_semi")
