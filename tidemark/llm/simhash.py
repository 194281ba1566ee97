"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, id_of, keyed, materialise

SEED = 42
#: Segments of a fingerprint, and the radius of the ball that is enumerated in each: links have at most SEGMENTS * RADIUS differing bits.
SEGMENTS, SEGMENT_BITS, RADIUS = 2, 32, 1
_BLOCK = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half of the hashes of the word shingles. No words: 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change case, only ASCII white space parts
    if not w:
        return 0
    shingles = list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))) if len(w) >= words else [b" ".join(w)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(shingles), _BLOCK):
        h = np.fromiter((digest(s, SEED) for s in shingles[i : i + _BLOCK]), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the 64-bit hashes; without any, 0."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(k, fp): one row per row of docs, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["k", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "k long, fp long")


def _ball(fp: Column, segment: int) -> list[Column]:
    """The words that differ from a fingerprint in one bit of one segment."""
    bits = range(SEGMENT_BITS * segment, SEGMENT_BITS * (segment + 1))
    return [fp.bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in bits]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, of distinct fingerprints (fp) that differ in at most 2 bits; their components are those of all such pairs.

    The table of words is keyed by what lies in the ball of radius 1 around each segment of a fingerprint, the other
    segment beside it. Two fingerprints differ in 2 bits at most exactly if they meet under a word: under the first
    itself if one bit differs; under one that takes one flip from each otherwise, whether both flips fall into one
    segment or into two. So a fingerprint makes 65 rows however many lie close to it, and a word has at most 65
    fingerprints. All of a word are linked to its least, which keeps them together, and every link is verified over
    all 64 bits.
    """
    words = F.array("fp", *(w for i in range(SEGMENTS) for w in _ball(F.col("fp"), i)))
    table = fps.select("fp", F.explode(words).alias("word"))
    met = table.groupBy("word").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    pairs = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= SEGMENTS * RADIUS)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Near-duplicate classes: (doc_id, fingerprint, component_id), a row for each row of docs.

    Fingerprints link at 2 differing bits or fewer; component_id is the least doc_id reachable over links.
    Copies share a fingerprint and are worked on as one. Null or empty texts, and texts without words, have the
    fingerprint zero and are linked like any other. A null doc_id is kept and counts as larger than all others.
    Repeated rows give repeated rows. An empty table gives an empty one.
    """
    fp, _ = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    fps = fp.groupBy("fp").agg(F.min("k").alias("least"))
    comps = connected_components(links(fps.select("fp")))
    classes = fps.join(comps, fps["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_k"))
    named = classes.join(least, "component").select("fp", "component_k")
    return fp.join(named, "fp").select(
        id_of(F.col("k")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), id_of(F.col("component_k")).alias("component_id")
    )
