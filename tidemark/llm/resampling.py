"""Target-distribution importance resampling over hashed features, with counts by distinct lines."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, keyed, materialise

#: Words of a feature at most, buckets of features, words that a document needs to be drawn, hundredths that are drawn, and the seed of the draw.
MAX_WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: A task forgets what it knows of features once it knows so many.
_KNOWN = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 bytes: all but ASCII signs


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, with A-Z lower-cased."""
    return _WORD.findall(text.lower())


def features_of(words: list[bytes], max_words: int) -> list[bytes]:
    """All runs of 1 to max_words consecutive words."""
    return words + [b" ".join(words[i : i + n]) for n in range(2, max_words + 1) for i in range(len(words) - n + 1)]


def crossing(text: bytes, max_words: int) -> list[bytes]:
    """The runs of up to max_words words that lie in more than one line; lines without words part nothing."""
    lines = [w for x in text.split(b"\n") if (w := words_of(x))]
    out, before = [], []
    for line, after in pairwise([*lines, []]):
        before = (before + line)[-(max_words - 1) :]
        if not after:
            break
        # of the runs over this border, those that end in the next line
        head = after[: max_words - 1]
        joined, border = before + head, len(before)
        out += [b" ".join(joined[i : i + n]) for n in range(2, max_words + 1) for i in range(max(0, border - n + 1), border) if border < i + n <= len(joined)]
    return out


class _Buckets:
    """The bucket of each feature; what has been met is kept up to a bound."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}

    def __call__(self, features: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _KNOWN:
            known.clear()
        for f in set(features).difference(known):
            known[f] = zlib.crc32(f) % self.n
        return np.fromiter(map(known.__getitem__, features), np.int64, len(features))


def _sums(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def _of_lines(max_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket_of = np.zeros(buckets, np.int64), _Buckets(buckets)
        for b in batches:
            for line, times in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                np.add.at(total, bucket_of(features_of(words_of(line.as_py()), max_words)), times)
        yield _sums(total)

    return run


def _of_borders(max_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket_of = np.zeros(buckets, np.int64), _Buckets(buckets)
        for b in batches:
            for text in b.column(0):
                np.add.at(total, bucket_of(crossing(text.as_py(), max_words)), 1)
        yield _sums(total)

    return run


def feature_counts(docs: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket; buckets without any have no row.

    Texts are cut at newlines. Equal lines meet in one aggregate, which counts them before the shuffle, so a line that a
    third of the texts share is a row for each task. The features of a distinct line are counted once and multiplied by
    its occurrences. Runs of words that go over a line's end are counted from the texts, and added. Each task sends a
    row for each bucket.
    """
    texts = keyed(docs.select(F.lit(0).alias("k"), F.col(f"`{text_col}`").alias("text")), "k")
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    found = lines.select(F.col("line").cast("binary"), "times").mapInArrow(_of_lines(max_words, buckets), "bucket long, n long")
    if max_words > 1:
        found = found.unionAll(texts.select(F.col("text").cast("binary")).mapInArrow(_of_borders(max_words, buckets), "bucket long, n long"))
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the logarithm of how much likelier a bucket is in the target, rounded down; each bucket counts one more than it holds."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((float(target.get(i, 0) + 1) * float(s_all + buckets)) / (float(source.get(i, 0) + 1) * float(t_all + buckets)))) for i in range(buckets)], np.int64)


def _weigh(max_words: int, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(len(gains))
        for b in batches:
            n_words, n_features, weights = [], [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                features = features_of(words, max_words)
                n_words.append(len(words)), n_features.append(len(features))
                weights.append(int(gains[bucket_of(features)].sum()) // len(features) if features else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))], names=["k", "n_words", "n_features", "weight"])

    return run


def _counts(docs: DataFrame, text_col: str, max_words: int, buckets: int) -> dict[int, int]:
    """At most a row for each bucket, whatever the texts."""
    return Counter({r["bucket"]: r["n"] for r in feature_counts(docs, text_col, max_words, buckets).collect()})


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    max_words: int = MAX_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of docs: a draw without replacement towards the target.

    Features are runs of 1 to max_words words, hashed into buckets; weight is the mean gain of a text's features, rounded
    down. score adds Gumbel noise from a hash of seed and doc_id, so the highest scores are a draw in proportion to
    the weights. Of the N rows with least_words words, floor(percent N / 100) are drawn, ties to the smaller doc_id; rank
    counts them from 1, and is null for the others. Scores are whole numbers within a fixed range, so counts of each
    score tell where the draw ends; only rows at or above that score are sorted, each score by itself.

    Null texts count as empty: no features, weight 0, never drawn. A null doc_id is hashed as an empty one, stays null,
    and comes after every other. Rows that share a doc_id have the same noise and are ranked one by one; among those of
    equal score, the order is by features and weight. Without a target every count of it is zero. Rows without any
    document give an empty table. Other columns are not read.
    """
    gains = gains_of(_counts(docs, text_col, max_words, buckets), _counts(target, target_col, max_words, buckets), buckets)
    weighed = keyed(docs, id_col, text_col).select("k", F.col("text").cast("binary")).mapInArrow(_weigh(max_words, gains), "k long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_of(F.col("k")).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows, _ = materialise(weighed.select("k", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "weights")
    able = F.col("n_words") >= least_words
    size = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = size.select("score", "n", F.sum("n").over(Window.orderBy(F.desc("score"))).alias("upto"), F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    drawn = F.floor(F.col("all") * percent / 100).cast("long")
    # a row for each score that has drawn rows: at most as many as there are scores in the fixed range
    taken = above.where(F.col("upto") - F.col("n") < drawn).select("score", (F.col("upto") - F.col("n")).alias("before"), drawn.alias("drawn"))
    place = F.row_number().over(Window.partitionBy("score").orderBy("k", "n_features", "weight")).cast("long")
    first = rows.where(able).join(taken, "score").withColumn("rank", F.col("before") + place)
    in_draw = first.select("k", "n_features", "weight", "score", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))
    rest = rows.where(~able).select("k", "n_features", "weight", "score").unionAll(rows.where(able).join(taken.select("score"), "score", "left_anti").select("k", "n_features", "weight", "score"))
    return in_draw.unionAll(rest.withColumn("rank", F.lit(None).cast("long"))).select(id_of(F.col("k")).alias("doc_id"), "n_features", "weight", "score", "rank")
