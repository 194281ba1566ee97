"""Quality classifier: regularised quadratic discriminant analysis."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_of, keyed, materialise

#: Documents with a score of at least this are predicted good.
THRESHOLD = 0.3
#: Weight of the pooled covariance, then of its diagonal, and the variance that every feature has at least.
POOLED, DIAGONAL, FLOOR = 0.3, 0.1, 0.02
#: The log-density difference is divided by this; features are not independent as the densities take them to be.
TEMPERATURE = 4.0
FEATURES = (
    "length", "word_length", "long_words", "upper", "digits", "symbols", "commas", "bars", "bangs",
    "word_ends", "variety", "top_word", "same_again", "line_copies", "line_length", "letters",
)
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~_=+<>{}[]\\/", np.uint8))


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one whole text."""
    s = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(s, np.uint8), minlength=256) if s else np.zeros(256, np.int64)
    words = s.split()
    lines = [x for x in s.split(b"\n") if x.strip()]
    n, w = max(1, len(s)), max(1, len(words))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    many = Counter(words)
    top = many.most_common(1)[0][1] if many else 0
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(x.endswith((b".", b"?", b"!", b":")) for x in lines)
    r = np.sqrt
    return np.array([
        np.log1p(w), np.log1p(len(s) / w), r(sum(len(x) > 25 for x in words) / w), r(upper / max(1, upper + lower)), r(counts[48:58].sum() / n), r(counts[_SYMBOLS].sum() / n * 4),
        r(counts[44] / w), r(counts[124] / w), r(counts[33] / w), ends / max(1, len(lines)), np.log1p(len(many)) / np.log1p(w), r(top / w * min(1, w / 8)),
        r(again / w * 2), r(1 - len(set(lines)) / max(1, len(lines))), np.log1p(len(s) / max(1, len(lines))) / 2, r(max(0, 1 - (upper + lower + counts[128:].sum()) / n)),
    ])


@dataclass(frozen=True)
class Discriminant:
    """Means and Cholesky factors of the inverse covariances of both classes; without two classes, a share alone."""

    share: float
    means: tuple[np.ndarray, ...] = ()
    whiteners: tuple[np.ndarray, ...] = ()
    log_dets: tuple[float, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        if not self.means:
            return np.full(len(x), self.share)
        g = [-0.5 * (np.square((x - m) @ w.T).sum(1) + d) for m, w, d in zip(self.means, self.whiteners, self.log_dets, strict=True)]
        odds = (g[1] - g[0]) / TEMPERATURE + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, x): the statistics of every row's whole text, computed where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()).tolist() for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["k", "x"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "k long, x array<double>")


def fit(rows: DataFrame) -> Discriminant:
    """From all rows (label, x) with label 0 or 1. Only sums over each class come to the driver."""
    d = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, x = b.column(0).to_numpy(zero_copy_only=False), np.array(b.column(1).to_pylist()).reshape(-1, d)
            for y in (0, 1):
                if len(own := x[label == y]):
                    sums = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(sums), pa.int32()), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["label", "i", "s"])

    sums = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(partial, "label int, i int, s double").groupBy("label", "i").agg(F.sum("s").alias("s")).collect():
        sums[r["label"], r["i"]] = r["s"]
    n = sums[:, 0]
    share = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Discriminant(share)
    means = sums[:, 1 : 1 + d] / n[:, None]
    scatter = [sums[y, 1 + d :].reshape(d, d) - n[y] * np.outer(means[y], means[y]) for y in (0, 1)]
    pooled = (scatter[0] / n[0] + scatter[1] / n[1]) / 2
    whiteners, log_dets = [], []
    for y in (0, 1):
        c = (1 - POOLED) * scatter[y] / n[y] + POOLED * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + FLOOR**2 * np.eye(d)
        low = np.linalg.cholesky(c)
        whiteners.append(np.linalg.inv(low))
        log_dets.append(float(2 * np.log(np.diag(low)).sum()))
    return Discriminant(share, (means[0], means[1]), tuple(whiteners), tuple(log_dets))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the identifier as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of docs.

    The classes' means and shrunk covariances are learned from all labelled documents that are not held out; labels
    other than 0 and 1, null ones and those of a null doc_id are not used, and a document with two labels counts with
    each. Identifier, language and source are no input. score is the probability of label 1, of empty and null texts
    too (their statistics are 0); predicted is 1 from `threshold`. Without two rows of each class every score is the
    share of label 1. Repeated rows are scored alike; a null doc_id is scored and not held out. An empty table gives
    an empty one. The statistics are written once and read for fitting and for scoring.
    """
    x, _ = materialise(features(docs, id_col, text_col), "statistics")
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1) and k is not null")
    model = fit(x.join(marked.where(~held_out(F.col("k"))), "k").select("label", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(np.array(b.column(1).to_pylist()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(score, 9))], names=["k", "score"])

    out = x.mapInArrow(run, "k long, score double")
    return out.select(id_of(F.col("k")).alias("doc_id"), held_out(id_of(F.col("k"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
