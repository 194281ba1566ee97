"""Language identification with string kernels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, keyed
from .quality import held_out

#: Lengths of n-grams, and bits of the table of each into which they are hashed.
GRAMS = {1: 9, 2: 12, 3: 14}
#: Documents of each language that are learned from at most, and those of them that are landmarks.
SAMPLE, LANDMARKS = 1500, 24
#: Documents that are learned from at most over all languages.
TOTAL = 12_000
RIDGE = 1e-3
_WIDTH = sum(1 << b for b in GRAMS.values())
_BATCH = 128


def presence(text: str) -> np.ndarray:
    """Which n-grams of letters and of the gaps between them occur in a whole text, as places of ones; sorted."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((code >= 97) & (code <= 122)) | ((code >= 0xC0) & (code != 0xD7) & (code != 0xF7))
    code = np.where(letter, code, 32)
    code = np.concatenate([[32], code[letter | np.concatenate([[True], letter[:-1]])], [32]]).astype(np.uint32)
    out, base = [], 0
    for n, bits in GRAMS.items():
        h = np.zeros(max(0, len(code) - n + 1), np.uint32)
        for i in range(n):
            h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        seen = np.zeros(1 << bits, bool)
        seen[h >> np.uint32(32 - bits)] = True
        out.append(np.flatnonzero(seen) + base)
        base += 1 << bits
    return np.concatenate(out)


def spread(places: list[np.ndarray]) -> np.ndarray:
    """Rows whose inner products are the blended kernel: the mean over n of shared n-grams, each normalised."""
    x = np.zeros((len(places), _WIDTH), np.float32)
    for row, p in zip(x, places, strict=True):
        row[p] = 1
    base = 0
    for bits in GRAMS.values():
        part = x[:, base : base + (1 << bits)]
        part /= np.sqrt(np.maximum(1, part.sum(1, keepdims=True)) * len(GRAMS))
        base += 1 << bits
    return x


@dataclass(frozen=True)
class Recogniser:
    """classes, and the weights of the kernels with the landmarks: landmarks' rows times Nyström map times ridge solution."""

    classes: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(class, score) of each text: the class of the largest output, and its share after a softmax."""
        out = spread(places) @ self.landmarks.T @ self.weights + self.bias
        e = np.exp(6 * (out - out.max(1, keepdims=True)))
        return out.argmax(1), e.max(1) / e.sum(1)


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Recogniser:
    """One-versus-rest kernel ridge regression on the Nyström features of a bounded sample."""
    classes = tuple(sorted({lang for lang, _ in samples}))
    chosen = [p for c in classes for p in [p for lang, p in samples if lang == c][:landmarks]]
    marks = spread(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    nystrom = vectors[:, kept] / np.sqrt(values[kept])
    phi = np.concatenate([spread([p for _, p in samples[i : i + _BATCH]]) @ marks.T @ nystrom for i in range(0, len(samples), _BATCH)])
    y = np.array([[1.0 if lang == c else -1.0 for c in classes] for lang, _ in samples])
    size = np.array([sum(lang == c for lang, _ in samples) for c in classes])
    w = np.array([1 / size[classes.index(lang)] for lang, _ in samples])[:, None]
    one = np.concatenate([phi, np.ones((len(phi), 1))], axis=1)
    penalty = ridge * np.eye(one.shape[1])
    penalty[-1, -1] = 0
    beta = np.linalg.solve(one.T @ (w * one) + penalty, one.T @ (w * y))
    return Recogniser(classes, marks, (nystrom @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32))


def sample(docs: DataFrame, usable: Column, lang_col: str, per_language: int, total: int) -> DataFrame:
    """(lang, at, bits): the texts of least hash of each language, ties by identifier, as n-gram presence.

    First rows are counted by language; then only identifiers whose hash is below a cut that some four times as many
    should pass are ranked, and the cut is raised until every language has its number. So no task gets a language
    whole, and texts stay where they lie: the chosen identifiers, `total` at most, are sent to them.
    """
    rows = docs.where(usable & F.col(f"`{lang_col}`").isNotNull())
    ids = rows.select(F.col("doc_id").cast("long").alias("k"), F.col(f"`{lang_col}`").cast("string").alias("lang")).withColumn("hash", F.xxhash64("k"))
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(total + 1).collect()}
    if len(counts) > total:
        raise ValueError(f"more than {total} languages to learn")
    per_language = min(per_language, total // max(1, len(counts)))
    cuts = {lang: 2**63 - 1 if n <= 8 * per_language else int(-(2**63) + 2**64 * 4 * per_language / n) for lang, n in counts.items()}
    while cuts:
        cut = F.try_element_at(F.create_map(*(F.lit(x) for p in cuts.items() for x in p)), F.col("lang"))
        below = ids.where(F.col("hash") <= cut)
        got = {r["lang"]: r["n"] for r in below.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not (few := [lang for lang, n in counts.items() if got.get(lang, 0) < min(per_language, n)]):
            break
        cuts |= {lang: min(2**63 - 1, 2 * cuts[lang] + 2**63) for lang in few}
    else:
        below = ids.where(F.lit(False))
    chosen = below.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "k"))).where(F.col("at") <= per_language).select("k", "lang", "at")
    texts = rows.select(F.col("doc_id").cast("long").alias("k"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(chosen), ["k", "lang"]).select("lang", "at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(np.isin(np.arange(_WIDTH), presence(t.as_py()), assume_unique=True)).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], names=["lang", "at", "bits"])

    return chosen.mapInArrow(run, "lang string, at int, bits binary")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, per_language: int = SAMPLE, landmarks: int = LANDMARKS, total: int = TOTAL) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of every whole text.

    Learns from at most `per_language` documents of each non-null lang that are not held out, and from `total` at most
    (with more languages each has an equal share); the first `landmarks` of them in order of a hash of doc_id span the
    kernel space. Only their n-gram presence, a bit for each, comes to the driver: `total` rows of 2.6 kB at most, and
    a row more for each row that repeats one of these identifiers. lang_pred is 'und', with score 0, if the text
    is null or has no letter, or if there is nothing to learn from. Repeated rows get the same; a null doc_id is
    predicted and not held out. An empty table gives an empty one.
    """
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)
    rows = sample(plain, usable, "lang", per_language, total).collect()
    got = [(r["lang"], np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:_WIDTH])) for r in sorted(rows, key=lambda r: (r["lang"], r["at"], r["bits"]))]
    model = fit(got, landmarks) if got else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for at in range(0, b.num_rows, _BATCH):
                texts = {at + i: t.as_py() for i, t in enumerate(b.column(1).slice(at, _BATCH))}
                rows = [i for i, t in texts.items() if any(map(str.isalpha, t))] if model else []
                if rows:
                    best, score = model.predict([presence(texts[i]) for i in rows])
                    langs[rows], scores[rows] = [model.classes[c] for c in best], np.round(score, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs.tolist(), pa.string()), pa.array(scores)], names=["k", "lang_pred", "score"])

    out = keyed(plain).mapInArrow(run, "k long, lang_pred string, score double")
    k = id_of(F.col("k"))
    return out.select(k.alias("doc_id"), held_out(k, folds, fold).alias("held_out"), "lang_pred", "score")
