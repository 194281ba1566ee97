"""Repeated runs of lines by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, identified, materialise, remove

#: A run of so many lines is a passage, and so is a line of so many words.
MIN_LINES, MIN_WORDS = 2, 50
_EDGE = " \t\r"


def lines_of(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the places of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(_EDGE)]


def _hashes(lines: list[str], places: list[int]) -> list[bytes]:
    return [xxhash.xxh3_128_digest(lines[i].strip(_EDGE).encode("utf-8", "surrogatepass")) for i in places]


def _long(lines: list[str], places: list[int], min_words: int) -> list[int]:
    return [n for n, i in enumerate(places) if len(lines[i]) >= 2 * min_words - 1 and len(lines[i].encode("utf-8", "surrogatepass").split()) >= min_words]  # bytes: only ASCII white space parts


def winnow(hashes: list[bytes], window: int) -> dict[int, list[int]]:
    """The place of the least hash of each window, the rightmost of equals, with the starts of its windows: every run of `window` lines has one."""
    out: dict[int, list[int]] = {}
    for i in range(len(hashes) - window + 1):
        out.setdefault(min(range(i, i + window), key=lambda j: (hashes[j], -j)), []).append(i)
    return out


_POSITION = "h binary, k long, t long, line int, long boolean, around array<struct<back: int, w: binary>>"


def _fingerprints(min_lines: int, min_words: int):
    """A row for each fingerprint of a text: its line, and the windows of which it is the least, with the lines of each that come before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = pa.list_(pa.struct([("back", pa.int32()), ("w", pa.binary())]))
        kinds = pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), around
        for b in batches:
            out: tuple[list, ...] = [], [], [], [], [], []
            for k, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                lines, places = lines_of(text.as_py())
                h, long = _hashes(lines, places), set(_long(lines, places, min_words))
                windows = winnow(h, min_lines)
                for n in sorted(long.union(windows)):
                    own = [{"back": n - i, "w": xxhash.xxh3_128_digest(b"".join(h[i : i + min_lines]))} for i in windows.get(n, ())]
                    for column, value in zip(out, (h[n], k, t, n, n in long, own), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=["h", "k", "t", "line", "long", "around"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, counts, gone, runs = [], [], [], []
        for t, repeats in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            text = t.as_py()
            lines, places = lines_of(text)
            dead = {i for r in repeats or () for i in range(r["line"], min(r["line"] + r["n"], len(places)))}
            drop = {places[i] for i in dead}
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
            counts.append(len(places)), gone.append(len(dead)), runs.append(sum(i - 1 not in dead for i in dead))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (counts, gone, runs))], names=["k", "text", "n_lines", "n_removed", "n_runs"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, n_runs): each text without the lines of passages that occur earlier.

    A passage is a run of at least min_lines lines, or a line of at least min_words words. Earlier is a smaller doc_id
    or an earlier line of the same document; passages are judged on the input. Lines are compared without spaces and
    tabs at their ends; blank lines are not counted, neither part nor join runs, and stay. n_lines counts the others.

    Window minima over line hashes, and long lines, are the fingerprints: each passage has one, at the same place in
    it wherever it occurs. Positions of equal fingerprints are joined, the first with each later one, and a match is
    extended both ways, to as many lines before and after as complete a window; a passage is cut where its windows lie
    end to end. Windows at a later position that the first one does not have are joined among themselves, so no earlier
    occurrence is missed. All joins are on hashes, with a row for each fingerprint or window, and what a hash needs of
    its group is aggregated before the shuffle, so a line that a third of the documents share makes rows in proportion.

    Null texts count as empty and come back as ''. A null doc_id counts as the largest. Rows that share a doc_id are
    told apart by their texts, in the order of a hash of these; rows that share both count as one document and all keep
    what one would. Lines are hashed to 128 bits, and equal hashes stand for equal lines. An empty table gives an empty one.
    """
    texts = identified(docs, id_col, text_col)
    marks, at = materialise(texts.mapInArrow(_fingerprints(min_lines, min_words), _POSITION), "fingerprints")
    place = F.struct("k", "t", "line")
    first = marks.groupBy("h").agg(F.min(F.struct("k", "t", "line", "around")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("h", "first")
    pairs = marks.join(first, "h").where(place > F.struct("first.k", "first.t", "first.line"))
    pairs, _ = materialise(pairs.select("k", "t", "line", "long", F.array_intersect("around", "first.around").alias("same"), F.array_except("around", "first.around").alias("rest")), "positions")
    remove(docs.sparkSession, at)
    extended = pairs.select("k", "t", "line", F.explode("same").alias("s")).select("k", "t", (F.col("line") - F.col("s.back")).alias("line"), F.lit(min_lines).alias("n"))
    alone = pairs.where("long").select("k", "t", "line", F.lit(1).alias("n"))
    left = pairs.select("k", "t", "line", F.explode("rest").alias("s")).select("s.w", "k", "t", (F.col("line") - F.col("s.back")).alias("line"))
    earliest = left.groupBy("w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("w", "first")
    later = left.join(earliest, "w").where(place > F.col("first")).select("k", "t", "line", F.lit(min_lines).alias("n"))
    repeats = extended.unionAll(alone).unionAll(later).groupBy("k", "t").agg(F.collect_list(F.struct("line", "n")).alias("repeats"))
    rows = texts.join(repeats.hint("shuffle_hash"), ["k", "t"], "left").select("k", "text", "repeats")
    return rows.mapInArrow(_cut, "k long, text string, n_lines long, n_removed long, n_runs long").select(id_of(F.col("k")).alias("doc_id"), "text", "n_lines", "n_removed", "n_runs")
