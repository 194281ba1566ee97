"""Source divergence audit: how the words of each source differ from its language and from its sister sources."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, remove

#: Documents of a language that a term must be in, ranks of terms that are told, and the whole that shares are parts of.
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Terms that a task counts before it sends them, sources that are compared at a time, and cells of one comparison.
_HELD, _BLOCK, _CELLS = 200_000, 256, 1 << 18
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, with A-Z lower-cased."""
    return _TERM.findall(text.lower())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term); a row without a term counts the documents of the group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            every = pa.array(docs, pa.binary())
            columns = [pa.array([x] * len(docs), pa.string()) for x in (lang, source)]
            columns += [every, pa.array(map(n.__getitem__, docs), pa.int64()), pa.array(docs.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = terms_of(text.as_py())
            n.update(terms)
            docs.update(set(terms))
            docs[None] += 1
        if sum(len(docs) for _, docs in held.values()) > _HELD:
            yield from sent()
    yield from sent()


def share(n: str, total: str, terms: str) -> str:
    """SQL for 1 + floor(SCALE (n + 2) / (total + 2 terms)), exact for counts of any size; null without terms."""
    return f"1 + ({SCALE} * cast({n} + 2 as decimal(28,0))) div nullif(cast({total} as decimal(28,0)) + 2 * cast({terms} as decimal(28,0)), 0)"


def dominated(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Which of the points have k others or more that are better or equal in all of: higher n, lower lang_n, earlier term.

    Points come in any order; term holds whole numbers that are all different. Only points with fewer dominators than k
    are compared with later ones: whatever another point dominates is dominated by that one's dominators too.
    """
    order = np.lexsort((term, lang_n, -n))
    out = np.ones(len(n), bool)
    kept = np.zeros(0, np.int64)
    for i in range(0, len(order), 512):
        block = order[i : i + 512]
        worse = (lang_n[kept, None] <= lang_n[block]) & (term[kept, None] < term[block])  # those before have n as high
        block = block[worse.sum(0) < k]
        own = np.triu((lang_n[block, None] <= lang_n[block]) & (term[block, None] < term[block]), 1)
        earlier = (lang_n[kept, None] <= lang_n[block]) & (term[kept, None] < term[block])
        block = block[earlier.sum(0) + own.sum(0) < k]
        kept = np.concatenate([kept, block])
    out[kept] = False
    return out


def _skyband(k: int):
    """Of each group of a partition, the rows that fewer than k others dominate; a batch at a time, so a task holds a batch and the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band: pa.Table | None = None
        for b in batches:
            both = pa.Table.from_batches([b]) if band is None else pa.concat_tables([band, pa.Table.from_batches([b])])
            groups = both.select(["lang", "source"]).to_pandas().groupby(["lang", "source"], sort=False).indices
            n, lang_n, terms = both["n"].to_numpy(), both["lang_n"].to_numpy(), np.array(both["term"].to_pylist(), object)
            place = np.empty(len(terms), np.int64)
            place[np.argsort(terms, kind="stable")] = np.arange(len(terms))  # bytes sort as UTF-8 does
            keep = [at[~dominated(n[at], lang_n[at], place[at], k)] for at in groups.values()]
            band = both.take(pa.array(np.sort(np.concatenate(keep)) if keep else [], pa.int64())).combine_chunks()
        if band is not None:
            yield from band.to_batches()

    return run


def _distances(key: tuple[pa.Scalar, ...], cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over the terms of one chunk that any source of two blocks has, less what each would be if neither had it: a row for either order of sources."""
    lang, same = key[0], key[2].as_py() == key[3].as_py()
    term = cells["term"].combine_chunks().dictionary_encode() if len(cells) else None
    row = term.indices.to_numpy() if len(cells) else np.zeros(0, np.int64)
    shares, places, none = [], [], []
    for side in (0,) if same else (0, 1):
        own = groups.filter(pc.equal(groups["side"], side)).sort_by("place")
        mine = cells["side"].to_numpy() == side
        place = own["place"].to_numpy()
        none.append(own["p0"].to_numpy())
        p = np.tile(none[-1], (len(term.dictionary) if len(cells) else 0, 1))
        p[row[mine], cells["place"].to_numpy()[mine] - place[0]] = cells["p"].to_numpy()[mine]
        shares.append(p), places.append(place)
    found = []
    for j, a in enumerate(places[0]):
        d = shares[-1] - shares[0][:, [j]]
        d0 = none[-1] - none[0][j]
        sums = (d * d // (shares[-1] + shares[0][:, [j]]) - d0 * d0 // (none[-1] + none[0][j])).sum(0)
        found += [(a, b, v) for b, v in zip(places[-1], sums, strict=True) if b != a]
    if not same:
        found += [(b, a, v) for a, b, v in found]
    a, b, value = (pa.array([x[i] for x in found], pa.int64()) for i in range(3))
    return pa.table({"lang": pa.array([lang.as_py()] * len(found), pa.string()), "a": a, "b": b, "value": value})


def _counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: cells (lang, source, term, n, lang_n) of kept terms, and groups (lang, source, place, sources, total, lang_total, terms)."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = rows.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counts, at = materialise(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept, kept_at = materialise(kept.select("lang", "term", "lang_n"), "terms")
    cells, _ = materialise(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "cells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = counts.where("term is null").select("lang", "source")
    sized = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = sized.select("lang", "source", place.cast("long").alias("place"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "terms")))
    groups, _ = materialise(groups, "groups")
    remove(docs.sparkSession, at)
    remove(docs.sparkSession, kept_at)
    return cells, groups


def _pairs(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language.

    Terms are dealt into chunks, sources into blocks: one comparison holds the shares of a chunk in two blocks, and sends
    a row for each pair. Work grows with terms times pairs of sources, as many as are returned, and no group with a language.
    """
    width = F.least("sources", F.lit(_BLOCK))
    sized = groups.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") * width / _CELLS))).withColumn("blocks", F.ceil(F.col("sources") / _BLOCK).cast("int"))
    block = F.floor(F.col("place") / _BLOCK).cast("int")
    met = lambda df: df.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    by = ["lang", "chunk", "i", "j"]
    dealt = shared.join(sized.select("lang", "source", "place", "chunks", "blocks"), ["lang", "source"]).withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    left = met(dealt).select(*by, "side", "term", "place", "p")
    p0 = F.coalesce(F.expr(share("0", "total", "terms")), F.lit(1)).alias("p0")
    right = met(sized.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))).select(*by, "side", "place", p0)
    sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_distances, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = groups.select("lang", "place", "source", "terms", p0)
    sums = sums.join(named.withColumnRenamed("place", "a"), ["lang", "a"])
    both = sums.join(named.select("lang", F.col("place").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q0")), ["lang", "b"])
    return both.select("lang", "source", "item", F.expr("value + terms * ((p0 - q0) * (p0 - q0) div (p0 + q0))").alias("value"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the words of each source lie from its language's and from each sister source's.

    A language keeps the terms that at least least_docs of its rows have. The share of a term in a group is
    p = 1 + floor(10^9 (n + 2) / (N + 2 V)), N being the kept terms' occurrences there and V their number; of two shares,
    the distance is floor((p - q)^2 / (p + q)). Part "pair": for each other source of the language, the sum over all kept
    terms, every rank. Part "term": the kept terms that the source has, and with a higher share than its language; the
    first `top` ranks. Ranks go by value, highest first, then by item in the order of UTF-8 bytes. All numbers are exact.

    A term that is dominated by `top` others, each with as high a count in the group, as low a count in the language and an
    earlier name, cannot be among the first: their values are as high and they come earlier. Each partition keeps its
    skyband of those with fewer dominators; skybands are merged, a skyband is taken of them, and its terms are ranked.

    Null lang, source and text count as ''. Rows are documents, repeated ones too. A group without kept terms has count 0
    everywhere; a language without kept terms has distances of 0 and no terms. A language with one source has no pairs.
    An empty table gives an empty one. Other columns are not read.
    """
    cells, groups = _counted(docs, lang_col, source_col, text_col, least_docs)
    totals = groups.select("lang", "source", "total", "lang_total", "terms")
    shared = cells.join(totals, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", F.expr(share("n", "total", "terms")).alias("p"), F.expr(share("lang_n", "lang_total", "terms")).alias("q"))
    kind = "lang string, source string, term binary, n long, lang_n long, p long, q long"
    bands = shared.where("p > q").mapInArrow(_skyband(top), kind)
    merged = bands.repartition("lang", "source").mapInArrow(_skyband(top), kind)
    told = merged.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    pairs = _pairs(shared.select("lang", "source", "term", "p"), groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionAll(told.withColumn("rank", rank).where(F.col("rank") <= top))
