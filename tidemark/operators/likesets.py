"""Sets of words that are alike: they meet in cells, and a pair is found and judged in the one task that has both."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sets of a word that are dealt as one block; comparisons of words made at a time; pairs that are summed up at a time. Fixed values.
BLOCK, AT_ONCE, HELD = 1024, 1 << 23, 1 << 20
_CELL = "w", "i", "j"
_ROWS = "w string, i int, j int, block int, id long, at int, copies long, ws array<string>"
_LINKS = "id long, root long, links long"


def cells(sets: DataFrame, near: float) -> DataFrame:
    """Rows (w, i, j, block, id, at, copies, ws) of sets (id, copies, ws), sorted by cell (w, i, j).

    Two sets can only be alike if they share one of the rarest n - ceil(near * n) + 1 words of each, so a set is dealt to
    these words alone. ws has the rarest word first, and w is that at place `at`. A word's sets are split into blocks, and
    each two blocks meet in a cell of their own, so that no task has all sets of a frequent word.
    """
    each = sets.select("id", "copies", F.explode("ws").alias("w"))
    df = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(df, "w").groupBy("id", "copies").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    n = F.size("o")
    rare = F.posexplode(F.slice("o", F.lit(1), (n - F.ceil(F.lit(near) * n - 1e-9) + 1).cast("int"))).alias("at", "rare")
    rows = ordered.select("id", "copies", F.transform("o", lambda x: x["w"]).alias("ws"), rare).where("rare.df > 1")
    of = Window.partitionBy("w")
    rows = rows.withColumn("w", F.col("rare.w")).withColumn("nth", F.row_number().over(of.orderBy("id"))).withColumn("n", F.count(F.lit(1)).over(of)).where("n > 1")
    block = F.floor((F.col("nth") - 1) / BLOCK).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))))
    rows = rows.select("w", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("id").cast("long").alias("id"), "at", F.col("copies").cast("long").alias("copies"), "ws")
    return _together(rows)


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "block", "id")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            last = np.logical_and.reduce([pc.equal(held[c], held[c][-1]).to_numpy() for c in _CELL])
            start = len(last) - int(last.sum())
            if start:
                yield held.slice(0, start).combine_chunks()
                held = held.slice(start).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, put together, and where each list starts and ends in them."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each i and 0 <= j < n[i]."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start, start + 1, ... end - 1 of one range after another."""
    i, j = _spread(ends - starts)
    return starts[i] + j


def _pairs(t: pa.Table, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, likeness) of the rows of whole cells that are alike, the smaller id first; a pair is found in the cell of its first common word alone."""
    flat, ends = _lists(t["ws"])
    n, at = np.diff(ends), t["at"].to_numpy()
    width = int(n.max())
    words = np.full((len(n), width), -1, np.int32)
    row, col = _spread(n)
    words[row, col] = flat.dictionary_encode().indices.to_numpy()
    ids, i, j, block = (t[c].to_numpy() for c in ("id", "i", "j", "block"))
    key = words[np.arange(len(n)), at]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    cell = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(n))))
    end = np.append(new[1:], len(n))[cell]
    right = (new + np.add.reduceat((block == i).astype(np.int64), new))[cell]
    first = np.where(i == j, np.arange(len(n)) + 1, np.where(block == i, right, end))
    met, step = np.cumsum(end - first), max(1, AT_ONCE // width**2)
    done, place = 0, np.arange(width)
    while done < len(n):
        upto = max(done + 1, int(np.searchsorted(met, (met[done - 1] if done else 0) + step, "right")))
        x, more = _spread(end[done:upto] - first[done:upto])
        a = x + done
        b = first[a] + more
        most = np.minimum(n[a] - at[a], n[b] - at[b])  # w and what comes after it
        ok = (ids[a] < ids[b]) & (most >= (near - 1e-9) * (n[a] + n[b] - most))
        a, b = a[ok], b[ok]
        equal = (words[a][:, :, None] == words[b][:, None, :]) & (words[a] >= 0)[:, :, None]
        both, shared = equal.sum((1, 2)), equal.any(2)
        like = both / (n[a] + n[b] - both)
        ok = (like >= near) & ~(shared & (place < at[a][:, None])).any(1)
        if ok.any():
            yield a[ok], b[ok], like[ok]
        done = upto


def alike(sets: DataFrame, near: float) -> DataFrame:
    """(a, b, likeness, a_copies, b_copies) of sets (id, copies, ws) whose Jaccard likeness is at least `near`, a < b. No pair is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            ids, copies = t["id"].to_numpy(), t["copies"].to_numpy()
            for a, b, like in _pairs(t, near):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], like, copies[a], copies[b])], names=["a", "b", "likeness", "a_copies", "b_copies"])

    return cells(sets, near).mapInArrow(run, "a long, b long, likeness double, a_copies long, b_copies long")


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """(id, root, links) of pairs: the least id that an id reaches over them, and how many of them it is in."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[u], root[v])
        now = root.copy()
        for x in (u, v):
            np.minimum.at(now, x, least)
            np.minimum.at(now, root[x], least)
        now = now[now]
        if (now == root).all():
            break
        root = now
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(np.bincount(at).astype(np.int64))], names=["id", "root", "links"])


def linked(sets: DataFrame, near: float) -> DataFrame:
    """(id, root, links) of sets that are alike, summed up in the task: links add up, and (id, root) join what the pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for t in _whole_cells(batches):
            ids = t["id"].to_numpy()
            for a, b, _ in _pairs(t, near):
                held.append((ids[a], ids[b]))
                if sum(len(x) for x, _ in held) >= HELD:
                    yield _forest(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield _forest(*map(np.concatenate, zip(*held, strict=True)))

    return cells(sets, near).mapInArrow(run, _LINKS)


#: From whole cells with their features and pairs of their rows: a column of values for each pair, and which pairs are kept.
Judge = Callable[[pa.Table, np.ndarray, np.ndarray], tuple[list[pa.Array], np.ndarray]]


def judged(sets: DataFrame, near: float, texts: DataFrame, features: dict[str, Column], judge: Judge, schema: str) -> DataFrame:
    """(src, dst, and the columns of schema) of pairs that are alike, from features of both texts (id, content).

    A first pass finds which sets have a like one in a cell; only these get their texts, and meet again.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            has = np.zeros(t.num_rows, bool)
            for a, b, _ in _pairs(t, near):
                has[a] = has[b] = True
            yield from t.filter(pa.array(has)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            ids = t["id"].to_numpy()
            for a, b, _ in _pairs(t, near):
                columns, kept = judge(t, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[kept]]), pa.array(ids[b[kept]]), *columns], names=["src", "dst", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    met = cells(sets, near).mapInArrow(some, _ROWS).join(texts.select("id", "content"), "id").select(*(x.split()[0] for x in _ROWS.split(", ")), *(c.alias(n) for n, c in features.items()))
    return _together(met).mapInArrow(run, f"src long, dst long, {schema}")


def _by_first(a: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each row that is first in pairs, which come in its order, and its pairs."""
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    for start, end in zip(new, np.append(new[1:], len(a)), strict=True):
        yield int(a[start]), slice(int(start), int(end))


def restated(restates: float) -> Judge:
    """(relation, conflict) from words (list of distinct words) and denied (a string): the second restates the first and adds no word, extends it, or is of something else."""

    def judge(t: pa.Table, a: np.ndarray, b: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
        flat, ends = _lists(t["words"])
        code = flat.dictionary_encode().indices.to_numpy()
        denied = t["denied"].combine_chunks().dictionary_encode()
        denied = (denied.combine_chunks() if isinstance(denied, pa.ChunkedArray) else denied).indices.to_numpy()
        has, both = np.zeros(len(code) + 1, np.int64), np.zeros(len(a), np.int64)
        for row, of in _by_first(a):
            own, others = code[ends[row] : ends[row + 1]], b[of]
            has[own] = 1
            upto = np.concatenate([[0], np.cumsum(ends[others + 1] - ends[others])])
            hits = np.concatenate([[0], np.cumsum(has[code[_ranges(ends[others], ends[others + 1])]])])
            both[of] = hits[upto[1:]] - hits[upto[:-1]]
            has[own] = 0
        n = np.diff(ends)
        same = (both == n[b]) & (both >= 1) & (both / np.maximum(n[a] + n[b] - both, 1) >= restates) & (denied[a] == denied[b])
        relation = np.where(both == 0, "unrelated", np.where(same, "unchanged", "extends"))
        return [pa.array(relation.tolist(), pa.string()), pa.array((both > 0) & (denied[a] != denied[b]))], np.ones(len(a), bool)

    return judge


def _held_in(runs: pa.Array, words: pa.Array) -> Callable[[int], np.ndarray]:
    """Which words lie in a run of letters and digits, worked out once for each run."""
    index = {w: i for i, w in enumerate(words.to_pylist())}
    lengths, found = sorted(set(map(len, index))), {}

    def of(run: int) -> np.ndarray:
        if run not in found:
            s = runs[run].as_py()
            at = {index.get(s[x : x + n], -1) for n in lengths if n <= len(s) for x in range(len(s) - n + 1)}
            found[run] = np.array(sorted(at - {-1}), np.int64)
        return found[run]

    return of


def supported(support: float) -> Judge:
    """(claims, supported) from runs (list of distinct runs of letters and digits) of the first and claims (lists of words) of the second.

    A claim is supported if that share of its words lies in the first text; a word of letters and digits that lies in a
    text lies in one of its runs. A text without claims gives no row.
    """

    def judge(t: pa.Table, a: np.ndarray, b: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
        claims, of_row = _lists(t["claims"])
        words, of_claim = _lists(pa.chunked_array([claims]))
        words = words.dictionary_encode()
        code = words.indices.to_numpy()
        runs, of_runs = _lists(t["runs"])
        runs = runs.dictionary_encode()
        run, held = runs.indices.to_numpy(), _held_in(runs.dictionary, words.dictionary)
        has, good = np.zeros(len(words.dictionary) + 1, np.int64), np.zeros(len(a), np.int64)
        for row, of in _by_first(a):
            own = [held(int(r)) for r in run[of_runs[row] : of_runs[row + 1]]]
            own = np.concatenate(own) if own else np.zeros(0, np.int64)
            has[own] = 1
            others = b[of]
            each = _ranges(of_row[others], of_row[others + 1])
            size = of_claim[each + 1] - of_claim[each]
            hits = np.concatenate([[0], np.cumsum(has[code[_ranges(of_claim[each], of_claim[each + 1])]])])
            upto = np.concatenate([[0], np.cumsum(size)])
            ok = np.concatenate([[0], np.cumsum((size == 0) | (hits[upto[1:]] - hits[upto[:-1]] >= support * size))])
            by = np.concatenate([[0], np.cumsum(of_row[others + 1] - of_row[others])])
            good[of] = ok[by[1:]] - ok[by[:-1]]
            has[own] = 0
        n = of_row[b + 1] - of_row[b]
        kept = n > 0
        return [pa.array(n[kept]), pa.array(good[kept])], kept

    return judge
