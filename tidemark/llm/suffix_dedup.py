"""Repeated strings by bucket-pointer refinement.

The suffixes that matter are those starting at repeated strings of `length` bytes; sorting stops at that depth.

1. Initial buckets. Every window of `length` bytes has an anchor, its q-gram of least hash (the leftmost of equals), so
   equal windows have equal anchors at equal offsets. Windows are bucketed by the q-gram of their anchor. A bucket whose
   windows all have the same bytes around the anchor is settled: all but the earliest are repeats. Others stay open.
2. Refinement. The bucket of a suffix at depth 2d is named by its bucket at depth d and that of the suffix d bytes later,
   from the q-grams up, as far as depth D (see depth()). Suffixes that start at every q-th place before an open anchor
   are sorted on (bucket of the anchor, bucket at depth D). A bucket of one is closed; each other goes on, for the q
   windows that hold it.
3. Last refinement. The bucket of a window is named by the depth-D buckets, made again from those of step 2, of the
   suffixes that cover it. All but the earliest of a bucket are repeats.

Names are 64-bit hashes of names; two windows are taken as equal if the names of their anchors and their own agree.
Buckets are dealt to tasks by hash, and their number follows the bytes of the input. What one Arrow batch holds twice is
settled there and sent once: a string that a third of all documents share, and one that each continues in its own
way, make one row for each batch and not one for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, identified

U = np.uint64
#: Window starts that are hashed at a time.
CHUNK = 1 << 17
#: Bytes of text for each bucket that a task sorts at a time.
BUCKET_BYTES = 1 << 25
_ODD = 0x9E3779B97F4A7C15
#: A repeat; one that waits for its bucket; one that is known to go on; one that only stands for others of its batch.
_REPEAT, _OPEN, _KNOWN, _SIGN = 0, 1, 2, 3
_ITEM = np.dtype([("q", "<u8"), ("c", "<u8"), ("k", "<i8"), ("t", "<i8"), ("x", "<u4"), ("lo", "<u2"), ("hi", "<u2"), ("kind", "u1")])
_COLUMNS = "q", "c", "x", "lo", "hi", "kind"
_BLOB = "bucket int, items binary"
_FOUND = "k long, t long, x long, lo int, hi int, kind int"


def depth(length: int, q: int) -> int:
    """The depth of the middle buckets: the largest q * 2**n such that each window of an anchor holds one that starts at a multiple of q before it."""
    d = q
    while 2 * d <= length - q + 1:
        d *= 2
    return d


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(33))


class _Hashes:
    """Hashes of any stretch of a byte string, from prefix sums of value(byte) * ODD**position modulo 2**64."""

    bytes_ = _mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    power = inverse = np.ones(1, U)

    def __init__(self, s: np.ndarray):
        if len(s) >= len(_Hashes.power):
            n = max(2 * CHUNK, len(s) + 1)
            grown = np.full(n, _ODD, U), np.full(n, pow(_ODD, -1, 1 << 64), U)
            for g in grown:
                g[0] = 1
            _Hashes.power, _Hashes.inverse = map(np.multiply.accumulate, grown)
        self.sums = np.zeros(len(s) + 1, U)
        np.cumsum(self.bytes_[s] * self.power[: len(s)], out=self.sums[1:])

    def every(self, n: int) -> np.ndarray:
        """Of the n bytes from each position."""
        d = self.sums[n:] - self.sums[:-n]
        return _mix(d * self.inverse[: len(d)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    return _mix(a * U(_ODD) + (b ^ (b >> U(29))) * U(0xD6E8FEB86659FD93))


def _deeper(grams: np.ndarray, q: int, d: int) -> np.ndarray:
    """Buckets at depth d from those at depth q: a bucket of twice the depth is that of a place and that of the later place."""
    while q < d:
        grams = _joined(grams[:-q], grams[q:]) if len(grams) > q else grams[:0]
        q *= 2
    return grams


def _covering(names: np.ndarray, d: int, length: int) -> np.ndarray:
    """Buckets at depth `length`, each of the buckets at depth d that cover it."""
    n = len(names) - (length - d)
    if n <= 0:
        return names[:0]
    out = names[:n]
    for at in [*range(d, length - d, d), length - d] if length > d else []:
        out = _joined(out, names[at : at + n])
    return out


def _window_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, from running minima of blocks of w."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(U).max, U)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, start in bytes, start in the row) of stretches put together; long texts overlap by length - 1."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(b) for _, _, b in held])
        return (np.frombuffer(b"".join(b for _, _, b in held), np.uint8), np.array([r for r, _, _ in held]), np.concatenate([[0], np.cumsum(sizes)]), np.array([o for _, o, _ in held]))

    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            if len(piece) >= length:
                held.append((row, at, piece))
                size += len(piece)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _new(n: int) -> np.ndarray:
    return np.zeros(n, _ITEM)


def anchors(texts: list[bytes], keys: np.ndarray, length: int, q: int) -> np.ndarray:
    """An item for each anchor: q-gram, all bytes around it, row, place x, and how far before x its first and last windows start."""
    out = [_new(0)]
    w = length - q + 1
    for s, rows, starts, base in _chunks(texts, length):
        h = _Hashes(s)
        grams = h.every(q)
        bits = int(len(grams)).bit_length()
        at = _window_minimum((grams >> U(bits) << U(bits)) | np.arange(len(grams), dtype=U), w) & U((1 << bits) - 1)
        of = np.repeat(np.arange(len(rows)), np.diff(starts))[: len(at)]
        p = np.flatnonzero(np.arange(len(at)) + length <= starts[1:][of])
        x = at[p].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (of[p][1:] != of[p][:-1])]))
        last = np.concatenate([new[1:], [len(p)]]) - 1
        x, first, final, row = x[new], p[new], p[last], of[p][new]
        item = _new(len(x))
        item["lo"], item["hi"], item["kind"] = x - first, x - final, _OPEN
        item["q"] = grams[x]
        item["c"] = _mix(h.of(first, final + length) + (item["lo"].astype(U) << U(17)) + item["hi"].astype(U))
        item["k"], item["t"] = keys[rows[row]].T
        item["x"] = x - starts[row] + base[row]
        out.append(item)
    return np.concatenate(out)


def _near(texts: list[bytes], keys: np.ndarray, found: list[np.ndarray], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(row, bytes, rows of found whose first window starts in them, place of the bytes); a text is looked at in stretches."""
    for row, text in enumerate(texts):
        f = found[row]
        f = f[np.argsort(f[:, 0])]
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            some = f[(f[:, 0] - f[:, 1] >= at) & (f[:, 0] - f[:, 1] < at + CHUNK)]
            if len(some):
                yield row, np.frombuffer(text, np.uint8)[at : at + CHUNK + 2 * length], some, at


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each i and 0 <= j < n[i]."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def middles(texts: list[bytes], keys: np.ndarray, found: list[np.ndarray], length: int, q: int) -> np.ndarray:
    """An item for each suffix at a multiple of q before an open anchor that one of its windows holds; lo and hi are those of these windows."""
    out, d = [_new(0)], depth(length, q)
    for row, piece, some, at in _near(texts, keys, found, length):
        grams = _Hashes(piece).every(q)
        names = _deeper(grams, q, d)
        least, most = some[:, 2] // q, some[:, 1] // q
        i, j = _each(most - least + 1)
        back = (least[i] + j) * q
        x = some[i, 0] - at
        item = _new(len(i))
        item["q"], item["c"] = grams[x], names[x - back] + back.astype(U)
        item["k"], item["t"] = keys[row]
        item["x"], item["lo"], item["hi"], item["kind"] = some[i, 0], np.minimum(some[i, 1], back + q - 1), np.maximum(some[i, 2], back), _OPEN
        out.append(item)
    return np.concatenate(out)


def windows(texts: list[bytes], keys: np.ndarray, found: list[np.ndarray], length: int, q: int) -> np.ndarray:
    """An item for each window of what is still open; x is where it starts.

    lo and hi are halves of a hash of what it shares with its neighbours: of windows of one anchor, q // 2 in a row are
    dealt by the bytes that lie in all of them, so equal windows meet, and a run is found in pieces and not one by one.
    """
    out, d, step = [_new(0)], depth(length, q), q // 2
    for row, piece, some, at in _near(texts, keys, found, length):
        h = _Hashes(piece)
        grams = h.every(q)
        names = _covering(_deeper(grams, q, d), d, length)
        i, j = _each(some[:, 1] - some[:, 2] + 1)
        back, x = some[i, 1] - j, some[i, 0] - at
        item = _new(len(i))
        item["q"], item["c"] = grams[x], names[x - back] + back.astype(U)
        item["k"], item["t"] = keys[row]
        item["x"], item["kind"] = x - back + at, _OPEN
        core = x - back // step * step
        shared = h.of(core, core + length - step + 1)
        item["lo"], item["hi"] = shared >> U(48), shared >> U(32) & U(0xFFFF)
        out.append(item)
    return np.concatenate(out)


def _sorted(items: np.ndarray) -> np.ndarray:
    return items[np.lexsort((items["x"], items["t"], items["k"], items["c"], items["q"]))]


def _as_before(items: np.ndarray, *names: str) -> np.ndarray:
    """Whether each item has the same values in these columns as the one before it."""
    same = np.zeros(len(items), bool)
    same[1:] = np.logical_and.reduce([items[n][1:] == items[n][:-1] for n in names])
    return same


def _repeats(items: np.ndarray) -> np.ndarray:
    """Which of sorted items are not the earliest of their bucket."""
    same = _as_before(items, "q", "c")
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(items))))
    return same & ((items["k"] != items["k"][head]) | (items["t"] != items["t"][head]) | (items["x"] != items["x"][head]))  # the same row twice is not a repeat


def _many(items: np.ndarray, own: np.ndarray, *names: str) -> np.ndarray:
    """Whether the bucket (of equals in these columns, of sorted items) of each item has more than one of `own`."""
    bucket = np.cumsum(~_as_before(items, *names)) - 1
    return (np.bincount(bucket, weights=own) > 1)[bucket] if len(items) else np.zeros(0, bool)


def _settled_anchors(items: np.ndarray) -> np.ndarray:
    """Of a batch: repeats; of buckets with one stretch, that; of others, all, known to go on, and a sign."""
    items = _sorted(items)
    gone = _repeats(items)
    done, items = items[gone], items[~gone]
    done["kind"] = _REPEAT
    many = _many(items, np.ones(len(items)), "q")
    signs = items[many & ~_as_before(items, "q")]
    items["kind"][many], signs["kind"] = _KNOWN, _SIGN
    return np.concatenate([done, items, signs])


def _settled_middles(items: np.ndarray) -> np.ndarray:
    """Of a batch: buckets of one; of others, all, known to go on, and a sign."""
    items = _sorted(items)
    many = _many(items, np.ones(len(items)), "q", "c")
    signs = items[many & ~_as_before(items, "q", "c")]
    items["kind"][many], signs["kind"] = _KNOWN, _SIGN
    return np.concatenate([items, signs])


def _settled_windows(items: np.ndarray) -> np.ndarray:
    items = _sorted(items)
    items["kind"][_repeats(items)] = _REPEAT
    return items


def _packed(items: np.ndarray) -> bytes:
    """Rows, then column after column, places as differences: of items in order of row and place little is left to move."""
    new = np.flatnonzero(~_as_before(items, "k", "t"))
    parts = [np.array([len(new), len(items)], np.uint32), items["k"][new], items["t"][new], np.diff(np.append(new, len(items))).astype(np.uint32)]
    return b"".join(x.tobytes() for x in [*parts, *(np.diff(items[n], prepend=np.uint32(0)) if n == "x" else items[n] for n in _COLUMNS)])


def _unpacked(data: memoryview) -> np.ndarray:
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    rows, n = map(int, take("<u4", 2))
    items = _new(n)
    k, t, count = take("<i8", rows), take("<i8", rows), take("<u4", rows)
    items["k"], items["t"] = np.repeat(k, count), np.repeat(t, count)
    for name in _COLUMNS:
        column = take(_ITEM[name].str, n)
        items[name] = np.cumsum(column, dtype=np.uint32) if name == "x" else column
    return items


def _deal(items: np.ndarray, buckets: int, by: str) -> Iterator[pa.RecordBatch]:
    """Items to their buckets: by the q-gram, by the whole name, or by what neighbours share; those that need none, to any, by row."""
    alone = (items["kind"] == _REPEAT) | (by != "q") & (items["kind"] == _KNOWN)
    named = _joined(items["q"], items["c"])
    if by == "shared":
        named = _mix((items["lo"].astype(U) << U(16)) + items["hi"] + U(1))
        items["lo"], items["hi"] = 0, 0  # for dealing alone
    to = np.where(alone, _mix(items["k"].view(U) ^ items["t"].view(U)), np.where((by != "q") | (items["kind"] == _KNOWN), named, items["q"])) >> U(20)
    to = (to % U(buckets)).astype(np.int32)
    items["q"][alone], items["c"][alone] = 0, 0  # not asked for again, and nothing to move
    order = np.lexsort((items["x"], items["t"], items["k"], to))
    items, to = items[order], to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, int)
    ends = np.concatenate([cuts[1:], [len(to)]]) if len(to) else cuts
    yield pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int32()), pa.array([_packed(items[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["bucket", "items"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The items of one bucket after another; the rows come sorted by bucket."""
    at, held = None, []
    for b in batches:
        for bucket, items in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket != at and held:
                yield np.concatenate(held)
                held = []
            at = bucket
            held.append(_unpacked(memoryview(items.as_buffer())))
    if held:
        yield np.concatenate(held)


def _found(items: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(items["k"]), pa.array(items["t"]), pa.array(items["x"].astype(np.int64)), *(pa.array(y.astype(np.int32)) for y in (lo, hi, items["kind"]))], names=["k", "t", "x", "lo", "hi", "kind"])


def _refine_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for items in _by_bucket(batches):
        done = items[items["kind"] == _REPEAT]
        items = _sorted(items[items["kind"] != _REPEAT])
        signs = items["kind"] == _SIGN
        # a bucket stays open if it holds two stretches, or a sign of a batch with two
        stretch = np.where(signs, 2, ~_as_before(items, "q", "c"))
        many = _many(items, stretch, "q") | (items["kind"] == _KNOWN)
        items, many = items[~signs], many[~signs]
        gone = _repeats(items)
        items["kind"] = np.where(gone, _REPEAT, _OPEN)
        out = np.concatenate([done, items[gone | many]])
        yield _found(out, out["lo"], out["hi"])


def _refine_middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for items in _by_bucket(batches):
        known = items[items["kind"] == _KNOWN]
        items = _sorted(items[items["kind"] != _KNOWN])
        many = _many(items, np.where(items["kind"] == _SIGN, 2, 1), "q", "c")
        out = np.concatenate([known, items[many & (items["kind"] == _OPEN)]])
        out["kind"] = _OPEN
        yield _found(out, out["lo"], out["hi"])


def _refine_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for items in _by_bucket(batches):
            done = items[items["kind"] == _REPEAT]
            items = _sorted(items[items["kind"] == _OPEN])
            items = np.concatenate([done, items[_repeats(items)]])
            items["kind"] = _REPEAT
            items = items[np.lexsort((items["x"], items["t"], items["k"]))]
            x = items["x"].astype(np.int64)
            new = np.flatnonzero(~_as_before(items, "k", "t") | np.concatenate([[True], x[1:] > x[:-1] + length])[: len(x)])
            last = np.append(new[1:], len(x)) - 1 if len(x) else new
            # windows that touch are one run; it is told as an anchor whose windows reach from the first to the last
            yield _found(items[new], np.zeros(len(new)), x[new] - x[last])

    return run


def removed_runs(found: np.ndarray, size: int, length: int) -> np.ndarray:
    """Maximal [start, end) runs that the repeated windows cover; found has a row (x, lo, hi) for each anchor."""
    if not len(found):
        return np.empty((0, 2), np.int64)
    runs = np.stack([found[:, 0] - found[:, 1], np.minimum(found[:, 0] - found[:, 2] + length, size)], axis=1)
    runs = runs[np.argsort(runs[:, 0])]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], runs[1:, 0] > reach[:-1]]))
    return np.stack([runs[new, 0], np.concatenate([reach[new[1:] - 1], reach[-1:]])], axis=1)


def _triples(lists: pa.Array) -> list[np.ndarray]:
    """A list<struct<x, lo, hi>> column as an array of three columns for each row."""
    flat = lists.flatten()
    all_ = np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("x", "lo", "hi")], axis=1) if len(flat) else np.empty((0, 3), np.int64)
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], int)
    return np.split(all_, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _triples(lists: pa.Array) -> list[np.ndarray]:
    """A list<struct<x, lo, hi>> column as an array of three columns for each row."""
    flat = lists.flatten()
    all_ = np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("x", "lo", "hi")], axis=1) if len(flat) else np.empty((0, 3), np.int64)
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], int)
    return np.split(all_, np.cumsum(sizes)[:-1]) if len(sizes) else []


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, q: int = 20) -> DataFrame:
    """(k, t, text, found): every row, with list<struct<x, lo, hi>> of its repeated windows (see removed_runs())."""
    if not 2 <= q <= length - q + 1 or length >= 1 << 16:
        raise ValueError("length must be at least 2 * q - 1 and less than 65536")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = identified(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts, -(-size // BUCKET_BYTES))

    def dealt(df: DataFrame, make, by: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
                yield from _deal(make([t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()], keys, b), buckets, by)

        return df.mapInArrow(run, _BLOB).repartition(parts, "bucket").sortWithinPartitions("bucket")

    def listed(df: DataFrame) -> DataFrame:
        return df.groupBy("k", "t").agg(F.collect_list(F.struct("x", "lo", "hi")).alias("found"))

    def beside(found: DataFrame, how: str = "inner") -> DataFrame:
        return texts.join(listed(found).hint("shuffle_hash"), ["k", "t"], how).select("k", "t", "text", "found")

    first = dealt(texts, lambda t, k, _: _settled_anchors(anchors(t, k, length, q)), "q").mapInArrow(_refine_anchors, _FOUND)
    middle = dealt(beside(first.where(F.col("kind") == _OPEN)), lambda t, k, b: _settled_middles(middles(t, k, _triples(b.column(3)), length, q)), "name").mapInArrow(_refine_middles, _FOUND)
    last = dealt(beside(middle), lambda t, k, b: _settled_windows(windows(t, k, _triples(b.column(3)), length, q)), "shared").mapInArrow(_refine_windows(length), _FOUND)
    return beside(first.where(F.col("kind") == _REPEAT).unionAll(last), "left")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, q: int = 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the text's UTF-8 bytes without those that a string of `length` bytes covers which also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document. Overlaps count, and strings are judged on
    the input. Null texts count as empty; shorter texts than `length` stay whole. A null doc_id counts as the largest.
    Rows that share a doc_id are told apart by their texts, in the order of a hash of these; rows that share both count
    as one document, so all keep what one would. `kept` is binary, since a run may end inside a character. An empty
    table gives an empty one. `length` is from 2 * q - 1 to 65535.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(b.column(2), _triples(b.column(3)), strict=True):
                s = text.as_py().encode("utf-8", "surrogatepass")
                runs = removed_runs(found, len(s), length)
                edges = [0, *runs.ravel().tolist(), len(s)]
                kept = b"".join(s[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(out, (len(s), len(s) - len(kept), len(runs), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=["k", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = repeated_runs(docs, id_col, text_col, length, q).mapInArrow(cut, "k long, n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.select(id_of(F.col("k")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
