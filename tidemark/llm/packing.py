"""Packing documents into training sequences of several lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, id_of, materialise

#: Permitted lengths of a sequence, in tokens.
CAPACITIES = 512, 1024, 2048, 4096, 8192
#: What a sequence costs besides its tokens, and the cost of a token pair in attention.
OVERHEAD, PER_PAIR = 32.0, 1 / 65536
#: Tokens and pieces that are packed together; the number of such groups grows with the input.
SHARD_TOKENS, SHARD_PIECES = 2_000_000, 100_000
_SEED = 7


def cost(capacity: int) -> float:
    return capacity + OVERHEAD + PER_PAIR * capacity * capacity


class _Sizes:
    """A multiset of whole numbers that finds the largest up to a bound and the least from one; a bit is set for each that it holds."""

    def __init__(self):
        self.mask = 0
        self.count: dict[int, int] = {}

    def add(self, n: int, by: int = 1) -> None:
        left = self.count.get(n, 0) + by
        self.count[n] = left
        self.mask = self.mask | 1 << n if left else self.mask & ~(1 << n)

    def up_to(self, n: int) -> int:
        """The largest number held that is at most n; -1 if there is none."""
        return (self.mask & ((1 << (n + 1)) - 1)).bit_length() - 1

    def at_least(self, n: int) -> int:
        """The least number held that is at least n; -1 if there is none."""
        m = self.mask >> n
        return n + (m & -m).bit_length() - 1 if m else -1


def _downsized(held: int, caps: Sequence[int]) -> int:
    return next(c for c in caps if c >= held)


def _fill(n: int, cap: int, todo: _Sizes) -> int:
    """What a bin of that capacity can come to hold, if after n it takes the longest that fits of what is still to come, again and again."""
    held, bound = n, cap - n
    while bound > 0 and (size := todo.up_to(bound)) > 0:
        taken = size * min(todo.count[size], (cap - held) // size)
        held += taken
        bound = min(size - 1, cap - held)
    return held


def _packed(lengths: Sequence[int], caps: Sequence[int], only: int | None) -> tuple[list[int], list[int]]:
    """(bin of each piece, tokens of each bin) by one policy: bins open at the capacity that its expected content makes cheapest, or at `only`."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    todo, rooms, by_room = _Sizes(), _Sizes(), {}
    for n in lengths:
        todo.add(n)
    bins, held = [0] * len(lengths), []
    for i in order:
        n = lengths[i]
        todo.add(n, -1)
        free = rooms.at_least(n)
        if free >= 0:
            b = by_room[free].pop()
            rooms.add(free, -1)
        else:
            able = [c for c in caps if c >= n]
            if only is not None:
                free = only if only >= n else able[0]
            else:
                filled = {c: _fill(n, c, todo) for c in able}
                free = min(able, key=lambda c: (cost(_downsized(filled[c], caps)) / max(1, filled[c]), -filled[c], c))
            b = len(held)
            held.append(0)
        bins[i] = b
        held[b] += n
        by_room.setdefault(free - n, []).append(b)
        rooms.add(free - n)
    return bins, held


def _merged(held: list[int], caps: Sequence[int]) -> list[int]:
    """The bin that each bin goes to: two that are not full become one where that is cheaper."""
    to, size = list(range(len(held))), list(held)
    todo, who = _Sizes(), {}
    for b, h in enumerate(held):
        if _downsized(h, caps) > h:
            todo.add(h)
            who.setdefault(h, []).append(b)
    for b in sorted((b for bs in who.values() for b in bs), key=lambda b: (held[b], b)):
        h = size[b]
        if to[b] != b or b not in who.get(h, ()):
            continue
        who[h].remove(b)
        todo.add(h, -1)
        options = []
        for c in caps:
            if c >= h and (o := todo.up_to(c - h)) >= 0:
                options.append((cost(_downsized(h, caps)) + cost(_downsized(o, caps)) - cost(_downsized(h + o, caps)), o))
        if options and max(options)[0] > 0:
            o = max(options)[1]
            other = who[o].pop()
            todo.add(o, -1)
            to[b], size[other] = other, h + o
            h, b = h + o, other
        if _downsized(h, caps) > h:
            todo.add(h)
            who.setdefault(h, []).append(b)
    for b in range(len(to)):
        while to[b] != to[to[b]]:
            to[b] = to[to[b]]
    return to


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each piece, and the capacity of each bin. No piece is longer than the largest capacity.

    Longest first, a piece goes where least room is left, over open bins of every capacity. If none has room, each
    capacity is tried against the lengths still to come: what it would come to hold, shrunk to the least capacity that
    holds it, gives a cost for each token, and the cheapest opens. The same is done with each capacity alone, and the
    cheapest packing of all is taken, so several capacities never cost more than one. Then bins that are not full are
    put together where one is cheaper than two, and every bin shrinks to the smallest capacity that holds its content.
    """
    caps = sorted(capacities)
    best = None
    for only in (None, *caps):
        bins, held = _packed(lengths, caps, only)
        to = _merged(held, caps)
        new: dict[int, int] = {}
        bins = [new.setdefault(to[b], len(new)) for b in bins]
        offsets, filled = [0] * len(lengths), [0] * len(new)
        for i, b in enumerate(bins):
            offsets[i] = filled[b]
            filled[b] += lengths[i]
        sizes = [_downsized(h, caps) for h in filled]
        price = sum(map(cost, sizes))
        if best is None or price < best[0] - 1e-9:
            best = price, bins, offsets, sizes
    return best[1], best[2], best[3]


def word_count(text: Column) -> Column:
    """Words of a text and one for its end: the length unless one is given. Null counts as empty."""
    return F.size(F.filter(F.split(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), " "), lambda w: w != "")) + 1


def _dealt(rows: DataFrame, top: int, shard_tokens: int, *payload: Column) -> DataFrame:
    """Pieces (k, piece, start, n_tokens, shard, ...) of rows (k, n, ...) that have been written, dealt to shards at random."""
    sums = rows.agg(F.sum("n").alias("tokens"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / top))).alias("pieces")).first()
    shards = max(1, -(-(sums["tokens"] or 0) // shard_tokens), -(-(sums["pieces"] or 0) // SHARD_PIECES))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / top)).cast("int")
    start = F.col("piece").cast("long") * top
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    pieces = pieces.select("k", "piece", start.alias("start"), F.least(F.lit(top), F.col("n") - start).alias("n_tokens"), *payload)
    return pieces.withColumn("shard", F.floor(F.rand(_SEED) * shards).cast("long"))


def _one(capacities: Sequence[int]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "k", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets, caps = best_fit(group["n_tokens"].tolist(), capacities)
        return group.assign(bin=bins, offset=offsets, capacity=np.array(caps, np.int64)[bins])

    return run


_PLACED = "bin long, offset long, capacity long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, capacities: Sequence[int] = CAPACITIES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, piece, start, n_tokens, shard, bin, offset, capacity): where each piece of each document lies.

    A document longer than the largest capacity is cut into full pieces and a rest; none is dropped. `length` is the
    number of tokens, by default words and one for the end; null or negative counts as 0, and a document of no tokens
    has one piece of 0. (shard, bin) names a sequence and capacity its length. Only identifiers and lengths are
    shuffled; they are written first, so texts are read once. Shards are dealt at random (by a fixed seed) and hold
    about shard_tokens or SHARD_PIECES, whichever is reached first, so a task's work is bounded, their number grows
    with the input and no identifier makes one large. Repeated rows are packed each; in a shard ties are broken by
    doc_id and piece. An empty table gives an empty one.
    """
    n = F.greatest(F.coalesce((word_count(F.col(f"`{text_col}`")) if length is None else length).cast("long"), F.lit(0)), F.lit(0))
    rows, _ = materialise(docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY)).alias("k"), n.alias("n")), "lengths")
    pieces = _dealt(rows, max(capacities), shard_tokens)
    out = pieces.groupBy("shard").applyInPandas(_one(capacities), f"k long, piece int, start long, n_tokens long, shard long, {_PLACED}")
    return out.select(id_of(F.col("k")).alias("doc_id"), "piece", "start", "n_tokens", "shard", "bin", "offset", "capacity")


def pack_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", end: int = 2, capacities: Sequence[int] = CAPACITIES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, bin, capacity, doc_ids, starts, ids): the training sequences of encoded documents, as unigram.encode_pieces() makes them.

    Each document's identifiers, with `end` after them, lie in one sequence, or in several if they are more than the
    largest capacity. ids are those of a whole sequence, at most `capacity`; doc_ids and starts name the document and
    the first position of each piece in it. Null identifiers count as none, so only the end is packed. Rows are
    handled as in pack().
    """
    ids = F.concat(F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>")), F.array(F.lit(end)))
    rows, _ = materialise(encoded.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY)).alias("k"), ids.alias("ids"), F.size(ids).cast("long").alias("n")), "encoded")
    part = F.slice("ids", (F.col("piece") * max(capacities) + 1).cast("int"), F.lit(max(capacities))).alias("ids")
    pieces = _dealt(rows, max(capacities), shard_tokens, part)
    kinds = f"k long, piece int, start long, n_tokens long, ids array<int>, shard long, {_PLACED}"
    placed = pieces.groupBy("shard").applyInPandas(_one(capacities), kinds)
    bins = placed.groupBy("shard", "bin", "capacity").agg(F.array_sort(F.collect_list(F.struct("offset", "k", "piece", "start", "ids"))).alias("parts"))
    return bins.select("shard", "bin", "capacity", F.transform("parts", lambda p: id_of(p["k"])).alias("doc_ids"), F.col("parts.offset").alias("starts"), F.flatten("parts.ids").alias("ids"))
