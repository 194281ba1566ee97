"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, keyed

#: Stands for a space in a piece.
SPACE = "▁"
#: Kinds of pieces, and what a character without a piece scores below the least piece; fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Words longer than this many bytes are decoded alone; others in groups of like length.
_WIDE = 64
_GROUP = 20_000
#: Words whose pieces a task keeps for the texts to come, before it forgets them.
_KNOWN = 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by identifier, from a model file."""
    out = []
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            f = dict(_fields(value))
            out.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, NORMAL)))
    return out


def log_scores(pieces: Sequence[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Scores that are ranks of merges (whole numbers, falling from 0) as log probabilities of a Zipf law; others as they are.

    A model of merges has no probabilities. Its order is one of falling frequency, so the piece of rank r gets
    -ln(r + 2), less the logarithm of their sum.
    """
    ranks = [-s for _, s, kind in pieces if kind == NORMAL]
    if not all(r >= 0 and r == int(r) for r in ranks):
        return list(pieces)
    total = math.log(sum(1 / (r + 2) for r in ranks))
    return [(p, -math.log(2 - s) - total if kind == NORMAL else s, kind) for p, s, kind in pieces]


@dataclass
class DoubleArray:
    """A trie in two arrays: the child of state s under byte c is base[s] + c if check of that is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, words: dict[bytes, int]) -> DoubleArray:
        tree: dict = {}
        for w, v in words.items():
            node = tree
            for c in w:
                node = node.setdefault(c, {})
            node[-1] = v
        size = 1 << 16
        base, check, value = [np.full(size, x, np.int32) for x in (0, -1, -1)]
        check[0] = 0
        free = bulk = 257  # the first free place, within reach of every byte; where nodes of several children are tried from
        todo = [(0, tree)]
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            codes = np.array(sorted(c for c in node if c >= 0), np.int64)
            if not len(codes):
                continue
            while check[free] >= 0:
                free += 1
            b = max(1, free - int(codes[0])) if len(codes) == 1 else bulk
            tries = 0
            while (check[b + codes] >= 0).any():
                b, tries = b + 1, tries + 1
            if tries > 64:
                bulk = b - 32
            if b + 512 >= len(check):
                base, check, value = (np.concatenate([a, np.full(len(a), x, np.int32)]) for a, x in ((base, 0), (check, -1), (value, -1)))
            base[state] = b
            check[b + codes] = state
            todo += [(b + int(c), node[int(c)]) for c in codes[::-1]]
        return cls(base, check, value)


@dataclass
class Unigram:
    """Pieces with log scores, ready to encode."""

    pieces: list[tuple[str, float, int]]
    trie: DoubleArray = field(init=False)
    scores: np.ndarray = field(init=False)
    bytes_: np.ndarray = field(init=False)
    raw: list[bytes] = field(init=False)
    known: dict[bytes, list[int]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        usable = {p.encode(): i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        if any(SPACE in p.lstrip(SPACE) for p in map(bytes.decode, usable)):
            raise ValueError("a piece spans two words")
        self.trie = DoubleArray.build(usable)
        self.scores = np.array([s for _, s, _ in self.pieces], np.float32)
        self.unknown = np.float32(min(self.scores[list(usable.values())]) - UNKNOWN_PENALTY)
        self.bytes_ = np.full(256, next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0))
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes_[int(p[3:5], 16)] = i
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.encode() for p, _, kind in self.pieces]

    def best(self, words: list[bytes]) -> list[list[int]]:
        """The best pieces of each word; all are decoded together, a byte position at a time."""
        n, sizes = len(words), np.array([len(w) for w in words])
        wide = int(sizes.max())
        text = np.zeros((n, wide), np.uint8)
        text[np.arange(wide) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((n, wide + 1), -np.inf, np.float32)
        best[:, 0] = 0
        start, piece = np.zeros((n, wide + 1), np.int32), np.full((n, wide + 1), -1, np.int32)
        char = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(wide):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (sizes > i))
            if not len(rows):
                continue
            unit = char[rows, i]
            single = np.zeros(len(rows), bool)
            live, at, j = np.arange(len(rows)), np.zeros(len(rows), np.int32), i
            while len(live) and j < wide:
                nxt = base[at] + text[rows[live], j]
                ok = (check[nxt] == at) & (base[at] > 0) & (sizes[rows[live]] > j)
                live, at = live[ok], nxt[ok]
                j += 1
                v = value[at]
                if len(hit := np.flatnonzero(v >= 0)):
                    r = rows[live[hit]]
                    single[live[hit]] |= unit[live[hit]] == j - i
                    self._offer(best, start, piece, r, i, j, best[r, i] + self.scores[v[hit]], v[hit])
            if len(lone := np.flatnonzero(~single)):
                for u in np.unique(unit[lone]):
                    r = rows[lone[unit[lone] == u]]
                    j = min(i + int(u), wide)
                    self._offer(best, start, piece, r, i, j, best[r, i] + self.unknown, np.full(len(r), -1, np.int32))
        out = []
        for row, w in enumerate(words):
            end, ids = len(w), []
            while end > 0:
                p, s = piece[row, end], start[row, end]
                ids += [int(p)] if p >= 0 else self.bytes_[list(w[s:end])].tolist()[::-1]
                end = s
            out.append(ids[::-1])
        return out

    @staticmethod
    def _offer(best, start, piece, rows, i, j, score, ids) -> None:
        better = score > best[rows, j]
        rows = rows[better]
        best[rows, j], start[rows, j], piece[rows, j] = score[better], i, ids[better]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Identifiers of each text. A space goes before the text and stands in pieces as the marker; empty texts have none."""
        split = [self._words(t) for t in texts]
        if len(self.known) > _KNOWN:
            self.known.clear()
        known = self.known
        distinct = sorted({w for ws in split for w in ws if w not in known}, key=len)
        at = 0
        while at < len(distinct):
            many = _GROUP if len(distinct[at]) <= _WIDE else max(1, _GROUP * _WIDE // (len(distinct[at]) * 16))
            some = distinct[at : at + many]
            if len(some[0]) <= _WIDE < len(some[-1]):
                some = [w for w in some if len(w) <= _WIDE]
            known |= zip(some, self.best(some), strict=True)
            at += len(some)
        return [np.array([i for w in ws for i in known[w]], np.int32) for ws in split]

    @staticmethod
    def _words(text: str) -> list[bytes]:
        """Each word with the markers before it: no piece spans two, so each is decoded on its own."""
        if not text:
            return []
        data = (SPACE + text.replace(" ", SPACE)).encode("utf-8", "replace")
        mark, out, held = SPACE.encode(), [], b""
        for part in data.split(mark)[1:]:
            held += mark
            if part:
                out.append(held + part)
                held = b""
        return out + [held] * bool(held)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of identifiers: bytes joined, markers as spaces, without the first."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if out[:1] == " " else out


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", group: int = 256) -> DataFrame:
    """(doc_id, ids, exact): the identifiers of each whole text, and whether they decode to it.

    The model file is read where the query is called and its arrays go to the tasks; its size is that of a vocabulary.
    Null counts as empty and has no identifiers. A text that holds the marker itself decodes to a space, so `exact` is
    false there. Repeated rows are encoded each; a null doc_id stays null. An empty table gives an empty one. Texts are
    encoded where they lie, without a shuffle, `group` at a time.
    """
    engine = Unigram(log_scores(read_pieces(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, group):
                texts = b.column(1).slice(at, group).to_pylist()
                ids = engine.encode(texts)
                exact = [engine.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, group), pa.array(ids, pa.list_(pa.int32())), pa.array(exact)], names=["k", "ids", "exact"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "k long, ids array<int>, exact boolean").select(id_of(F.col("k")).alias("doc_id"), "ids", "exact")


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each row's identifiers; null identifiers give an empty text."""
    engine = Unigram(read_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([engine.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
