"""Byte-level BPE by a segment tree.

The tree's leaves are the byte positions of a piece; a leaf holds the rank of the pair that begins
there, and every inner node the least rank below it, the leftmost of equals.  The root names the next
merge.  A merge writes three leaves (the pair itself, its left live neighbour, and the swallowed right
one) and the nodes above them: logarithmic work, so a piece of n bytes costs n log n.  Short distinct
pieces are merged side by side, one tree per row of an array; long ones one at a time.

A piece that is itself in the vocabulary gets its id directly.  Null is an empty text and has no ids.
Ids are ranks.  Decoding joins the bytes of the ids.  All columns pass through; result columns replace
input columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaugeline.llm.columns import beside
from gaugeline.llm.pieces import PieceCoder, encoded

NONE = np.int64(1) << 40
#: Pieces up to so many bytes are merged side by side.
ABREAST = 64
#: Rows of a result batch.
ROWS = 1000


class Ranks:
    """A rank file: each line holds a token in base 64 and its rank.  Ranks are 0, 1, 2, …."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, ``NONE`` where they don't merge; a negative id is no token."""
        key = left << 32 | np.maximum(right, 0)
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        good = (self.pair_keys[at] == key) & (right >= 0) & (left >= 0)
        return np.where(good, self.pair_ranks[at], NONE)


@lru_cache(maxsize=4)
def load(path: str) -> Ranks:
    return Ranks(path)


def merge_abreast(ranks: Ranks, pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Merge pieces of at most ``width`` bytes (a power of two); row i of ``tree`` is the tree of piece i.

    A node holds ``rank << 8 | position``, so the least value is the leftmost least rank.
    """
    n = len(pieces)
    size = np.array([len(p) for p in pieces])
    raw = np.zeros((n, width), np.uint8)
    inside = np.arange(width) < size[:, None]
    raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    token = np.where(inside, ranks.bytes[raw], -1)
    place = np.arange(width)
    after = np.where(place + 1 < size[:, None], place + 1, -1)
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE << 8, np.int64)
    right = np.full((n, width), -1, np.int64)
    right[:, :-1] = token[:, 1:]
    tree[:, width:] = ranks.merged(token.ravel(), right.ravel()).reshape(n, width) << 8 | place
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

    def write(row, leaf, rank):
        node = leaf + width
        tree[row, node] = rank << 8 | leaf
        node = node >> 1
        while node[0]:  # all rows have the same depth
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1

    def rank_at(row, leaf):
        follower = after[row, leaf]
        return ranks.merged(token[row, leaf], np.where(follower >= 0, token[row, follower], -1))

    row = np.flatnonzero(tree[:, 1] >> 8 < NONE) if width > 1 else np.zeros(0, np.int64)
    while len(row):
        root = tree[row, 1]
        leaf, rank = root & 255, root >> 8
        gone = after[row, leaf]
        token[row, leaf] = rank
        token[row, gone] = -1
        follower = after[row, gone]
        after[row, leaf] = follower
        linked = follower >= 0
        before[row[linked], follower[linked]] = leaf[linked]
        write(row, gone, np.full(len(row), NONE))
        write(row, leaf, rank_at(row, leaf))
        left = before[row, leaf]
        has = left >= 0
        if has.any():
            write(row[has], left[has], rank_at(row[has], left[has]))
        row = row[tree[row, 1] >> 8 < NONE]
    flat, ends = token[token >= 0], np.cumsum((token >= 0).sum(axis=1))
    return np.split(flat, ends[:-1])


def merge_alone(ranks: Ranks, piece: bytes) -> list[int]:
    """The same tree for one piece of any length, in plain lists."""
    n, none, pairs = len(piece), int(NONE), ranks.pairs
    token = [int(ranks.bytes[b]) for b in piece]
    width = 1 << max(n - 1, 1).bit_length()
    after = [*range(1, n), -1]
    before = list(range(-1, n - 1))
    shift = width.bit_length()
    tree = [none << shift] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = pairs.get(token[i] << 32 | token[i + 1], none) << shift | i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def write(leaf, rank):
        node = leaf + width
        tree[node] = rank << shift | leaf
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    def rank_at(leaf):
        follower = after[leaf]
        return pairs.get(token[leaf] << 32 | token[follower], none) if follower >= 0 else none

    while (root := tree[1]) >> shift < none:
        leaf = root & ((1 << shift) - 1)
        gone = after[leaf]
        token[leaf], token[gone] = root >> shift, -1
        follower = after[leaf] = after[gone]
        if follower >= 0:
            before[follower] = leaf
        write(gone, none)
        write(leaf, rank_at(leaf))
        if before[leaf] >= 0:
            write(before[leaf], rank_at(before[leaf]))
    return [t for t in token if t >= 0]


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> list:
    out: list = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        rank = ranks.ids.get(piece)
        if rank is not None:
            out[i] = [rank]
        elif len(piece) > ABREAST:
            out[i] = merge_alone(ranks, piece)
        else:
            classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for width, members in classes.items():
        for a in range(0, len(members), 1 << 16):
            some = members[a : a + (1 << 16)]
            for i, ids in zip(some, merge_abreast(ranks, [pieces[i] for i in some], width), strict=True):
                out[i] = ids
    return out


@lru_cache(maxsize=4)
def coder(path: str) -> PieceCoder:
    ranks = load(path)
    return PieceCoder(lambda pieces: encode_pieces(ranks, pieces))


def _replace(docs: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """All columns and new ones; ``make(batch)`` gives the new columns' arrays."""
    new = [f.name for f in fields]
    columns = beside(docs.columns, new)
    schema = T.StructType([docs.schema[c] for c in columns] + fields)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + make(batch), names=columns + new)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with their ids (array of int)."""

    def make(batch):
        rows = list(encoded(batch.column(text), coder(path)))
        ends = np.cumsum([0, *map(len, rows)])
        flat = np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]

    return _replace(docs, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The documents with the bytes that their ids stand for; null ids give empty bytes."""

    def make(batch):
        tokens = load(path).tokens
        lists = batch.column(ids)
        flat, sizes = lists.flatten().to_numpy(), np.diff(_ends(lists))
        cut = np.cumsum(np.r_[0, sizes])
        return [pa.array([b"".join([tokens[i] for i in flat[a:b].tolist()]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())]

    return _replace(docs, [T.StructField(decoded, T.BinaryType())], make)


def _ends(lists: pa.ListArray) -> np.ndarray:
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[0, sizes])


def encode_checked(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with their ids, and ``decoded_sha256`` of the bytes decoded from these, in one pass."""

    def make(batch):
        tokens = load(path).tokens
        rows = list(encoded(batch.column(text), coder(path)))
        ends = np.cumsum([0, *map(len, rows)])
        flat = np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int32)
        digests = [hashlib.sha256(b"".join([tokens[i] for i in row.tolist()])).hexdigest() for row in rows]
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(digests, pa.string())]

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]
    return _replace(docs, fields, make)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The documents' columns, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by commas, and
    ``decoded_sha256`` of the bytes decoded from the ids.  One pass; ids do not leave the task."""

    def make(batch):
        tokens = load(path).tokens
        decimals = _decimals(path)
        counts, ids_hash, decoded_hash = [], [], []
        for row in encoded(batch.column(text), coder(path)):
            listed = row.tolist()
            counts.append(len(listed))
            ids_hash.append(hashlib.sha256(b",".join([decimals[i] for i in listed])).hexdigest())
            decoded_hash.append(hashlib.sha256(b"".join([tokens[i] for i in listed])).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]

    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return _replace(docs, fields, make)


@lru_cache(maxsize=4)
def _decimals(path: str) -> list[bytes]:
    return [b"%d" % i for i in range(len(load(path).tokens))]
