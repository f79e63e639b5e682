"""Documents in chunks, and an exchange that finds what repeats between them.

A chunk is one row that holds some megabytes of documents.  Chunks are written once, bucketed by
chunk number, so that a later join with what was found for a chunk moves only the findings, not the
texts.  Keys (hashes of windows) travel packed: one row per (bucket, chunk) holds the chunk's
distinct keys of that bucket, a few bytes each.  A key that fills a third of the corpus is thus one
entry per chunk, and no group grows faster than the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.sources.tables import bucketed

CHUNK_BYTES = 2 << 20
MOST_BUCKETS = 100_000  # Spark's own limit for a table
#: Low bits of a packed key.
MULTI, ANCHOR = np.uint64(1), np.uint64(2)

PROBES = "bucket int, chunk bigint, keys binary, ranks binary"
FOUND = "chunk bigint, keys binary, later binary"


def write_chunks(docs: DataFrame, text: str, chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """``(chunk, rows)`` with all columns of the documents inside ``rows``, and the number of buckets in which
    keys meet, one for each two chunks; a table has at most ``MOST_BUCKETS`` of them, the exchange has no limit.

    A chunk holds about ``chunk_bytes`` of text (one long text may exceed it); by default 2 MB, more
    beyond 8 GB, so that rows of the exchange do not grow with the square of the input.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    size = chunk_bytes or min(64 << 20, max(CHUNK_BYTES, total // 4096))
    buckets = max(1 + total // (2 * size), int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType(docs.schema.fields)))]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        held, weight, n = [], 0, 0

        def flush():
            rows = pa.concat_arrays([b.to_struct_array() for b in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([part + n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)],
                names=["chunk", "rows"],
            )

        for batch in batches:
            offsets = text_places(batch.column(text))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + size - weight, "right")) - 1
                to = min(batch.num_rows, max(to, at + (not held)))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    weight += int(offsets[to] - offsets[at])
                    at = to
                if at < batch.num_rows:
                    yield flush()
                    held, weight, n = [], 0, n + 1
        if held:
            yield flush()

    return bucketed(docs.mapInArrow(pack, schema), "chunk", min(MOST_BUCKETS, buckets), "chunks"), buckets


def text_places(texts: pa.Array) -> np.ndarray:
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)])


def pack_keys(
    hashes: np.ndarray, chunk: int, buckets: int, width: int, anchors: np.ndarray | None = None, ranks: np.ndarray | None = None
) -> pa.RecordBatch:
    """One row per bucket: the distinct hashes, ``width`` bytes each, marked where they occur more than
    once in the chunk or are anchors; ``ranks`` (the least of each) travel beside them."""
    order = np.lexsort((ranks, hashes)) if ranks is not None else np.argsort(hashes, kind="stable")
    h = hashes[order]
    fresh = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[fresh, len(h)])
    bucket = bucket_of(h[fresh], buckets)
    key = short(h[fresh], width) | np.where(size > 1, MULTI, np.uint64(0))
    if anchors is not None and len(h):
        key |= np.where(np.logical_or.reduceat(anchors[order], fresh), ANCHOR, np.uint64(0))
    by = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cut))
    key, least = key[by], ranks[order][fresh][by] if ranks is not None else None
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array(np.full(len(used), chunk), pa.int64()),
            pa.array([to_bytes(key[cut[b] : cut[b + 1]], width) for b in used], pa.binary()),
            pa.array([None if least is None else least[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()),
        ],
        names=["bucket", "chunk", "keys", "ranks"],
    )


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def short(hashes: np.ndarray, width: int) -> np.ndarray:
    """The part of a hash that travels, above two bits for marks."""
    return (hashes << np.uint64(66 - 8 * width) if width < 8 else hashes << np.uint64(2)) >> np.uint64(64 - 8 * width) & ~np.uint64(3)


def to_bytes(keys: np.ndarray, width: int) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_bytes(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def repeated(probes: DataFrame, width: int, need_anchor: bool = False) -> DataFrame:
    """``(chunk, found)``: the keys of each chunk that occur more than once in all chunks.

    With ranks, ``later`` marks the keys whose first place (least rank, then least chunk) is elsewhere.
    """

    def group(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        packed = [from_bytes(x, width) for x in table.column("keys").to_pylist()]
        ranks = table.column("ranks").to_pylist()
        row = np.repeat(np.arange(len(packed)), [len(x) for x in packed])
        key = np.concatenate(packed)
        ranked = ranks[0] is not None
        if ranked:
            rank = np.concatenate([np.frombuffer(x, np.int64) for x in ranks])
            order = np.lexsort((chunk[row], rank, key & ~np.uint64(3)))
        else:
            order = np.argsort(key & ~np.uint64(3), kind="stable")
        k, row = key[order], row[order]
        bare = k & ~np.uint64(3)
        fresh = np.flatnonzero(np.r_[True, bare[1:] != bare[:-1]])
        size = np.diff(np.r_[fresh, len(k)])
        marks = np.bitwise_or.reduceat(k, fresh)
        hit = (size > 1) | (marks & MULTI > 0)
        if need_anchor:
            hit &= marks & ANCHOR > 0
        later = np.ones(len(k), bool)
        later[fresh] = False
        keep = np.repeat(hit, size)
        k, row, later = bare[keep], row[keep], later[keep]
        by = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[by], np.arange(len(packed) + 1))
        used = np.flatnonzero(np.diff(cut))
        k, later = k[by], later[by]
        return pa.table(
            {
                "chunk": pa.array(chunk[used], pa.int64()),
                "keys": pa.array([to_bytes(k[cut[i] : cut[i + 1]], width) for i in used], pa.binary()),
                "later": pa.array([later[cut[i] : cut[i + 1]].tobytes() if ranked else None for i in used], pa.binary()),
            }
        )

    found = probes.groupBy("bucket").applyInArrow(group, FOUND)
    return found.groupBy("chunk").agg(F.collect_list(F.struct("keys", "later")).alias("found"))


def each_chunk(chunks: DataFrame, found: DataFrame | None, do: Callable, schema) -> DataFrame:
    """``do(chunk number, struct array of the documents, found)`` yields record batches."""
    alone = found is None
    # merged at every size: what is found grows with the data
    rows = chunks if alone else chunks.join(found.hint("merge"), "chunk", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column("rows").slice(i, 1).flatten()
                yield from do(batch.column("chunk")[i].as_py(), docs, None if alone else batch.column("found")[i].as_py() or [])

    return rows.mapInArrow(run, schema)


def found_keys(found: list[dict], width: int) -> np.ndarray:
    """The keys found for a chunk, sorted."""
    return np.sort(np.concatenate([from_bytes(x["keys"], width) for x in found] or [np.zeros(0, np.uint64)]))


def among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(found, keys)
    at[at == len(found)] = 0
    return found[at] == keys
