"""Token ids in length-delimited binary files.

A file is a sequence of frames, one per document, in ascending order of id (null first, then by a hash
of the text):

    uint64 length of the record | uint32 masked CRC of these 8 bytes | record | uint32 masked CRC of the
    record | one line feed

A record is: one byte, the width of an id (2 or 4); one byte, 1 if the document has an id; int64 the
document's id (0 for none); then the token ids.  All numbers are little-endian.  CRCs are CRC-32,
masked by rotating right by 15 bits and adding 0xA282EAD8, so that a checksum of data that holds
checksums stays sound.

Files are written by Spark's text writer (raw bytes, the line feed being its separator), so any store
that Spark writes to will do and a lost task is written again.  File numbers follow the order of ids.  The
index, a table beside the files, tells file, offset and length of each frame.

Strings of the vocabulary's added tokens are ordinary text, or their ids with ``added_tokens``.

Null and empty texts hold the end id only.  Repeated rows and ids are documents of their own.  An
empty table gives no frames.  Damaged or cut frames raise an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.llm.pieces import PieceCoder, encoded

FILE_BYTES = 16 << 20
_ABREAST = 4096
_ROWS = 1000  # of a result batch
_HEAD = struct.Struct("<QI")
_START = struct.Struct("<BBq")
_CRC = struct.Struct("<I")


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(record: bytes) -> bytes:
    """A frame without its line feed."""
    size = struct.pack("<Q", len(record))
    return b"".join((size, _CRC.pack(masked_crc(size)), record, _CRC.pack(masked_crc(record))))


def frames(content: bytes) -> Iterator[tuple[int, memoryview]]:
    """Offset and record of each frame of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        if len(view) - at < _HEAD.size:
            raise ValueError(f"cut frame at {at}")
        size, crc = _HEAD.unpack_from(view, at)
        if masked_crc(view[at : at + 8]) != crc:
            raise ValueError(f"damaged length at {at}")
        begin, end = at + _HEAD.size, at + _HEAD.size + size
        if end + 5 > len(view):
            raise ValueError(f"cut frame at {at}")
        if masked_crc(view[begin:end]) != _CRC.unpack_from(view, end)[0] or view[end + 4] != 10:
            raise ValueError(f"damaged record at {at}")
        yield at, view[begin:end]
        at = end + 5


def pack(doc: int | None, ids: np.ndarray, width: int) -> bytes:
    head = _START.pack(width, doc is not None, doc or 0)
    return frame(head + ids.astype("<u2" if width == 2 else "<u4").tobytes())


def frame_at(view: memoryview, offset: int, length: int) -> memoryview:
    """The record of one frame."""
    ((_, record),) = frames(view[offset : offset + length + _HEAD.size + 5])
    return record


def unpack(record: memoryview) -> tuple[int | None, np.ndarray]:
    width, has, doc = _START.unpack_from(record, 0)
    ids = np.frombuffer(record, "<u2" if width == 2 else "<u4", offset=_START.size)
    return doc if has else None, ids


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return library


@lru_cache(maxsize=4)
def coder(path: str) -> tuple[PieceCoder, int]:
    """Encodes with the tokenizers library: each distinct piece of the pre-tokenizer's split is encoded
    once.  Strings of special tokens are ordinary text.  Also the width of an id.

    Pieces that begin with a blank before another character end where the next such piece begins, so
    the library gets them joined, and the lengths of its tokens tell them apart again.
    """
    library = _library(path)
    vocabulary = library.get_vocab()
    size = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        size[i] = len(token)  # in the library's spelling a character stands for a byte

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(pieces: list[bytes]) -> list:
        out: list = [None] * len(pieces)
        texts = [p.decode() for p in pieces]
        joined = [i for i, t in enumerate(texts) if len(t) > 1 and t[0] == " " and not t[1].isspace()]
        for at in range(0, len(joined), _ABREAST):
            some = joined[at : at + _ABREAST]
            (ids,) = encode(["".join([texts[i] for i in some])])
            ends = np.cumsum([len(pieces[i]) for i in some])
            reached = np.cumsum(size[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if len(ids) and cuts[-1] == len(ids) and (reached[cuts - 1] == ends).all():
                for i, own in zip(some, np.split(ids, cuts[:-1]), strict=True):
                    out[i] = own
        left = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(left), _ABREAST):
            some = left[at : at + _ABREAST]
            for i, ids in zip(some, encode([texts[i] for i in some]), strict=True):
                out[i] = ids
        return out

    return PieceCoder(encode_new), 2 if library.get_vocab_size() <= 1 << 16 else 4


def _with_added(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text; the library gets texts that hold an added token whole."""
    pieces, _ = coder(path)
    library = _library(path)
    holds = np.zeros(len(texts), bool)
    for token in library.get_added_tokens_decoder().values():
        holds |= pc.match_substring(texts, token.content).to_numpy(zero_copy_only=False)
    for text, held, ids in zip(texts, holds.tolist(), encoded(texts, pieces), strict=True):
        if held:
            library.encode_special_tokens = False
            ids = np.array(library.encode(text.as_py(), add_special_tokens=False).ids, np.uint32)
            library.encode_special_tokens = True
        yield ids


def write(
    docs: DataFrame, folder: str, path: str, text: str = "text", key: str = "doc_id", end_id: int = 0, added_tokens: bool = False
) -> None:
    """Encode all documents and write ``folder/data`` and ``folder/index``; ``key`` is an integer column.

    With ``added_tokens`` strings of added tokens get their ids, as the library does by default."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1 + total // FILE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def records(batches):
        pieces, width = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                coded = _with_added(some.column("text"), path) if added_tokens else encoded(some.column("text"), pieces)
                texts = zip(some.column("key").to_pylist(), coded, strict=True)
                out = [pack(doc, np.append(ids, np.uint32(end_id)), width) for doc, ids in texts]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    framed = ranged.mapInArrow(records, "frame binary")
    framed.select(F.col("frame").cast("string")).write.option("lineSep", "\n").text(f"{folder}/data")

    def listed(name, content):
        n = 0
        for at, record in frames(content):
            doc, ids = unpack(record)
            yield name, n, at, len(record), doc, len(ids)
            n += 1

    _each_file(spark, folder, listed, "file int, place bigint, offset bigint, length bigint, key bigint, n_ids bigint").write.parquet(
        f"{folder}/index"
    )


def _each_file(spark: SparkSession, folder: str, rows: Callable, schema: str) -> DataFrame:
    """``rows(file number, content)`` of every data file."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.strip().split()[1]] for f in schema.split(",")]

    def read(batches):
        for batch in batches:
            for number, content in zip(batch.column("number").to_pylist(), batch.column("content"), strict=True):
                held = list(rows(number, content.as_buffer()))
                for a in range(0, len(held), _ROWS):
                    columns = zip(*held[a : a + _ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(f"{folder}/data")
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("number")
    return files.select(number, "content").mapInArrow(read, schema)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``key``, ``ids``, and ``file`` and ``place`` of all documents."""

    def rows(number, content):
        for place, (_, record) in enumerate(frames(content)):
            doc, ids = unpack(record)
            yield number, place, doc, ids.astype(np.int32)

    return _each_file(spark, folder, rows, "file int, place bigint, key bigint, ids array<int>")


def read_picked(spark: SparkSession, folder: str, picked: DataFrame) -> DataFrame:
    """``key`` and ``ids`` of frames of the index, as many as ``picked`` (rows of the index, each with a
    ``shard`` to put it into) lists, cut from the files by offset and length."""
    wanted = picked.groupBy("file").agg(F.collect_list(F.struct("offset", "length", "shard")).alias("cuts"))
    files = spark.read.format("binaryFile").load(f"{folder}/data")
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file")
    joined = files.select(number, "content").join(wanted, "file")

    def cut(batches):
        for batch in batches:
            for content, cuts in zip(batch.column("content"), batch.column("cuts").to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                got = []
                for c in cuts:
                    doc, ids = unpack(frame_at(view, c["offset"], c["length"]))
                    got.append((c["shard"], doc, ids.astype(np.int32)))
                shard, doc, ids = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array(doc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                    names=["shard", "key", "ids"],
                )

    return joined.mapInArrow(cut, "shard int, key bigint, ids array<int>")


def shuffled(spark: SparkSession, folder: str, shards: int, seed: int) -> DataFrame:
    """The index with a seeded shard for each frame, to be read by ``read_picked``."""
    drawn = F.pmod(F.xxhash64("file", "offset", F.lit(seed)), F.lit(shards)).cast("int")
    return index(spark, folder).withColumn("shard", drawn)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""

    def rows(number, content):
        at = 0
        for _, record in frames(content):
            doc, ids = unpack(record)
            yield number, doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
            at += len(ids)

    held = _each_file(spark, folder, rows, "file int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    # one row per file
    totals = index(spark, folder).groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    begins = totals.select("file", before.alias("begin"))
    return held.join(begins, "file").select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
