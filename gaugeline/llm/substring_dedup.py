"""Substring de-duplication by fixed-block anchors.

Every text is cut into non-overlapping blocks of half a window; any window of ``window`` words holds a
whole block of each text in which it occurs.  The blocks are the index, all rolling windows of block
length are the probes, and both meet in one packed exchange (``chunks``).  A probe that meets an
anchor seen elsewhere is a hit.  Hits are extended: the full windows around them meet in a second
exchange on their own hashes, and neighbouring repeated windows join to maximal exact repeats.

Hashes have 64 bits.  In the first exchange 38 of them travel besides the bucket; what they let
through wrongly, the second exchange drops.

Corner cases: a null or empty text has no words; a text shorter than the window keeps everything;
repeated rows and repeated ids are separate texts, so identical long texts lose all their words; an
empty table gives an empty table; all columns are passed through, whatever their names, and result
columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm import chunks as C
from gaugeline.llm.columns import beside, unused
from gaugeline.llm.words import covered, gram_hashes, span_hashes, text_bytes, word_spans

WINDOW = 35
_PROBE_WIDTH, _WINDOW_WIDTH = 5, 8


def _words(docs: pa.StructArray, text: str):
    data, offsets = text_bytes(docs.field(text))
    starts, ends, first = word_spans(data, offsets)
    return data, starts, ends, first, span_hashes(data, starts, ends)


def _aligned(at: np.ndarray, first: np.ndarray, block: int) -> np.ndarray:
    begin = first[np.searchsorted(first, at, "right") - 1]
    return (at - begin) % block == 0


def _near(hits: np.ndarray, at: np.ndarray, block: int, window: int) -> np.ndarray:
    """Which windows at ``at`` hold a hit, that is a block beginning at one of ``hits``."""
    ahead = np.searchsorted(hits, at)
    ahead[ahead == len(hits)] = 0
    return (hits[ahead] >= at) & (hits[ahead] <= at + window - block) if len(hits) else np.zeros(len(at), bool)


def repeats(docs: DataFrame, text: str, window: int, render, fields: list[T.StructField]) -> DataFrame:
    """All columns of the documents and the fields that ``render`` gives for the words of a chunk."""
    block = (window + 1) // 2
    chunks, buckets = C.write_chunks(docs, text)
    new = [f.name for f in fields]
    columns = beside(docs.columns, new)

    def probe(chunk, rows, _):
        *_, first, hashes = _words(rows, text)
        grams, at = gram_hashes(hashes, first, block)
        yield C.pack_keys(grams, chunk, buckets, _PROBE_WIDTH, anchors=_aligned(at, first, block))

    def extend(chunk, rows, found):
        *_, first, hashes = _words(rows, text)
        grams, at = gram_hashes(hashes, first, block)
        hits = at[C.among(C.short(grams, _PROBE_WIDTH), C.found_keys(found, _PROBE_WIDTH))]
        full, begin = gram_hashes(hashes, first, window)
        yield C.pack_keys(full[_near(hits, begin, block, window)], chunk, buckets, _WINDOW_WIDTH)

    def finish(chunk, rows, found):
        data, starts, ends, first, hashes = _words(rows, text)
        full, begin = gram_hashes(hashes, first, window)
        repeated = begin[C.among(C.short(full, _WINDOW_WIDTH), C.found_keys(found, _WINDOW_WIDTH))]
        gone = covered(repeated, window, len(starts))
        added = render(data, starts, ends, first, gone)
        yield pa.RecordBatch.from_arrays([rows.field(c) for c in columns] + [added[n] for n in new], names=columns + new)

    hits = C.repeated(C.each_chunk(chunks, None, probe, C.PROBES), _PROBE_WIDTH, need_anchor=True)
    windows = C.repeated(C.each_chunk(chunks, hits, extend, C.PROBES), _WINDOW_WIDTH)
    schema = T.StructType([docs.schema[c] for c in columns] + fields)
    return C.each_chunk(chunks, windows, finish, schema)


def _digests(data, starts, ends, first, gone):
    kept_hash = []
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        kept_hash.append(hashlib.sha256(_joined(data, starts[a:b], ends[a:b], gone[a:b])).hexdigest())
    counts = np.diff(first)
    removed = np.diff(np.r_[0, np.cumsum(gone)][first])
    return {
        "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array(kept_hash, pa.string()),
    }


def _joined(data, starts, ends, gone) -> bytes:
    """The kept words with one space between them."""
    s, e = starts[~gone], ends[~gone]
    if not len(s):
        return b""
    origin = s[0]
    step = np.zeros(e[-1] - origin + 2, np.int8)
    step[s - origin] += 1
    step[e + 1 - origin] -= 1  # each word takes the byte after it along
    kept = data[origin : e[-1]][np.cumsum(step[:-2], dtype=np.int8) > 0]
    kept[np.cumsum(e - s + 1)[:-1] - 1] = 32
    return kept.tobytes()


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with ``text`` left without the words of repeated windows (kept words joined by
    one space; texts that lose nothing stay as they are), plus ``n_words`` and ``n_removed``."""

    left = unused(docs.columns, "left_text")

    def render(data, starts, ends, first, gone):
        counts, removed = np.diff(first), np.diff(np.r_[0, np.cumsum(gone)][first])
        kept = [
            _joined(data, starts[a:b], ends[a:b], gone[a:b]).decode() if n else None
            for a, b, n in zip(first[:-1], first[1:], removed, strict=True)
        ]
        return {
            "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            left: pa.array(kept, pa.string()),
        }

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(left, T.StringType())]
    found = repeats(docs, text, window, render, fields)
    return found.withColumn(text, F.coalesce(left, text)).drop(left)


def repeat_digests(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents' columns, ``n_words``, ``n_removed``, and ``kept_sha256`` of the kept words."""
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
    return repeats(docs, text, window, _digests, fields)
