"""Words of a text: maximal runs of characters other than space, tab, line feed, vertical tab, form
feed and carriage return.  As Spark columns, and as arrays over Arrow text inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"

# odd numbers that set the hashes apart; any would do
_STEP, _LEFT, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: Longer spans are hashed one by one.
_ARRAY_BYTES = 64


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- arrays ----------------------------------------------------------------------------------


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the ``len + 1`` places where they begin.  Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64, len(texts) + 1, texts.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.

    Spans of up to 64 bytes take in 8 bytes a step, all spans at once, and every step mixes what came
    before; longer ones have a blake2b digest.  No sum of terms by place: such sums have spans
    that agree for every base.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _SIZE)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at, done = np.flatnonzero((size > 0) & (size <= _ARRAY_BYTES)), 0
    while len(at):
        left = size[at] - done
        taken = wide[starts[at] + done]
        short = left < 8
        taken[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[at] = mix((out[at] ^ taken) + _STEP)
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > _ARRAY_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def distinct(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct pieces between neighbouring edges, compared byte by byte, and the number of each
    piece among them."""
    places, held = (pa.py_buffer(np.ascontiguousarray(x)) for x in (edges.astype(np.int64), data))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, places, held]).dictionary_encode()
    _, places, held = found.dictionary.buffers()
    if held is None:
        return found.indices.to_numpy(), [b""] * len(found.dictionary)
    at, raw = np.frombuffer(places, np.int64, len(found.dictionary) + 1).tolist(), held.to_pybytes()
    return found.indices.to_numpy(), [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The same for spans in order that don't overlap; what is between them is listed, too, but not numbered."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    edges = np.empty(2 * len(starts), np.int64)
    edges[::2], edges[1::2] = starts, ends
    codes, listed = distinct(data, edges)
    return codes[::2], listed


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the number of the first word of each text (and of the end)."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = np.empty(len(data), bool)
    last = np.empty(len(data), bool)
    if len(data):
        first[0], last[-1] = True, True
        first[1:] = ~inside[:-1]
        last[:-1] = ~inside[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] = True
        last[inner - 1] = True
        first &= inside
        last &= inside
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the lines of each text, split at line feeds as ``split`` does, and the
    number of the first line of each text.  An empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets)
    n = len(offsets) - 1
    first = before + np.arange(n + 1)
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    owner = np.repeat(np.arange(n), np.diff(before))
    after = breaks + 1
    starts[first[:-1]] = offsets[:-1]
    starts[np.arange(len(breaks)) + owner + 1] = after
    ends[first[1:] - 1] = offsets[1:]
    ends[np.arange(len(breaks)) + owner] = breaks
    return starts, ends, first


def gram_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive items within each text, and where each begins."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fits = np.ones(n - k + 1, bool)
    cut = first[1:-1]
    for back in range(1, k):
        at = cut - back
        fits[at[(at >= 0) & (at < len(fits))]] = False
    at = np.flatnonzero(fits)
    return run_hashes(hashes, at, at + k), at


def run_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of items from ``begin`` to before ``end``: a run is cut into pieces whose lengths are
    the powers of two in its length, and pieces are hashed from their halves."""
    size = end - begin
    out, at = mix(size.astype(np.uint64) * _SIZE), begin.copy()
    table, level = hashes, 0
    while len(size) and int(size.max()) >> level:
        has = np.flatnonzero(size >> level & 1)
        out[has] = mix(out[has] * _LEFT + table[at[has]])
        at[has] += 1 << level
        table = mix(table[: -(1 << level)] * _LEFT + table[1 << level :])
        level += 1
    return out


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a run of ``k`` beginning at one of ``at`` (distinct places)."""
    step = np.zeros(n + 1, np.int64)
    step[at] += 1
    step[at + k] -= 1
    return np.cumsum(step[:-1]) > 0
