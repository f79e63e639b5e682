"""Line de-duplication by winnowing over line hashes.

A window is the shortest run of lines, from one line on or up to one line, that holds at least
``min_words`` words.  Winnowing keeps one fingerprint of each window: its least line hash, the last of
equals.  Equal windows keep equal fingerprints, so every repeated run of ``min_words`` words shares one.
Fingerprints meet in a packed exchange (``chunks``); the windows around repeated ones meet in a second
exchange, which tells whether an equal window stands at an earlier place.  A line is deleted if any such
later window covers it: windows begin and end at every line of a repeated run, so a match extends line by
line both ways as far as the run repeats.

Places are ordered by id (null last), then by position; rows of equal id by their place in the input.
Runs are judged on the input.  Lines are split at line feeds and compared byte for byte, white space
included.

Corner cases: a null text stays null, an empty one stays empty; a text with fewer than ``min_words``
words stays as it is; of identical texts with so many the first stays whole and the others are left empty; an
empty table gives an empty table; all columns pass through, and ``n_lines`` and ``n_deleted`` replace
input columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm import chunks as C
from gaugeline.llm.columns import beside, unused
from gaugeline.llm.words import line_spans, run_hashes, span_hashes, text_bytes, word_spans

MIN_WORDS = 8
_FINGER_WIDTH, _WINDOW_WIDTH = 5, 8
_LAST = np.iinfo(np.int64).max


def _lines(docs: pa.StructArray, text: str):
    """Bytes, line spans, first line of each text, line hashes, words before each line."""
    data, offsets = text_bytes(docs.field(text))
    starts, ends, first = line_spans(data, offsets)
    words, *_ = word_spans(data, offsets)
    before = np.searchsorted(words, np.r_[starts, len(data)])
    return data, starts, ends, first, span_hashes(data, starts, ends), before


def _windows(first: np.ndarray, before: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the windows, each once."""
    n = len(before) - 1
    begin = np.arange(n)
    end = np.searchsorted(before, before[:-1] + min_words, "left")
    last = np.repeat(first[1:], np.diff(first))
    fits = end <= last
    back = np.searchsorted(before, before[1:] - min_words, "right") - 1
    ends_here = back >= np.repeat(first[:-1], np.diff(first))
    # a run may be the shortest one from its begin and to its end
    pairs = np.r_[np.c_[begin[fits], end[fits]], np.c_[back[ends_here], begin[ends_here] + 1]]
    begin, end = np.unique(pairs, axis=0).T
    return begin, end


def _least(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The line with the least hash in each window, the last of equals: minima of two overlapping
    runs whose length is a power of two."""
    place = np.empty(len(begin), np.int64)
    if not len(begin):
        return place
    level = np.frexp((end - begin).astype(np.float64))[1] - 1
    table = np.arange(len(hashes))
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        a, b = table[begin[at]], table[end[at] - (1 << k)]
        place[at] = np.where(hashes[b] <= hashes[a], b, a)
        if len(table) > 1 << k:
            left, right = table[: -(1 << k)], table[1 << k :]
            table = np.where(hashes[right] <= hashes[left], right, left)
    return place


def _ranks(docs: pa.StructArray, order: str, first: np.ndarray) -> np.ndarray:
    ids = docs.field(order).cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)
    return np.repeat(ids, np.diff(first))


def delete_repeats(docs: DataFrame, text: str = "text", order: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later repeated runs, plus ``n_lines`` (of the input) and ``n_deleted``.

    ``order`` names an integer column.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    chunks, buckets = C.write_chunks(docs, text)
    left_text = unused(docs.columns, "left_text")
    new = ["n_lines", "n_deleted", left_text]
    columns = beside(docs.columns, new)

    def probe(chunk, rows, _):
        *_, first, hashes, before = _lines(rows, text)
        picked = np.unique(_least(hashes, *_windows(first, before, min_words)))
        yield C.pack_keys(hashes[picked], chunk, buckets, _FINGER_WIDTH)

    def extend(chunk, rows, found):
        *_, first, hashes, before = _lines(rows, text)
        begin, end = _windows(first, before, min_words)
        prints = hashes[_least(hashes, begin, end)]
        near = C.among(C.short(prints, _FINGER_WIDTH), C.found_keys(found, _FINGER_WIDTH))
        begin, end = begin[near], end[near]
        keys = run_hashes(hashes, begin, end)
        yield C.pack_keys(keys, chunk, buckets, _WINDOW_WIDTH, ranks=_ranks(rows, order, first)[begin])

    def finish(chunk, rows, found):
        data, starts, ends, first, hashes, before = _lines(rows, text)
        begin, end = _windows(first, before, min_words)
        keys = C.short(run_hashes(hashes, begin, end), _WINDOW_WIDTH)
        listed = np.concatenate([C.from_bytes(x["keys"], _WINDOW_WIDTH) for x in found] or [np.zeros(0, np.uint64)])
        later = np.concatenate([np.frombuffer(x["later"], bool) for x in found] or [np.zeros(0, bool)])
        gone_window = C.among(keys, np.sort(listed[later]))
        here = np.flatnonzero(C.among(keys, np.sort(listed[~later])))
        if len(here):  # the first place of all is in this chunk: only what follows it here is later
            by = here[np.lexsort((begin[here], _ranks(rows, order, first)[begin[here]], keys[here]))]
            gone_window[by[1:][keys[by[1:]] == keys[by[:-1]]]] = True
        step = np.zeros(len(starts) + 1, np.int64)
        np.add.at(step, begin[gone_window], 1)
        np.add.at(step, end[gone_window], -1)
        gone = np.cumsum(step[:-1]) > 0
        deleted = np.diff(np.r_[0, np.cumsum(gone)][first])
        left = [
            _joined(data, starts[a:b][~gone[a:b]], ends[a:b][~gone[a:b]]) if n else None
            for a, b, n in zip(first[:-1], first[1:], deleted, strict=True)
        ]
        added = [pa.array(np.diff(first), pa.int64()), pa.array(deleted, pa.int64()), pa.array(left, pa.string())]
        yield pa.RecordBatch.from_arrays([rows.field(c) for c in columns] + added, names=columns + new)

    shared = C.repeated(C.each_chunk(chunks, None, probe, C.PROBES), _FINGER_WIDTH)
    windows = C.repeated(C.each_chunk(chunks, shared, extend, C.PROBES), _WINDOW_WIDTH)
    fields = [T.StructField(n, T.LongType()) for n in new[:2]] + [T.StructField(left_text, T.StringType())]
    done = C.each_chunk(chunks, windows, finish, T.StructType([docs.schema[c] for c in columns] + fields))
    return done.withColumn(text, F.coalesce(left_text, text)).drop(left_text)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    return b"\n".join(data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)).decode()
