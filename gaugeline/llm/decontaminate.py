"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words: A-Z are lower-cased, and a word is a maximal run of characters other than
the ASCII characters that are neither digits nor letters.  The patterns are the windows of an item, its runs of
``window`` consecutive words, or all its words if it has fewer.  Every word of the patterns has a
symbol, other words share one that no pattern has, so a text becomes a string of symbols which the
automaton reads once, whatever the number of patterns.  A word inside an occurrence is hit; runs of
hit words are mapped back to places in the original text.

An automaton holds at most ``part_windows`` pairs of window and item, which bounds what is sent to the
executors, its nodes and its symbols.  A benchmark with more pairs is dealt by hash into as many automata
as it needs; documents are then written as chunks once, each automaton reads them in tasks of its own,
and what it finds joins the chunk it was found in.

Corner cases: a null or empty text has no words, and such an item no window; items of equal id are one item,
items without an id are one item with an empty name; repeated documents are judged each; an empty
benchmark hits nothing, an empty table gives an empty table; all columns pass through, and ``n_words``,
``n_hit``, ``hits`` and ``items`` replace input columns of the same name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm import chunks as C
from gaugeline.llm.columns import beside
from gaugeline.llm.links import stored
from gaugeline.llm.words import distinct_spans, text_bytes

WINDOW = 10
PART_WINDOWS = 100_000
#: Words of a part, each of which has a code point as its symbol.
_SYMBOLS = 1_100_000
#: Texts are taken in groups of about so many bytes, to bound the arrays.
GROUP_BYTES = 1 << 21

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FIELDS = {
    "n_words": T.LongType(), "n_hit": T.LongType(),
    "hits": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
    "items": T.ArrayType(T.StringType()),
}
_FOUND = "chunk bigint, place array<int>, begin array<bigint>, end array<bigint>, items array<string>, item_place array<int>"


def item_words(text: Column) -> Column:
    """Normalised words of a text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK), lambda w: w != "")


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """``(phrase, item)``: the windows of every item, words joined by a space."""
    cut = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), item_words(F.col(text)).alias("ws")).where("size(ws) > 0")
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1))
    placed = cut.select("item", "ws", F.explode(begins).alias("i"))
    return placed.select(F.array_join(F.slice("ws", F.col("i"), F.lit(window)), " ").alias("phrase"), "item").distinct()


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    keep = np.zeros(256, bool)
    keep[128:] = True
    for a, b in ("09", "AZ", "az"):
        keep[ord(a) : ord(b) + 1] = True
    table[~keep] = 32
    table[ord("A") : ord("Z") + 1] += 32
    return table


_NORMAL = _table()


def normal_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, byte starts and ends of the words, and the first word of each text (and of the end)."""
    normal = _NORMAL[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = normal != 32
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    first[inner] |= inside[1:-1][inner]
    last[inner - 1] |= inside[1:-1][inner - 1]
    starts = np.flatnonzero(first)
    return normal, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class Automaton:
    """Patterns of words; ``found`` gives the first word, the end and the number of each occurrence."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        split = [p.encode().split(b" ") for p in phrases]
        self.symbols: dict[bytes, int] = {}
        for p in split:
            for w in p:
                n = len(self.symbols) + 1
                self.symbols.setdefault(w, n if n < 0xD800 else n + 0x800)  # surrogates are no characters
        self.size = np.array([len(p) for p in split], np.int64)
        self.trie = ahocorasick.Automaton()
        for i, p in enumerate(split):
            self.trie.add_word("".join(chr(self.symbols[w]) for w in p), i)
        if split:
            self.trie.make_automaton()

    def found(self, normal: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        if not len(self.size) or not len(starts):
            return (np.zeros(0, np.int64),) * 3
        codes, listed = distinct_spans(normal, starts, ends)
        known = np.fromiter((self.symbols.get(w, 0) for w in listed), np.uint32, len(listed))
        # a text begins behind a symbol of no pattern
        at = np.arange(len(codes)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
        line = np.zeros(len(codes) + len(first), "<u4")
        line[at] = known[codes]
        hits = list(self.trie.iter(line.tobytes().decode("utf-32-le")))
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        last, number = np.array(hits, np.int64).T
        end = np.searchsorted(at, last) + 1
        return end - self.size[number], end, number


_held: dict[str, tuple] = {}


def _automaton(name: str, shipped) -> tuple:
    """The automaton of a worker, made once: ``(automaton, items of each phrase on end, where they begin)``."""
    if name not in _held:
        _held.clear()
        phrases, owners, begin = shipped.value
        _held[name] = Automaton(phrases), owners, begin
    return _held[name]


def _scan(texts: pa.Array, automaton: Automaton, owners: list[str], begin: list[int]):
    """``place, begin, end, item place, item``: runs of hit words of each text (counted in the text), and its items."""
    data, offsets = text_bytes(texts)
    runs, named = [], []
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        part = offsets[at : to + 1] - offsets[at]
        normal, starts, ends, first = normal_spans(data[offsets[at] : offsets[to]], part)
        a, b, number = automaton.found(normal, starts, ends, first)
        if len(a):
            of = np.searchsorted(first, a, "right") - 1
            a, b = merged(a, b, first[of])
            owner = np.searchsorted(first, a, "right") - 1
            runs.append(np.c_[owner + at, a - first[owner], b - first[owner]])
            pairs = np.unique(np.c_[of, number], axis=0)
            cut = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0], True])
            known: dict[bytes, list[str]] = {}  # texts that hold the same phrases share their items
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                key = pairs[x:y, 1].tobytes()
                if key not in known:
                    known[key] = sorted({i for n in pairs[x:y, 1].tolist() for i in owners[begin[n] : begin[n + 1]]})
                named.append((int(pairs[x, 0]) + at, known[key]))
        at = to
    return np.concatenate(runs) if runs else np.zeros((0, 3), np.int64), named


def merged(begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that touch or overlap, joined; runs of different texts (told by their first word) stay apart."""
    order = np.argsort(begin, kind="stable")
    begin, end, text = begin[order], end[order], text[order]
    reach = np.maximum.accumulate(end)
    fresh = np.flatnonzero(np.r_[True, (begin[1:] > reach[:-1]) | (text[1:] != text[:-1])])
    return begin[fresh], np.maximum.reduceat(end, fresh)


def _render(texts: pa.Array, runs: np.ndarray, items: list[list[str]]) -> list[pa.Array]:
    """The result columns; runs are ``(text, begin, end)`` in words, in order."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    _, starts, ends, first = normal_spans(data, offsets)
    lead = np.cumsum(np.r_[0, (data & 0xC0) != 0x80])  # characters before a byte
    of = runs[:, 0]
    a, b = starts[first[of] + runs[:, 1]], ends[first[of] + runs[:, 2] - 1]
    origin = lead[offsets[of]]
    hits = pa.StructArray.from_arrays([pa.array(lead[a] - origin, pa.int64()), pa.array(lead[b] - origin, pa.int64())], names=["start", "end"])
    hit = np.bincount(of, weights=runs[:, 2] - runs[:, 1], minlength=n).astype(np.int64)
    places = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
    return [pa.array(np.diff(first), pa.int64()), pa.array(hit, pa.int64()), pa.ListArray.from_arrays(places, hits), pa.array(items, pa.list_(pa.string()))]


def find(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, part_windows: int = PART_WINDOWS,
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit`` (words inside occurrences), ``hits`` (runs of hit words: start
    and end in characters of the text, end exclusive) and ``items`` (ids of the items found, sorted)."""
    if window < 1:
        raise ValueError("a window has at least one word")
    part_windows = max(1, min(part_windows, _SYMBOLS // window))
    spark = docs.sparkSession
    windows = stored(item_windows(items, item_key, item_text, window), "windows")
    parts = max(1, -(-windows.count() // part_windows))
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("phrase", "item"), F.lit(parts)))
    shipped = []
    for p in range(parts):
        held = dealt.where(F.col("part") == p).groupBy("phrase").agg(F.collect_list("item").alias("items")).toArrow()
        owners = held.column("items").combine_chunks()
        begin = owners.offsets.to_pylist() if len(owners) else [0]
        value = held.column("phrase").to_pylist(), owners.values.to_pylist() if len(owners) else [], begin
        shipped.append((uuid.uuid4().hex, spark.sparkContext.broadcast(value)))

    columns = beside(docs.columns, _FIELDS)
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(n, t) for n, t in _FIELDS.items()])
    names = columns + list(_FIELDS)

    def whole(batches):
        for batch in batches:
            texts = batch.column(text)
            runs, named = _scan(texts, *_automaton(*shipped[0]))
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for place, found in named:
                items[place] = found
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + _render(texts, runs, items), names=names)

    if parts == 1:
        return docs.mapInArrow(whole, schema)

    def one_part(ship):
        def run(chunk, rows, _):
            runs, named = _scan(rows.field(text), *_automaton(*ship))
            if len(runs):
                flat = [i for _, found in named for i in found]
                places = [place for place, found in named for _ in found]
                yield pa.RecordBatch.from_pylist(
                    [dict(chunk=chunk, place=runs[:, 0].tolist(), begin=runs[:, 1].tolist(), end=runs[:, 2].tolist(), items=flat, item_place=places)],
                    schema=pa.schema([
                        ("chunk", pa.int64()), ("place", pa.list_(pa.int32())), ("begin", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())),
                        ("items", pa.list_(pa.string())), ("item_place", pa.list_(pa.int32())),
                    ]),
                )

        return run

    def finish(chunk, rows, found):
        texts = rows.field(text)
        items: list[set[str]] = [set() for _ in range(len(rows))]
        runs = [np.c_[x["place"], x["begin"], x["end"]] for x in found]
        for x in found:
            for place, item in zip(x["item_place"], x["items"], strict=True):
                items[place].add(item)
        all_runs = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        if len(all_runs):
            # places of words in the chunk, so that runs of all texts merge at once
            wide = int(all_runs[:, 2].max()) + 1
            a, b = merged(all_runs[:, 0] * wide + all_runs[:, 1], all_runs[:, 0] * wide + all_runs[:, 2], all_runs[:, 0])
            all_runs = np.c_[a // wide, a % wide, b - a // wide * wide]
        yield pa.RecordBatch.from_arrays([rows.field(c) for c in columns] + _render(texts, all_runs, [sorted(x) for x in items]), names=names)

    chunks, _ = C.write_chunks(docs, text)
    parts_found = [C.each_chunk(chunks, None, one_part(s), _FOUND) for s in shipped]
    found = parts_found[0]
    for other in parts_found[1:]:
        found = found.union(other)
    found = stored(found, "occurrences").groupBy("chunk").agg(F.collect_list(F.struct("place", "begin", "end", "items", "item_place")).alias("found"))
    return C.each_chunk(chunks, found, finish, schema)


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item occurs."""
    return find(docs, items, **options).where("n_hit = 0").select(*docs.columns)
