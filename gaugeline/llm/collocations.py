"""Phrase collocations by direct-address tiling.

Words are numbered by falling frequency, so that common ones have low numbers.  The table of all pairs of
neighbours is cut into square tiles.  A tile with many pairs is counted as a dense array addressed by the
two numbers (numpy ``bincount``), one with few as sorted coordinates with counts; both are bounded by the
size of a tile.  Pairs that are frequent enough are numbered by falling frequency in their turn, and a
phrase of three words is a pair of two such pairs that overlap, and so on up to ``longest`` words.

How it runs: documents are cut into words once and written as chunks of some megabytes of text: the words
of a chunk, and its texts as numbers of these.  A chunk counts its tiles, and equal tiles of up to 256
chunks (then of 256 such groups, and so on) are added up in one task, so that the hottest tile is no hot
task.  Numbers of frequent words and pairs go back to the chunks.  Up to ``HELD`` of them they are broadcast;
more take an exchange of packed pairs dealt by hash, in which the frequent pairs come first in a bucket and
the distinct pairs of chunk after chunk stream past them.

All counts are of one language.  A phrase of k words is the pair of its first and its last k - 1 words, so
the counts of all its parts come from joins of numbers, level by level.

Corner cases: a null text is empty, a null language is ``und``; repeated rows count each; an empty table
gives no phrases; only the text and language columns are read, whatever others there are.  Numbers are
below 2**32 - 1: more frequent phrases of one length raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm import chunks as C
from gaugeline.llm.links import stored
from gaugeline.llm.words import distinct_spans, mix, text_bytes
from gaugeline.sources.tables import bucketed

LONGEST, MIN_COUNT, TOP, ABSORBED = 5, 100, 2000, 100
CHUNK_BYTES = 4 << 20
#: Numbers on a side of a tile.
TILE = 2048
#: Equal tiles added up in one task.
FAN_IN = 256
#: Frequent words, or pairs of one length, that are broadcast: at 12 bytes a pair, 24 MB.
HELD = 2_000_000
#: Frequent pairs of a bucket of the exchange.
BUCKET_PAIRS = 1 << 20
_SALT = 32

_KINDS = np.zeros(256, np.uint8)
_KINDS[[32, 9]] = 1
_KINDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_TILES = "a_tile bigint, b_tile bigint, part bigint, codes binary, counts binary"
_PAIRS = "bucket bigint, chunk bigint, codes binary, ids binary"


# --- words -----------------------------------------------------------------------------------


def tokens(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """The texts on end as numbers of their words from 1, 0 between pieces; the language and the word of
    each number, and how often it stands."""
    import pandas as pd

    data, offsets = text_bytes(texts)
    kind = _KINDS[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    first[inner] |= inside[1:-1][inner]
    last[inner - 1] |= inside[1:-1][inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
    codes, listed = distinct_spans(_LOWER[data], starts, ends)
    of = langs.dictionary_encode()
    named = of.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64) * max(1, len(listed)) + codes
    numbers, values = pd.factorize(named)
    line = np.zeros(len(numbers) + int(fresh.sum()), np.uint32)
    line[np.arange(len(numbers)) + np.cumsum(fresh)] = numbers + 1
    words = pa.array(listed, pa.binary()).cast(pa.string()).take(pa.array(values % max(1, len(listed))))
    return line, of.dictionary.take(pa.array(values // max(1, len(listed)))), words, np.bincount(numbers, minlength=len(values))


_WORDS = "chunk bigint, rows array<struct<ids: binary, langs: array<string>, words: array<string>, counts: array<bigint>>>"


def _cut_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """Chunks of ``(lang, text)`` as words, stored, and the number of buckets."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(C.MOST_BUCKETS, max(1 + total // (2 * CHUNK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def pack(batches):
        part, n = TaskContext.get().partitionId() << 32, 0
        held, weight = [], 0

        def flush():
            texts, langs = (pa.concat_arrays([b.column(c) for b in held]) for c in ("text", "lang"))
            line, *fields, counts = tokens(texts, langs)
            lists = [pa.ListArray.from_arrays([0, len(f)], f) for f in (*fields, pa.array(counts, pa.int64()))]
            row = pa.StructArray.from_arrays([pa.array([line.tobytes()], pa.binary()), *lists], names=["ids", "langs", "words", "counts"])
            return pa.RecordBatch.from_arrays([pa.array([part + n], pa.int64()), pa.ListArray.from_arrays([0, 1], row)], names=["chunk", "rows"])

        for batch in batches:
            places, at = C.text_places(batch.column("text")), 0
            while at < batch.num_rows:
                to = int(np.searchsorted(places, places[at] + CHUNK_BYTES - weight, "right")) - 1
                to = min(batch.num_rows, max(to, at + (not held)))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    weight += int(places[to] - places[at])
                    at = to
                if at < batch.num_rows:
                    yield flush()
                    held, weight, n = [], 0, n + 1
        if held:
            yield flush()

    return _bucketed(docs.mapInArrow(pack, _WORDS), buckets), buckets


def _number_words(chunk, docs, found):
    """The ranks of the words of a chunk, one more than the rank, 0 for rare words and between pieces."""
    line = np.frombuffer(docs.field("ids")[0].as_py(), np.uint32)
    ids = np.zeros(len(docs.field("words")[0].values) + 1, np.uint32)
    for x in found:
        ids[np.cumsum(_from_planes(x["numbers"], 4))] = _from_planes(x["ids"], 4) + 1
    yield _sequence(chunk, ids[line])


_PLACES = "lang string, word string, n bigint, chunks array<bigint>, numbers array<bigint>"


def _places(batches):
    """``(chunk, number, lang, word, n)`` in order of the words to one row per word and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        named = [batch.column("lang"), batch.column("word")]
        fresh = np.ones(batch.num_rows, bool)
        fresh[1:] = np.logical_or(*(pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False) for x in named))
        first = np.flatnonzero(fresh)
        ends = pa.array(np.append(first, batch.num_rows), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("chunk", "number")]
        n = np.add.reduceat(batch.column("n").to_numpy(), first)
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays([*(x.take(at) for x in named), pa.array(n), *lists], names=["lang", "word", "n", "chunks", "numbers"])


def _packed(batches):
    """``(chunks, numbers, id)`` to one row per chunk and batch."""
    for batch in batches:
        chunk, number = (batch.column(c).flatten().to_numpy() for c in ("chunks", "numbers"))
        ids = np.repeat(batch.column("id").to_numpy(), pc.list_value_length(batch.column("chunks")).to_numpy())
        order = np.lexsort((number, chunk))
        cut = np.flatnonzero(np.r_[True, np.diff(chunk[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
        spans = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk[s[0]] for s in spans], pa.int64()), pa.array([_planes(np.diff(number[s], prepend=0), 4) for s in spans], pa.binary()),
                pa.array([_planes(ids[s], 4) for s in spans], pa.binary()),
            ],
            names=["chunk", "numbers", "ids"],
        )


def _sequence(chunk: int, line: np.ndarray) -> pa.RecordBatch:
    rows = pa.StructArray.from_arrays([pa.array([line.tobytes()], pa.binary())], names=["ids"])
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.ListArray.from_arrays([0, 1], rows)], names=["chunk", "rows"])


_SEQUENCE = "chunk bigint, rows array<struct<ids: binary>>"


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with their rank from 0 as ``id``, stored; the driver sees one number per partition."""
    placed = stored(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("place", 33)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) >= (1 << 32) - 1:
        raise ValueError("more frequent phrases of one length than numbers")
    before, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    begin = F.element_at(F.lit(offsets or [0]).cast("array<bigint>"), (part + 1).cast("int"))
    return placed.withColumn("id", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + begin).drop("place")


# --- tiles -----------------------------------------------------------------------------------


def _neighbours(docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all pairs of neighbours in a chunk, and their places."""
    line = np.frombuffer(docs.field("ids")[0].as_py(), np.uint32)
    at = np.flatnonzero((line[:-1] > 0) & (line[1:] > 0))
    return line[at].astype(np.int64) - 1, line[at + 1].astype(np.int64) - 1, at


def tile_counts(a: np.ndarray, b: np.ndarray, side: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(a tile, b tile, places in the tile, counts)`` of pairs, places in order."""
    import pandas as pd

    a_tile, a_tiles = pd.factorize(a // side)
    b_tile, b_tiles = pd.factorize(b // side)
    tile, local = a_tile * max(1, len(b_tiles)) + b_tile, (a % side) * side + b % side
    order = np.argsort(tile, kind="stable")
    tile, local = tile[order], local[order]
    cut = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]) if len(tile) else np.zeros(1, np.int64)
    out = []
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        codes, counts = _added([local[x:y]], [np.ones(y - x, np.int64)], side)
        out.append((int(a_tiles[tile[x] // len(b_tiles)]), int(b_tiles[tile[x] % len(b_tiles)]), codes, counts))
    return out


def _added(codes: list[np.ndarray], counts: list[np.ndarray], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal places added up: by address where a tile is dense, else by sorted coordinates."""
    code, count = np.concatenate(codes), np.concatenate(counts)
    if 8 * len(code) >= side * side:
        dense = np.bincount(code, weights=count, minlength=0)  # sums are whole numbers, exact below 2**53
        code = np.flatnonzero(dense)
        return code, dense[code].astype(np.int64)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    fresh = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[fresh], np.add.reduceat(count, fresh)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Whole numbers by byte: first all lowest bytes, and so on.  The upper ones are mostly 0 and shuffle as little."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def _tile_rows(rows: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
            pa.array([_planes(np.diff(r[3], prepend=0), 4) for r in rows], pa.binary()), pa.array([_planes(r[4], 8) for r in rows], pa.binary()),
        ],
        names=["a_tile", "b_tile", "part", "codes", "counts"],
    )


def _merge(tiles: DataFrame, parts: int, side: int, least: int | None) -> DataFrame:
    """Tiles of equal place and part (modulo ``parts``) added up; with ``least``, as ``(a, b, n)`` instead, rows
    with smaller counts left out.  Only one tile is held at a time."""
    keys = ["a_tile", "b_tile", "part"]
    dealt = tiles.withColumn("part", F.pmod("part", F.lit(parts))).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        key, codes, counts, held = None, [], [], 0

        def done():
            code, count = _added(codes, counts, side)
            if least is None:
                return _tile_rows([(*key, code, count)])
            code, count = code[count >= least], count[count >= least]
            a, b = key[0] * side + code // side, key[1] * side + code % side
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, count)], names=["a", "b", "n"])

        for batch in batches:
            named = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for row, place in enumerate(named):
                if place != key:
                    if key is not None:
                        yield done()
                    key, codes, counts, held = place, [], [], 0
                codes.append(np.cumsum(_from_planes(batch.column("codes")[row].as_py(), 4)))
                counts.append(_from_planes(batch.column("counts")[row].as_py(), 8))
                held += len(codes[-1])
                if held > side * side:
                    merged = _added(codes, counts, side)
                    codes, counts, held = [merged[0]], [merged[1]], 0
        if key is not None:
            yield done()

    return dealt.mapInArrow(run, _TILES if least is None else "a bigint, b bigint, n bigint")


def _frequent_pairs(lines: DataFrame, n_chunks: int, min_count: int, side: int) -> DataFrame:
    """``(id, a, b, n)``: pairs of neighbours found ``min_count`` times, numbered by falling frequency."""

    def count(chunk, docs, _):
        a, b, _ = _neighbours(docs)
        rows = [(x, y, chunk, codes, counts) for x, y, codes, counts in tile_counts(a, b, side)]
        for at in range(0, len(rows), 256):
            yield _tile_rows(rows[at : at + 256])

    tiles, parts = C.each_chunk(lines, None, count, _TILES), n_chunks
    # chunk numbers are spread over the parts by hash
    tiles = tiles.withColumn("part", F.xxhash64("part"))
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        tiles = _merge(tiles, parts, side, None)
    return _ranked(_merge(tiles, 1, side, min_count), F.desc("n"), F.asc("a"), F.asc("b"))


# --- numbers back to chunks ------------------------------------------------------------------


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(code) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(code: np.ndarray, chunk: int, buckets: int, ids: np.ndarray | None) -> pa.RecordBatch:
    """One row per bucket; codes are distinct and sorted, and so they are in each row."""
    bucket = _bucket(code, buckets)
    by = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cut)).tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int64()), pa.array([chunk] * len(used), pa.int64()),
            pa.array([code[by[cut[i] : cut[i + 1]]].tobytes() for i in used], pa.binary()),
            pa.array([None if ids is None else ids[by[cut[i] : cut[i + 1]]].astype(np.uint32).tobytes() for i in used], pa.binary()),
        ],
        names=["bucket", "chunk", "codes", "ids"],
    )


def _next_lines(lines: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    """For each chunk, the numbers of the frequent phrases that begin at each place."""
    spark = lines.sparkSession

    def filled(chunk, docs, known, ids):
        a, b, at = _neighbours(docs)
        line = np.zeros(len(docs.field("ids")[0].as_buffer()) // 4, np.uint32)
        code = _code(a, b)
        hit = C.among(code, known)
        line[at[hit]] = ids[np.searchsorted(known, code[hit])] + np.uint32(1)
        yield _sequence(chunk, line)

    n = pairs.count()
    if n <= HELD:
        held = pairs.select("a", "b", "id").toArrow()
        code, number = _code(held.column("a").to_numpy(), held.column("b").to_numpy()), held.column("id").to_numpy().astype(np.uint32)
        order = np.argsort(code)
        shipped = spark.sparkContext.broadcast((code[order], number[order]))
        return _bucketed(C.each_chunk(lines, None, lambda chunk, docs, _: filled(chunk, docs, *shipped.value), _SEQUENCE), buckets)

    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // BUCKET_PAIRS)

    def ask(chunk, docs, _):
        a, b, _ = _neighbours(docs)
        yield _by_bucket(np.unique(_code(a, b)), chunk, deal, None)

    def pack(batches):
        for batch in batches:
            a, b, ids = (batch.column(c).to_numpy() for c in ("a", "b", "id"))
            code = _code(a, b)
            order = np.argsort(code)
            yield _by_bucket(code[order], -1, deal, ids[order])

    def answer(batches):
        bucket, parts, known, ids, settled = None, [], None, None, False
        for batch in batches:
            where, chunk = (batch.column(c).to_pylist() for c in ("bucket", "chunk"))
            rows = []
            for i, (w, c) in enumerate(zip(where, chunk, strict=True)):
                if w != bucket:
                    bucket, parts, settled = w, [], False
                code = np.frombuffer(batch.column("codes")[i].as_py(), np.uint64)
                if c < 0:
                    parts.append((code, np.frombuffer(batch.column("ids")[i].as_py(), np.uint32)))
                    continue
                if not settled:
                    known = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
                    ids = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.uint32)
                    order = np.argsort(known)
                    known, ids, settled = known[order], ids[order], True
                hit = C.among(code, known)
                if hit.any():
                    code = code[hit]
                    rows.append((c, code.tobytes(), ids[np.searchsorted(known, code)].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["chunk", "codes", "ids"],
                )

    def fill(chunk, docs, found):
        known = np.concatenate([np.frombuffer(x["codes"], np.uint64) for x in found] or [np.zeros(0, np.uint64)])
        ids = np.concatenate([np.frombuffer(x["ids"], np.uint32) for x in found] or [np.zeros(0, np.uint32)])
        order = np.argsort(known)
        yield from filled(chunk, docs, known[order], ids[order])

    asked = C.each_chunk(lines, None, ask, _PAIRS).union(pairs.select("a", "b", "id").mapInArrow(pack, _PAIRS))
    # the frequent pairs, of chunk -1, come first in their bucket
    dealt = asked.repartition(deal, "bucket").sortWithinPartitions("bucket", "chunk")
    answers = dealt.mapInArrow(answer, "chunk bigint, codes binary, ids binary").groupBy("chunk").agg(F.collect_list(F.struct("codes", "ids")).alias("found"))
    return _bucketed(C.each_chunk(lines, answers, fill, _SEQUENCE), buckets)


def _bucketed(lines: DataFrame, buckets: int) -> DataFrame:
    return bucketed(lines, "chunk", buckets, "phrases")


# --- phrases ---------------------------------------------------------------------------------


def phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT,
    absorbed: int = ABSORBED, tile: int = TILE,
) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)``: phrases of 2 to ``longest`` words found ``min_count`` times, with the
    counts of the two parts of their lowest-scoring cut and of all words.  Phrases inside a longer one that
    is found ``absorbed`` percent as often are left out."""
    if longest < 2 or min_count < 1:
        raise ValueError("phrases have at least two words and are found at least once")
    narrow = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    chunks, buckets = _cut_words(narrow)
    n_chunks = max(1, chunks.count())
    row = F.element_at("rows", 1)
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip(row["langs"].alias("lang"), row["words"].alias("word"), row["counts"].alias("n"))).alias("place", "w"))
    listed = listed.select("chunk", (F.col("place") + 1).cast("bigint").alias("number"), "w.lang", "w.word", "w.n")
    # the chunks of a word travel together: what is joined by words has a row per word, not one per chunk and word
    dealt = listed.repartition("lang", "word").sortWithinPartitions("lang", "word")
    places = stored(dealt.mapInArrow(_places, _PLACES), "word-places")
    counts = places.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = places.groupBy("lang").agg(F.sum("n").alias("total"))
    vocabulary = _ranked(counts.where(F.col("n") >= min_count), F.desc("n"), F.asc("lang"), F.asc("word"))
    known = vocabulary.select("lang", "word", "id")
    known = F.broadcast(known) if known.count() <= HELD // 4 else known.hint("merge")
    named = places.join(known, ["lang", "word"]).select("chunks", "numbers", "id").mapInArrow(_packed, "chunk bigint, numbers binary, ids binary")
    named = named.groupBy("chunk").agg(F.collect_list(F.struct("numbers", "ids")).alias("found"))
    lines = _bucketed(C.each_chunk(chunks, named, _number_words, _SEQUENCE), buckets)

    none = F.array().cast("array<bigint>")
    level = vocabulary.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("heads"), none.alias("tails"))
    levels, found = [], []
    for k in range(2, longest + 1):
        pairs = _frequent_pairs(lines, n_chunks, min_count, tile)
        a, b = level.alias("a"), level.alias("b")
        level = stored(
            pairs.alias("p").join(a.hint("merge"), F.col("p.a") == F.col("a.id")).join(b.hint("merge"), F.col("p.b") == F.col("b.id")).select(
                "p.id", "a.lang", F.concat_ws(" ", "a.phrase", "b.last").alias("phrase"), "b.last", "p.n",
                F.concat("a.heads", F.array("a.n")).alias("heads"), F.concat(F.array("b.n"), "b.tails").alias("tails"),
            ),
            "phrases",
        )
        levels.append(level)
        found.append(pairs)
        if k < longest:
            lines = _next_lines(lines, pairs, buckets)
    kept = None
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            longer = found[k + 1]
            ends = longer.select(F.col("a").alias("id"), "n").union(longer.select("b", "n"))
            around = ends.groupBy("id").agg(F.max("n").alias("around"))
            level = level.join(around.hint("merge"), "id", "left").where(
                F.coalesce(100 * F.col("around") < absorbed * F.col("n"), F.lit(True))
            ).drop("around")
        kept = level if kept is None else kept.union(level)
    scored = kept.join(totals, "lang").withColumn("cut", _lowest_cut())
    return scored.select(
        "lang", "phrase", F.col("n").alias("a"), F.element_at("heads", F.col("cut.k")).alias("l"), F.element_at("tails", F.col("cut.k")).alias("r"),
        F.col("total").alias("n"), "cut.score",
    )


def _lowest_cut() -> Column:
    """The least ``(score, k)`` over the cuts after k words; decimals of 38 digits hold the products."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = wide(F.col("n"), 17) * wide(F.col("total"), 16) * wide(F.lit(1000), 4)

    def score(k):
        below = wide(F.element_at("heads", k), 17) * wide(F.element_at("tails", k), 17)
        return F.struct(F.call_function("div", above, below).alias("score"), k.alias("k"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("heads")), score))


def top_phrases(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The ``top`` phrases of each language by score, count and bytes, with their ``rank``."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = phrases(docs, **options).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALT)))
    # the best of each share first, so that no task ranks all phrases of a language
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
