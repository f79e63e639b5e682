"""N-gram Jaccard self-join by MinHash banding.

A text is its set of word 5-grams (a text with fewer words is one gram of all its words).  Documents are
written as chunks (``chunks``), so that later steps move findings and not texts.  Texts of equal sets are
one node.  Each node's MinHash signature is cut into bands; the number of bands is chosen
so that a pair at the threshold shares a band with probability ``recall``.  Band hashes are shuffled,
and nodes of a shared band are joined to its least node, which makes groups of possible partners, not
pairs.  The full gram sets of the nodes in such groups are then brought together, once each, and every
pair of a group is verified in blocks: more than the bands ask for, so a link is lost only if its two
texts share no chain of bands.  Verified links become classes by connected components.

Words are runs without space, tab, line feed, vertical tab, form feed and carriage return, compared as
they stand.  Grams are 64-bit hashes, sets are recognised by 128 bits.

Corner cases: null texts and texts without words link with nothing, are classes of their own and are all
kept; equal rows are linked like all copies, and of rows that share the least id of a class, one is kept;
rows without an id take part, a class is named by its least non-null id, null if it has none; an empty
table gives an empty table; ``keep_one`` returns the columns of the documents, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import chunks as C
from gaugeline.llm.links import compare_blocks, components, in_blocks, stored
from gaugeline.llm.words import gram_hashes, mix, run_hashes, span_hashes, text_bytes, word_spans

GRAM, THRESHOLD, ROWS, RECALL = 5, 0.8, 7, 0.998
BLOCK = 512
_SLAB = 1 << 15


def bands_for(threshold: float, rows: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(texts: pa.Array, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of each text, sorted, on end, and where each text begins."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    grams, at = gram_hashes(hashes, first, gram)
    of = np.searchsorted(first, at, "right") - 1
    size = np.diff(first)
    few = np.flatnonzero((size > 0) & (size < gram))
    grams = np.concatenate([grams, run_hashes(hashes, first[few], first[few + 1])])
    of = np.concatenate([of, few])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[fresh], of[fresh]
    return grams, np.searchsorted(of, np.arange(len(texts) + 1))


def band_hashes(grams: np.ndarray, first: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One row of band hashes for each (non-empty) set."""
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.empty((len(first), bands), np.uint64)
    for band in range(bands):
        joined = np.full(len(first), band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            values = (grams ^ shifts[k]) * factors[k]
            values ^= values >> np.uint64(32)
            joined = mix(joined ^ np.minimum.reduceat(values * factors[k], first))
        out[:, band] = joined
    return out


def _sign(gram: int, bands: int, rows: int, seed: int):
    """For a chunk: ``chunk``, ``place`` in it, ``id``, ``gram_set`` (16 bytes that stand for the set, null
    for no words), ``bands``."""

    def run(chunk, docs, _):
        grams, first = gram_sets(docs.field("text"), gram)
        n = len(docs)
        some = np.flatnonzero(np.diff(first))
        keys = band_hashes(grams, first[some], bands, rows, seed) if len(some) else np.zeros((0, bands), np.uint64)
        digest: list[bytes | None] = [None] * n
        for i in some.tolist():
            digest[i] = hashlib.blake2b(grams[first[i] : first[i + 1]].tobytes(), digest_size=16).digest()
        places = np.zeros(n + 1, np.int32)
        places[some + 1] = bands
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, chunk), pa.int64()), pa.array(np.arange(n), pa.int32()), docs.field("id"), pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.cumsum(places), pa.int32()), pa.array(keys.view(np.int64).ravel(), pa.int64())),
            ],
            names=["chunk", "place", "id", "gram_set", "bands"],
        )

    return run


def _sets(gram: int):
    """For a chunk: the gram sets of the documents asked for."""

    def run(chunk, docs, asked):
        if not asked:
            return
        grams, first = gram_sets(docs.field("text").take(pa.array([x["place"] for x in asked])), gram)
        sets = [grams[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
        columns = [pa.array([x[c] for x in asked], pa.int64()) for c in ("group", "node", "weight")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], names=["group", "node", "weight", "grams"])

    return run


def jaccard_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the (sorted, distinct) sets have a Jaccard similarity of at least ``threshold``.

    Intersections are products of membership tables, by slabs of grams; a gram of one set only adds
    to no intersection and is left out.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    grams = np.concatenate(sets)
    of = np.repeat(np.arange(n), size.astype(np.int64))
    order = np.argsort(grams, kind="stable")
    grams, of = grams[order], of[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1
    number, of = number[shared], of[shared]
    common = np.zeros((n, n), np.float32)
    if len(number):
        step = np.ones(len(number), bool)
        step[1:] = number[1:] != number[:-1]
        number = np.cumsum(step) - 1
        for low in range(0, int(number[-1]) + 1, _SLAB):
            a, b = np.searchsorted(number, [low, low + _SLAB])
            table = np.zeros((n, int(number[b - 1]) - low + 1), np.float32)
            table[of[a:b], number[a:b] - low] = 1
            common += table @ table.T
    common = common.astype(np.float64)
    return common >= threshold * (size[:, None] + size[None, :] - common)


def _linked(docs: DataFrame, key: str, text: str, gram: int, threshold: float, rows: int, recall: float, block: int, seed: int):
    """The chunks (with ``id``, ``text`` and all columns as ``row``), and for each document ``chunk``,
    ``place``, ``id``, ``class_id``, ``n_links``, ``kept``."""
    bands = bands_for(threshold, rows, recall)
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.struct(*[c for c in docs.columns if c != text]).alias("row"))
    chunks, _ = C.write_chunks(base, "text")
    kind = docs.schema[key].dataType.simpleString()
    signed = stored(
        C.each_chunk(chunks, None, _sign(gram, bands, rows, seed), f"chunk bigint, place int, id {kind}, gram_set binary, bands array<bigint>"),
        "signatures",
    )
    # sets are numbered as they are written; the numbers are read back, never made anew
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "chunk", "place"))
    nodes = stored(
        signed.where("gram_set is not null").groupBy("gram_set")
        .agg(F.count("*").alias("weight"), first.alias("least"), F.first("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("node"), "gram_set", "weight", "least", "bands"),
        "nodes",
    )
    # members of a band are joined to its least node; a band's hash tells its number, too
    exploded = nodes.select("node", F.explode("bands").alias("band"))
    leads = stored(
        exploded.groupBy("band").agg(F.min("node").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n"), "bands"
    )
    near = exploded.join(leads.hint("merge"), "band").where("node != other").select("node", "other").distinct()
    groups = components(near).withColumnRenamed("component", "group")
    asked = nodes.select("node", "weight", "least.chunk", "least.place").join(groups.hint("merge"), "node")
    asked = asked.groupBy("chunk").agg(F.collect_list(F.struct("place", "group", "node", "weight")).alias("found"))
    sets = stored(C.each_chunk(chunks, asked, _sets(gram), "group bigint, node bigint, weight bigint, grams binary"), "sets")

    def compare(table: pa.Table) -> np.ndarray:
        return jaccard_links([np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()], threshold)

    # groups are cut into blocks by numbers alone; the sets join what is left
    blocks = in_blocks(sets.select("group", "node"), ["group"], "node", block)
    blocks = blocks.join(sets.drop("group").hint("merge"), "node")
    found = stored(compare_blocks(blocks, ["group"], "node", compare, "weight"), "links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    classes = components(found.where("other is not null").select("node", "other"))
    named = nodes.drop("bands").join(classes.hint("merge"), "node", "left").join(counts.hint("merge"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    of_class = named.groupBy("component").agg(F.min("least").alias("kept"))
    known = stored(
        named.join(of_class.hint("merge"), "component").select(
            "gram_set", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("kept.id").alias("class_id"),
            F.col("kept.chunk").alias("kept_chunk"), F.col("kept.place").alias("kept_place"),
        ),
        "classes",
    )
    out = signed.select("chunk", "place", "id", "gram_set").join(known.hint("merge"), "gram_set", "left")
    alone = F.col("gram_set").isNull()
    return chunks, out.select(
        "chunk", "place", "id", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (alone | ((F.col("chunk") == F.col("kept_chunk")) & (F.col("place") == F.col("kept_place")))).alias("kept"),
    )


def link(
    docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD,
    rows: int = ROWS, recall: float = RECALL, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """``id``, ``class_id``, ``n_links`` and ``kept``, one row per document; ``kept`` holds for one document of
    each class, the one with the least id."""
    narrow = docs.select(key, text)
    _, out = _linked(narrow, key, text, gram, threshold, rows, recall, block, seed)
    return out.drop("chunk", "place")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD,
    rows: int = ROWS, recall: float = RECALL, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the least id stays."""
    chunks, out = _linked(docs, key, text, gram, threshold, rows, recall, block, seed)
    kept = out.where("kept").groupBy("chunk").agg(F.collect_list("place").alias("found"))
    columns = docs.columns

    def take(_, held, places):
        some = held.take(pa.array(sorted(places), pa.int64()))
        row = some.field("row")
        yield pa.RecordBatch.from_arrays([some.field("text") if c == text else row.field(c) for c in columns], names=columns)

    return C.each_chunk(chunks, kept, take, docs.schema)
