"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one node, weighted by their number.  Each table cuts space by ``bits`` random
hyperplanes; vectors of equal signs share a bucket.  By default there are so many bits that unrelated
vectors fill a bucket with ``FILL`` on average, whatever their number.  The number of tables is chosen so
that a pair at the threshold meets in one of them with probability ``recall``: its signs agree on one
plane with probability ``1 - angle / pi``.  Buckets are found by their numbers alone; vectors then join
the members of buckets of two or more, which are compared in blocks by exact cosine in double
precision; a pair counts only in the first table in which it meets.  Links become components by distributed
large-star and small-star steps.

Corner cases: null, zero and empty vectors, and vectors with null or non-finite components, link with
nothing; so do vectors of different lengths; repeated ids are rows of their own, and share nothing but
their id; rows without an id take part, but a component is named by its least non-null id, and a row
without id is never kept unless its component has none; an empty table gives an empty table; columns pass
through, and result columns replace input columns of the same name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.columns import beside
from gaugeline.llm.links import compare_blocks, components, in_blocks, stored

THRESHOLD, RECALL = 0.9, 0.995
BLOCK, FILL = 1024, 16


def tables_for(threshold: float, bits: int, recall: float) -> int:
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def bits_for(n: int) -> int:
    return min(30, max(8, math.ceil(math.log2(max(n, 2) / FILL))))


def signs(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """Bucket of each vector in each table."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    positive = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return positive @ (1 << np.arange(bits, dtype=np.int64))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)  # first to a size that can't overflow
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _hash_tables(nodes: DataFrame, kind: str, tables: int, bits: int, seed: int) -> DataFrame:
    """``node``, ``weight``, ``vector`` (its bytes), ``keys`` (bucket in each table)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, weight = batch.column("node"), batch.column("weight")
            lists = batch.column("v")
            sizes = np.array([len(x) for x in lists])
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == size))
                some = lists.take(at).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), size)
                keys = signs(_units(some), tables, bits, seed).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        node.take(at), weight.take(at), pa.array(np.full(len(at), size), pa.int32()),
                        pa.array([r.tobytes() for r in some], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel())),
                    ],
                    names=["node", "weight", "dims", "vector", "keys"],
                )

    return nodes.mapInArrow(run, "node bigint, weight bigint, dims int, vector binary, keys array<int>")


def link(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    bits: int | None = None, recall: float = RECALL, block: int = BLOCK, seed: int = 7,
) -> DataFrame:
    """The rows with ``n_links``, ``component_id`` and ``kept``; ``key`` names an orderable column."""
    names = beside(vectors.columns, ("n_links", "component_id", "kept"))
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.col(vector).isNotNull() & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(sound & F.exists(doubles, lambda x: x != 0), F.lit(False))
    # equal vectors have equal text of their doubles; 0.0 is added so that -0.0 is 0.0
    same = F.unhex(F.sha2(F.array_join(F.transform(doubles, lambda x: (x + F.lit(0.0)).cast("string")), " "), 256))
    rows = vectors.select(F.struct(*names).alias("row"), F.col(key).alias("id"), F.when(usable, same).alias("same"), doubles.alias("v"))
    # vectors are numbered as they are written; the numbers are read back, never made anew
    nodes = rows.where(F.col("same").isNotNull()).groupBy("same").agg(
        F.count("*").alias("weight"), F.min("id").alias("id"), F.first("v").alias("v")
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    bits = bits_for(nodes.count()) if bits is None else bits
    tables = tables_for(threshold, bits, recall)
    # single precision comes and goes as it is, all else as doubles
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    hashed = stored(_hash_tables(nodes.select("node", "weight", "v"), kind, tables, bits, seed), "signs")
    buckets = hashed.select("node", "dims", F.posexplode("keys").alias("tab", "bucket"))

    def compare(table: pa.Table) -> np.ndarray:
        unit = _units(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(len(table), -1))
        linked = unit @ unit.T >= threshold
        keys = np.array(table.column("keys").to_pylist(), np.int32).reshape(len(table), -1)
        for earlier in range(table.column("tab")[0].as_py()):
            if not linked.any():
                break
            linked &= keys[:, earlier, None] != keys[None, :, earlier]
        return linked

    group = ["tab", "bucket", "dims"]
    blocks = in_blocks(buckets, group, "node", block).join(hashed.select("node", "weight", "vector", "keys").hint("merge"), "node")
    found = stored(compare_blocks(blocks, group, "node", compare, "weight"), "links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    grouped = components(found.where("other is not null").select("node", "other"))
    named = nodes.select("node", "same", "weight", "id").join(grouped, "node", "left").join(counts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    known = stored(
        named.join(least, "component").select("same", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"),
        "classes",
    )
    out = rows.select("row", "id", "same").join(known, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        "row.*", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
