"""Links between rows: comparing the members of groups in blocks, and connected components.

A group is cut into blocks of bounded size; each pair of blocks is compared in one task.  A task emits,
for each member, how many it links with there, and a spanning forest of the links it found, never the
links themselves: the rows that leave are as many as those that came in.

Joins ask for merging: their sides grow with the data, so none is broadcast at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.sources.tables import fresh_path

_SALT = 8


def stored(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# --- blocks ----------------------------------------------------------------------------------


def in_blocks(members: DataFrame, group: list[str], member: str, block: int) -> DataFrame:
    """Members of groups of two or more, repeated for each pair of blocks they take part in.

    Adds ``a`` and ``b``, the pair of blocks (``a <= b``), and ``own``, the member's block.  Blocks are
    drawn by hash; a group of n has ``ceil(n / block)`` of them.
    """
    # stored, so that the join below is between plain shuffles, which Spark splits where they are skewed
    sizes = stored(members.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1"), "groups")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = members.join(sizes.hint("merge"), group).withColumn("blocks", blocks).withColumn("own", own)
    spread = placed.withColumn("other", F.explode(others))
    return spread.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("n", "blocks", "other")


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from rows that come sorted by them."""
    rest: list[pa.RecordBatch] = []

    def cuts(table: pa.Table) -> np.ndarray:
        fresh = np.zeros(len(table), bool)
        fresh[:1] = True
        for k in keys:
            column = table.column(k).combine_chunks()
            if len(column) > 1:
                fresh[1:] |= np.asarray(column[1:].to_numpy(zero_copy_only=False) != column[:-1].to_numpy(zero_copy_only=False))
        return np.flatnonzero(fresh)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch])
        at = cuts(table)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(at[-1]).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def compare_blocks(
    blocks: DataFrame, group: list[str], node: str, compare: Callable[[pa.Table], np.ndarray], weight: str | None = None
) -> DataFrame:
    """``(node, n, other)``: rows with ``n`` count links of a node (weighted), rows with ``other`` are edges.

    ``compare(table)`` returns the boolean matrix of links among the rows of a pair of blocks.  The edges
    join each member of a component found there to its least node, so a group of one block is settled.
    """
    keys = [*group, "a", "b"]
    kind = blocks.schema[node].dataType.simpleString()
    sorted_ = blocks.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        for table in by_group(batches, keys):
            n = len(table)
            if n < 2:
                continue
            linked = compare(table)
            own, a, b = (table.column(c).to_numpy() for c in ("own", "a", "b"))
            if a[0] != b[0]:
                linked = linked & (own[:, None] != own[None, :])
            np.fill_diagonal(linked, False)
            w = np.ones(n, np.int64) if weight is None else table.column(weight).to_numpy()
            counts = linked @ w
            hit = np.flatnonzero(counts)
            if not len(hit):
                continue
            nodes = table.column(node).combine_chunks()
            x, y = stars(linked, nodes.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([nodes.take(pa.array(hit)), nodes.take(pa.array(x))]),
                    pa.concat_arrays([pa.array(counts[hit], pa.int64()), pa.nulls(len(x), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(hit), nodes.type), nodes.take(pa.array(y))]),
                ],
                names=["node", "n", "other"],
            )

    return sorted_.mapInArrow(run, f"node {kind}, n bigint, other {kind}")


def stars(linked: np.ndarray, nodes: list) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every member of a component of a symmetric boolean matrix to its least node."""
    left = np.ones(len(linked), bool)
    x, y = [], []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        members, queue = [root], [root]
        while queue:
            near = np.flatnonzero(linked[queue.pop()] & left)
            left[near] = False
            members += near.tolist()
            queue += near.tolist()
        least = min(members, key=nodes.__getitem__)
        x += [least] * (len(members) - 1)
        y += [m for m in members if m != least]
    return np.array(x, np.int64), np.array(y, np.int64)


# --- components ------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(node, other)``; the component is its least node.

    Large-star and small-star steps in turn: every node links its larger neighbours, then its smaller
    ones, to its least neighbour, until all components are stars; the number of rounds grows with the
    logarithm of the size, and edges that are stars need none.  Every round is written to the shared
    folder.  Joins on a node are salted, as a group's least node may gather most edges.
    """
    pairs = edges.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).where("u != v").distinct()
    pairs = stored(pairs, "edges")
    for _ in range(most_rounds):
        if _are_stars(pairs):
            break
        both = pairs.union(pairs.select("v", "u").toDF("u", "v"))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = _to_least(large)
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        pairs = stored(small.where("u != v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(pairs.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()[0] == 0


def _to_least(pairs: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(_SALT)))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(_SALT)).cast("int"))
    return salted.join(least.hint("merge"), ["u", "salt"]).drop("salt")
