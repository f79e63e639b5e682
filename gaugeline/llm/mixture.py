"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix has a size in words (a share of all words).  Targets divide it by weight, no source above a
multiple of its own size; what that cuts off goes to the others by weight, until none is above.

Seats are blocks of equal size.  They go to sources by highest quotient ``target / (2 s + 1)``, and in
the same way from a source to its shards; the last block of a source that is taken as often as it may be,
and the only one of a source whose target is below a block, are partial.  A shard is a seeded hash class of
a source's documents, small enough for one task, so no source, however large, is ordered in one place.
Within a shard the
documents stand in seeded order and are cut into blocks on end; a quota of q blocks takes the first q,
beginning again at the first when all are taken.  At most one document of a shard is thus taken in part,
and rerunning gives the same mix.

Corner cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own;
rows of equal id are ordered by text, and equal rows share alike whatever their order; an empty table
gives an empty table; columns pass through, and ``size``, ``source_size``, ``target``, ``taken``
replace input columns of the same name.

One row per source and one per shard reach the driver.  A shard holds ``shard_words`` words, more where
these were more than ``shards`` shards; more than ``max_sources`` sources raise an error.  Documents
without words are in no shard.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.columns import beside
from gaugeline.llm.words import WORD, n_words, words

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK = 8
SHARD_WORDS, SHARDS = 4_000_000, 100_000
MAX_SOURCES = 5_000_000


def fill_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared again."""
    targets = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), total
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = most * sizes[i]
        left -= math.fsum(most * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotient ``v / (2 s + 1)``, the first of equals first, none above ``most``.

    Starts from rounded quotas and gives or takes the few seats that differ, which ends at the same
    seats as dealing them one by one.
    """
    n = len(votes)
    most = [seats] * n if most is None else most
    total = math.fsum(votes)
    held = [min(m, math.floor(v * seats / total + 0.5)) if total else 0 for v, m in zip(votes, most, strict=True)]
    gap = seats - sum(held)
    if gap > 0:
        heap = [(-v / (2 * h + 1), i) for i, (v, h) in enumerate(zip(votes, held, strict=True)) if v > 0 and h < most[i]]
        heapq.heapify(heap)
        while gap and heap:
            _, i = heapq.heappop(heap)
            held[i] += 1
            gap -= 1
            if held[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    elif gap < 0:
        heap = [(v / (2 * h - 1), -i) for i, (v, h) in enumerate(zip(votes, held, strict=True)) if h]
        heapq.heapify(heap)
        while gap:
            _, i = heapq.heappop(heap)
            i = -i
            held[i] -= 1
            gap += 1
            if held[i]:
                heapq.heappush(heap, (votes[i] / (2 * held[i] - 1), -i))
    return held


def _exact(quotas: list[int], most: list[int], due: int) -> list[int]:
    """Quotas of shards, in words, whose sum is what the source is due: partial last blocks give or take."""
    gap = due - sum(quotas)
    for i, (q, m) in enumerate(zip(quotas, most, strict=True)):
        step = max(-q, min(gap, m - q))
        quotas[i] += step
        gap -= step
    return quotas


def _shard(size: Column, key: str, text_hash: Column, seed: int, shard_words: int) -> Column:
    n = F.ceil(size / F.lit(float(shard_words)))
    return F.when(n > 1, F.pmod(F.xxhash64(F.lit(seed), key, text_hash), n)).otherwise(F.lit(0)).cast("bigint")


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS,
    share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 17, shard_words: int = SHARD_WORDS,
    shards: int = SHARDS, max_sources: int = MAX_SOURCES, keep_text: bool = True,
) -> DataFrame:
    """The documents with ``size`` (words), ``source_size``, ``target`` of the source, and ``taken`` (words
    of this document in the mix, repeats counted).  ``weights`` repeat over the sources in code point
    order, null last.  Without ``keep_text`` the text column is left out and not moved."""
    spark = docs.sparkSession
    names = ["size", "source_size", "target", "taken"]
    kept = [c for c in beside(docs.columns, names) if keep_text or c != text]
    sized = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("doc"), F.col(source).alias("source"), F.col(key).alias("key"),
        n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("hash"),
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows = sorted(per_source, key=lambda r: (r.source is None, (r.source or "").encode() if isinstance(r.source, (str, type(None))) else r.source))
    sizes = [r.n for r in rows]
    total = share * sum(sizes)
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], total, most)
    shard_words = max(shard_words, sum(sizes) // shards)
    large = [t if t >= block else 0.0 for t in targets]
    seats = sainte_lague(large, round(math.fsum(large) / block), [math.ceil(most * n / block) for n in sizes])
    words_of = [min(s * block, int(most * n)) if t else round(u) for s, n, t, u in zip(seats, sizes, large, targets, strict=True)]

    # one row per source, bounded by max_sources, is joined; broadcast when small
    kind = docs.schema[source].dataType
    schema = T.StructType([T.StructField("source", kind), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    sources = spark.createDataFrame([(r.source, r.n, t) for r, t in zip(rows, targets, strict=True)], schema)
    known = sized.join(F.broadcast(sources) if len(rows) <= 10_000 else sources, sized["source"].eqNullSafe(sources["source"])).select(
        "doc", sized["source"], "key", "size", "hash", "source_size", "target"
    )
    dealt = known.where("size > 0").withColumn("shard", _shard(F.col("source_size"), "key", F.col("hash"), seed, shard_words))
    by_source: dict = {}
    for r in dealt.groupBy("source", "shard").agg(F.sum("size").alias("n")).orderBy("shard").collect():
        by_source.setdefault(r.source, []).append((r.shard, r.n))
    quotas = []
    for r, due in zip(rows, words_of, strict=True):
        dealt_to = by_source.get(r.source, [])
        got = sainte_lague([n for _, n in dealt_to], -(-due // block), [math.ceil(most * n / block) for _, n in dealt_to])
        got = _exact([min(q * block, int(most * n)) for (_, n), q in zip(dealt_to, got, strict=True)], [int(most * n) for _, n in dealt_to], due)
        quotas += [(r.source, k, n, q) for (k, n), q in zip(dealt_to, got, strict=True)]
    schema = T.StructType(
        [T.StructField("source", kind), T.StructField("shard", T.LongType()), T.StructField("shard_size", T.LongType()), T.StructField("quota", T.LongType())]
    )
    quota = spark.createDataFrame(quotas, schema)
    by = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "key", "hash"), "key", "hash", "size")
    end = F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("end", end).alias("d").join(
        (F.broadcast(quota) if len(quotas) <= 10_000 else quota).alias("q"),
        F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")),
    )
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0)
    rest = F.col("quota") - rounds * F.col("shard_size")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    empty = known.where("size = 0").select("doc.*", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    taken = placed.select("doc.*", "size", "source_size", "target", (rounds * F.col("size") + partly).cast("bigint").alias("taken"))
    return taken.unionByName(empty)


def repeat_rows(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each time a document is taken: whole rounds with the whole text, a part with the text up
    to the end of its last word, white space as it is.  Documents not taken go."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    part = F.col("taken") - whole * F.col("size")
    first = lambda pieces: F.slice(pieces, F.lit(1), part.cast("int"))
    blanks = F.split(F.col(text), f"{WORD}+")  # before each word, and after the last
    cut = F.when(part > 0, F.array(F.array_join(F.zip_with(first(blanks), first(words(F.col(text))), lambda b, w: F.concat(b, w)), "")))
    copies = F.concat(F.array_repeat(F.col(text), whole.cast("int")), F.coalesce(cut, F.array().cast("array<string>")))
    others = [c for c in mixed.columns if c not in (text, "size", "source_size", "target", "taken")]
    out = mixed.where(F.col("taken") > 0).select(*[F.col(c) for c in others], F.explode(copies).alias(text))
    return out.select(*[c for c in mixed.columns if c in out.columns])
