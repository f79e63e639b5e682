"""Usable-sample counts, cutting of fixed-length samples, splits and feature rows.

A cut is kept as one row per sample (``sample_id``, ``end_rn``); ``expand`` makes the overlapping
copies only where they are needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gaugeline.functions import HOUR_US, col, first_integer, nan_to_null
from gaugeline.operators.gaps import segments
from gaugeline.operators.ordered import LAYOUT, Axis, Scan, block_window, instant, instant_bucket, place, scan, with_context

#: Ends of segments and targets walked by one task of the feasible gaps, some hundred bytes each.
ROWS_OF_A_TASK = 1 << 20


def all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNotNull() for c in columns])


def _present_count(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [col(c).isNotNull().cast("bigint") for c in columns])


def missing_share(
    df: DataFrame, axis: Axis, predictors: Sequence[str], spans: Sequence[int], *, row: str = "rn"
) -> DataFrame:
    """Number the rows and add ``miss_<span>``: the share of missing predictor cells in the previous
    ``span`` rows, the row itself excluded; null for the first row, shorter at the start.

    Cells are counted by running totals, so a span costs one look back instead of ``span`` reads.  Rows
    that have a column ``row`` keep their numbers.
    """
    position = None if row in df.columns else row
    numbered = scan(df, axis, Scan(total={"__seen": _present_count(predictors)}), position=position)
    numbered = numbered.withColumn("__upto", F.col("__seen") - _present_count(predictors))
    blocks = with_context(numbered, axis.keys, row, max(spans) + 1)
    inside = block_window(axis.keys, row)
    shares = {}
    for span in spans:
        rows = F.least(col(row) - 1, F.lit(span))
        # total up to row rn-1-span; none before the start of the series
        earlier = F.coalesce(F.lag("__seen", span + 1).over(inside), F.lit(0))
        seen = F.col("__upto") - earlier
        shares[f"miss_{span}"] = F.when(rows > 0, 1 - seen / (rows * len(predictors)))
    return blocks.withColumns(shares).where(~F.col("__ctx")).drop("__ctx", "__blk", "__seen", "__upto")


def valid_rows(
    df: DataFrame, axis: Axis, targets: Sequence[str], predictors: Sequence[str], span: int, tolerance: float, *, row: str = "rn"
) -> DataFrame:
    """Rows whose targets are all present and whose previous ``span`` rows miss at most the share
    ``tolerance`` (0..1) of predictor cells. The first row never qualifies."""
    if not 0 <= tolerance <= 1:
        raise ValueError("tolerance is a share between 0 and 1")
    shared = missing_share(df, axis, predictors, [span], row=row)
    ok = all_present(targets) & (F.col(f"miss_{span}") <= tolerance)
    return shared.where(ok).withColumnRenamed(f"miss_{span}", "missing")


def coverage_sweep(
    df: DataFrame,
    axis: Axis,
    target_sets: dict[str, Sequence[str]],
    predictors: Sequence[str],
    spans: Sequence[int],
    tolerances: Sequence[int] = range(0, 101, 10),
) -> DataFrame:
    """Number of valid rows for each target set, span and tolerance (percent), from one pass.

    A row counts at the first tolerance that it meets; running sums over the tolerances do the rest.
    The counts before the running sum are one aggregate per target set.
    """
    steps = sorted(tolerances)
    read = [s for s in spans if s > 0]
    rows = missing_share(df, axis, predictors, read) if read else df.where(F.lit(False))
    names = [f"__n{i}" for i in range(len(target_sets))]

    def first_met(share: Column) -> Column:
        return reduce(lambda a, b: a + b, [(share > t / 100).cast("int") for t in steps])

    met = [F.struct(F.lit(s).alias("span"), first_met(F.col(f"miss_{s}")).alias("__k")) for s in read]
    has = [all_present(t).cast("bigint").alias(n) for t, n in zip(target_sets.values(), names)]
    keys = axis.key_cols
    if read:
        seen = rows.select(*keys, *has, F.inline(F.array(*met))).groupBy(*keys, "span", "__k").agg(*[F.sum(n).alias(n) for n in names])
    else:  # an empty window never qualifies
        seen = rows.select(*keys, F.lit(0).alias("span"), F.lit(0).alias("__k"), *has)
    places = F.array(*[F.struct(F.lit(s).alias("span"), F.lit(k).alias("__k")) for s in spans for k in range(len(steps))])
    zeros = df.select(*keys).distinct() if axis.keys else df.groupBy().count().select()
    zeros = zeros.select(*keys, F.inline(places)).withColumns({n: F.lit(0).cast("bigint") for n in names})
    upto = Window.partitionBy(*keys, "span").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    counted = seen.where(F.col("__k") < len(steps)).unionByName(zeros).groupBy(*keys, "span", "__k").agg(*[F.sum(n).alias(n) for n in names])
    counted = counted.withColumns({n: F.sum(n).over(upto) for n in names})
    cells = [F.struct(F.lit(t).alias("targets"), F.col(n).alias("n")) for t, n in zip(target_sets, names)]
    tolerance = F.element_at(F.array(*[F.lit(t) for t in steps]), F.col("__k") + 1).alias("tolerance")
    return counted.select(*keys, "span", tolerance, F.inline(F.array(*cells))).select(*keys, "targets", "span", "tolerance", "n")


def gapless_counts(
    df: DataFrame, axis: Axis, targets: Sequence[str], lengths: Sequence[int] = range(10, 169, 25)
) -> DataFrame:
    """For each target and length: windows of that many rows in one segment whose last row has the target."""
    numbered = segments(df, axis, position="__pos")
    counts, cells = [], []
    for t in targets:
        for n in lengths:
            alias = f"c{len(counts)}"
            counts.append(F.count_if(col(t).isNotNull() & (F.col("__pos") >= n)).alias(alias))
            cells.append(F.struct(F.lit(t).alias("param"), F.lit(n).alias("length"), F.col(alias).alias("n")))
    return numbered.groupBy(*axis.key_cols).agg(*counts).select(*axis.key_cols, F.inline(F.array(*cells)))


def gap_feasibility(
    df: DataFrame, axis: Axis, targets: Sequence[str], segment_rows: int, gaps: Sequence[int] = range(0, 167, 5)
) -> DataFrame:
    """For each target and gap: target rows for which the last row at or before (time - gap) has at
    least ``segment_rows`` rows up to it in its segment.

    That holds from a segment's row of that number up to the next segment: one interval per segment.
    Shifted by the gap, its two ends ask how many targets lie before them; targets are read once and
    only ends are copied for the gaps.
    """
    keys = axis.key_cols
    numbered = segments(df.where(col(axis.time).isNotNull()), axis, position="__pos")
    ends = numbered.where((F.col("__pos") == segment_rows) | (F.col("__pos") == 1)).select(
        *keys, F.unix_micros(col(axis.time)).alias("__u"), F.col("__pos").alias("__pos")
    )
    # the n-th row opens, a first row closes what was open before it
    walked = scan(
        ends.withColumn("__t", F.timestamp_micros("__u")), axis.with_(time="__t", tie=("__pos",)), Scan(prior={"__was": F.col("__pos")}),
    )
    closes = (F.col("__pos") == 1) & F.coalesce(F.col("__was") == segment_rows, F.lit(False))
    sign = F.when(F.col("__pos") == segment_rows, 1).otherwise(0) - F.when(closes, 1).otherwise(0)
    at = F.col("__u") + F.col("gap") * F.lit(HOUR_US)
    asked = walked.withColumn("__sign", sign).where("__sign != 0").select(
        *keys, "__u", "__sign", F.explode(F.array(*[F.lit(int(g)) for g in gaps])).alias("gap")
    ).select(*keys, "gap", "__sign", F.timestamp_micros(at).alias("__t"))
    has = {f"__has{i}": col(t).isNotNull() for i, t in enumerate(targets)}
    read = df.where(col(axis.time).isNotNull()).select(*keys, col(axis.time).alias("__t"), *[h.cast("bigint").alias(n) for n, h in has.items()])
    both = asked.unionByName(read, allowMissingColumns=True)
    # a target at the very time of an end lies behind it
    both = both.withColumn("__u", instant(F.col("__t"), F.when(F.col("gap").isNull(), 0).otherwise(-1)))
    if not axis.parts:
        # copies compress so well that tasks cut by bytes would hold far more rows as the input grows
        most = df.count() * (len(gaps) + 1)
        tasks = max(1 + most // ROWS_OF_A_TASK, df.sparkSession.sparkContext.defaultParallelism)
        both = both.withColumn(LAYOUT, place(axis, instant_bucket(axis, "__u"))).repartition(tasks, LAYOUT)
    counted = scan(
        both, axis.with_(time="__u", tie=()), Scan(total={f"__c{i}": F.col(n) for i, n in enumerate(has)}, whole={f"__w{i}": F.col(n) for i, n in enumerate(has)}),
    ).where("gap is not null")
    # behind an opening end lie all targets but those before it
    sums = [F.sum(F.col("__sign") * (F.col(f"__w{i}") - F.col(f"__c{i}"))).alias(f"__n{i}") for i in range(len(targets))]
    found = counted.groupBy(*keys, "gap").agg(*sums)
    # gaps for which no end lies in reach count 0
    whole = df.select(*keys).distinct() if axis.keys else df.groupBy().count().select()
    zeros = whole.select(*keys, F.explode(F.array(*[F.lit(int(g)) for g in gaps])).alias("gap"))
    zeros = zeros.select(*keys, "gap", *[F.lit(0).cast("bigint").alias(f"__n{i}") for i in range(len(targets))])
    done = found.unionByName(zeros).groupBy(*keys, "gap").agg(*[F.sum(f"__n{i}").alias(f"__n{i}") for i in range(len(targets))])
    cells = [F.struct(F.lit(t).alias("param"), F.col(f"__n{i}").alias("n")) for i, t in enumerate(targets)]
    return done.select(*keys, "gap", F.inline(F.array(*cells)))


# --- cutting ---------------------------------------------------------------------------------


def _named(ends: DataFrame, axis: Axis, prefix: str, first: int) -> DataFrame:
    """Number the samples of a series in time order."""
    numbered = scan(ends, axis, Scan(), position="__no")
    name = F.concat(F.lit(prefix), (F.col("__no") + (first - 1)).cast("string"))
    return numbered.select(
        *axis.key_cols, name.alias("sample_id"), F.col("rn").alias("end_rn"), col(axis.time).alias("end_time")
    )


def strict_samples(numbered: DataFrame, axis: Axis, targets: Sequence[str], length: int) -> DataFrame:
    """Ends of runs of ``length`` rows whose last row has all targets and whose other rows share a
    segment; the last row may open the next one. ``numbered`` comes from ``number_rows``."""
    if length < 2:
        return _named(numbered.where(F.lit(False)), axis, "segment_", 1)
    ok = all_present(targets) & (F.col("rn") >= length) & (F.col("prev_pos") >= length - 1)
    return _named(numbered.where(ok), axis, "segment_", 1)


def tolerant_samples(
    df: DataFrame, axis: Axis, targets: Sequence[str], predictors: Sequence[str], length: int, tolerance: float
) -> DataFrame:
    """Ends of fault-tolerant samples: rows ``[end - length, end]``, numbered from 0."""
    return _named(valid_rows(df, axis, targets, predictors, length, tolerance), axis, "Segment_", 0)


def number_rows(df: DataFrame, axis: Axis) -> DataFrame:
    """Add ``rn`` (row number in the series), ``Segment`` and ``prev_pos``, as cutting needs them."""
    base = df.drop("Segment") if "Segment" in df.columns else df
    return segments(base, axis, row="rn", previous_position="prev_pos")


def expand(ends: DataFrame, numbered: DataFrame, keys: Sequence[str], back: int, row: str = "rn") -> DataFrame:
    """Rows of each sample: ``(keys…, sample_id, step, columns…)`` for ``[end_rn - back, end_rn]``.

    An equi-join on blocks of ``back + 1`` rows; a sample touches at most two blocks, so at most
    twice the output is looked at.
    """
    width = back + 1
    first = F.greatest(F.lit(1).cast("bigint"), F.col("end_rn") - back)
    block = lambda r: F.floor((r - 1) / width).cast("bigint")
    wanted = ends.select(
        *[col(k) for k in keys], "sample_id", "end_rn", first.alias("__first"),
        F.explode(F.sequence(block(first), block(F.col("end_rn")))).alias("__blk"),
    )
    rows = numbered.withColumn("__blk", block(col(row)))
    joined = wanted.join(rows, [*keys, "__blk"]).where(col(row).between(F.col("__first"), F.col("end_rn")))
    rest = [c for c in numbered.columns if c not in keys and c != row]
    return joined.select(
        *[col(k) for k in keys], "sample_id", (col(row) - F.col("__first")).cast("int").alias("step"), *[col(c) for c in rest]
    )


# --- loading ---------------------------------------------------------------------------------


def write_samples(rows: DataFrame, path: str, *, buckets: int = 256, keys: Sequence[str] = ()) -> None:
    """Overwrite the samples table: rows of ``expand`` in folders by a hash of the sample, so that a
    manifest of samples can be read from few of them.  The folder column is ``bucket``."""
    by = [*[col(k) for k in keys], F.col("sample_id")]
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_samples(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of the samples table.  A table without samples has no files to tell its columns, so pass
    the ``schema`` of the rows where that may happen."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField("bucket", IntegerType())]))
    return reader.parquet(path).drop("bucket")


def load_samples(
    rows: DataFrame,
    input_columns: Sequence[str],
    output_columns: Sequence[str],
    *,
    input_rows: tuple[int, int] = (0, 95),
    output_rows: int = -1,
    names: DataFrame | None = None,
    fault_tolerant: bool = False,
    keys: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Samples as ``(keys…, sample_id, features, target)``; both arrays run row by row.

    Kept are samples with at least ``input_rows[1]`` rows and, unless ``fault_tolerant``, without
    missing cells in inputs or outputs. ``output_rows`` -k means the last k rows, k >= 0 those from
    step k on. ``names`` restricts to a manifest. One shuffle by sample; a sample is short.
    """
    missing = [c for c in [*input_columns, *output_columns] if c not in rows.columns]
    if missing:
        raise ValueError(f"columns not in the samples: {', '.join(missing)}")
    by = [*keys, "sample_id"]
    if names is not None:
        rows = rows.join(names.select(*[col(b) for b in by]).distinct(), by, "left_semi")
    start, stop = input_rows
    cells = F.struct(
        F.col("step").alias("step"),
        F.array(*[nan_to_null(col(c).cast("double")) for c in input_columns]).alias("x"),
        F.array(*[nan_to_null(col(c).cast("double")) for c in output_columns]).alias("y"),
        *[col(e) for e in extra],
    )
    gathered = rows.groupBy(*[col(b) for b in by]).agg(F.array_sort(F.collect_list(cells)).alias("__r"))
    r, n = F.col("__r"), F.size("__r")
    from_row = F.greatest(n + output_rows, F.lit(0)) if output_rows < 0 else F.lit(output_rows)
    inputs = F.slice(r, start + 1, max(stop - start, 0))
    outputs = F.slice(r, from_row + 1, F.greatest(n - from_row, F.lit(0)))
    kept = gathered.where(n >= stop).select(
        *[col(b) for b in by],
        F.flatten(F.transform(inputs, lambda s: s["x"])).alias("features"),
        F.flatten(F.transform(outputs, lambda s: s["y"])).alias("target"),
        *[F.transform(outputs, lambda s, e=e: s[e]).alias(e) for e in extra],
    )
    if fault_tolerant:
        return kept
    whole = ~F.exists("features", lambda v: v.isNull()) & ~F.exists("target", lambda v: v.isNull())
    return kept.where(whole)


def target_rows(
    rows: DataFrame, outputs: Sequence[str], *, time: str = "ts", output_rows: int = -1, keys: Sequence[str] = ()
) -> DataFrame:
    """What baselines forecast: the output rows of each sample as ``(keys…, sample_id, step, time,
    outputs…)``, steps from 0. ``output_rows`` as in ``load_samples``."""
    by = [*[col(k) for k in keys], F.col("sample_id")]
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))  # a sample is short
    first = F.greatest(F.col("__n") + output_rows, F.lit(0)) if output_rows < 0 else F.lit(output_rows)
    numbered = rows.withColumn("__n", size).withColumn("__first", first.cast("int"))
    return numbered.where(F.col("step") >= F.col("__first")).select(
        *by, (F.col("step") - F.col("__first")).alias("step"), col(time), *[col(o) for o in outputs]
    )


# --- splits ----------------------------------------------------------------------------------


#: Counts that the driver reads at once to find an order statistic.
_BINS = 1 << 16


def _kth(places: DataFrame, k: int) -> tuple[int, int, int]:
    """The k-th of the whole numbers ``__place`` in order, how many are below it, and how many equal it.

    A histogram tells the bin that holds it, a histogram of that bin the next smaller one, until a bin is
    one number or holds so few that they are counted one by one.  Nothing is sorted.
    """
    low, high = places.agg(F.min("__place"), F.max("__place")).first()
    before, few = 0, False
    while True:
        width = 1 if few else -(-(high - low + 1) // _BINS)
        inside = places.where(F.col("__place").between(low, high))
        number = F.call_function("div", F.col("__place") - F.lit(low), F.lit(width).cast("bigint"))
        for r in sorted(inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if before + r.n >= k:
                break
            before += r.n
        low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width - 1)
        if width == 1:
            return low, before, r.n
        few = r.n <= _BINS


def _first_k(names: DataFrame, places: Sequence[Column], k: int) -> DataFrame:
    """Mark the first k names in order of the places with ``__first``, without sorting names.

    Only names at the place of the cut, where not all of them are first, go on to the second place, and so on;
    what shares all places is dealt by a further hash, and equal rows are counted.  A missing place is the last.
    """
    columns = [col(c) for c in names.columns]
    last = F.lit((1 << 63) - 1)
    done, rest = [], names
    for place in [*places, F.shiftrightunsigned(F.xxhash64(F.lit("first"), *columns), 1)]:
        placed = rest.withColumn("__place", F.coalesce(place, last))
        at, before, equal = _kth(placed.select("__place"), k)
        here = F.col("__place")
        if before + equal == k:
            done.append(placed.select(*columns, (here <= at).alias("__first")))
            rest = None
            break
        done.append(placed.where(here != at).select(*columns, (here < at).alias("__first")))
        rest, k = placed.where(here == at).select(*columns), k - before
    if rest is not None:  # equal rows
        counted = rest.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
        dealt = counted.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i"))
        done.append(dealt.select(*columns, (F.col("__i") <= k).alias("__first")))
    return reduce(DataFrame.unionByName, done)


def _digest(text: Column) -> Column:
    """60 bits of the MD5 digest, as other engines compute it."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _split(names: DataFrame, places: Sequence[Column], first: int, parts: tuple[str, str]) -> DataFrame:
    """``split`` is the first part for the first names and the second for the others."""
    columns = [col(c) for c in names.columns]
    if first <= 0:
        return names.select(*columns, F.lit(parts[1]).alias("split"))
    marked = _first_k(names, places, first)
    return marked.select(*columns, F.when(F.col("__first"), parts[0]).otherwise(parts[1]).alias("split"))


def temporal_split(names: DataFrame, test_size: float = 0.2, sample: str = "sample_id") -> DataFrame:
    """``(sample_id, split)``: by the number in the name, the first ``int(n * (1 - test_size))`` train;
    names of one number are ordered by digest."""
    places = [first_integer(col(sample)), _digest(_whole_name(names, sample))]
    return _split(names, places, expected_split_sizes(names.count(), test_size, "temporal")[0], ("train", "test"))


def _whole_name(names: DataFrame, sample: str) -> Column:
    """The name and, for keyed samples, the other columns."""
    others = [c for c in names.columns if c != sample]
    return F.concat_ws("|", col(sample), *[col(c).cast("string") for c in others])


def random_split(names: DataFrame, test_size: float = 0.2, seed: int = 10, sample: str = "sample_id") -> DataFrame:
    """Seeded split with ``ceil(n * test_size)`` test samples; the same names give the same split on
    any cluster, as the order is a digest of name and seed."""
    place = _digest(F.concat_ws("|", _whole_name(names, sample), F.lit(str(seed))))
    return _split(names, [place], expected_split_sizes(names.count(), test_size, "random")[1], ("test", "train"))


def expected_split_sizes(n: int, test_size: float, kind: str) -> tuple[int, int]:
    """(train, test) sizes of a split of n samples."""
    if kind == "temporal":
        train = int(n * (1 - test_size))
        return train, n - train
    test = math.ceil(n * test_size)
    return n - test, test
