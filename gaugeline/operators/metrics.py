"""Scores of predictions in long form: ``(model, sample_id, step, param, pred, target)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import col, exceeds_or_zero, finite
from gaugeline.operators.combine import require_limits
from gaugeline.operators.ordered import Axis, Scan, join_keys, of_large_groups, scan


def _group(by: Sequence[str]) -> list[Column]:
    return [col(b) for b in by]


def first_samples(preds: DataFrame, n: int | None, order: Sequence[str] = ("sample_id",), by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows of the first n samples of each model. Spark keeps only the first n ranks per task
    before the shuffle (window group limit), so a model's rows never meet in one place."""
    if n is None:
        return preds
    rank = F.dense_rank().over(Window.partitionBy(*_group(by)).orderBy(*_group(order)))
    return preds.withColumn("__rk", rank).where(F.col("__rk") <= n).drop("__rk")


def first_values(preds: DataFrame, n: int | None, order: Sequence[str] = ("sample_id", "step", "param"), by: Sequence[str] = ("model",)) -> DataFrame:
    """The first n single values of each model, in row-major order of samples."""
    if n is None:
        return preds
    rank = F.row_number().over(Window.partitionBy(*_group(by)).orderBy(*_group(order)))
    return preds.withColumn("__rk", rank).where(F.col("__rk") <= n).drop("__rk")


def _usable() -> Column:
    return finite(F.col("pred")) & finite(F.col("target"))


def regression_metrics(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE and R² over finite pairs; null without a pair, R² also null with a single one.
    A constant target gives R² 1 for a perfect forecast and 0 otherwise."""
    ok = _usable()
    e = F.when(ok, F.col("pred") - F.col("target"))
    y = F.when(ok, F.col("target"))
    sse, n = F.sum(e * e), F.count(e)
    r2 = (
        F.when(n < 2, None)
        .when(F.min(y) == F.max(y), F.when(sse == 0, 1.0).otherwise(0.0))
        .otherwise(1 - sse / F.nullif(F.var_pop(y) * n, F.lit(0.0)))
    )
    return preds.groupBy(*_group(by)).agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2")
    )


def horizon_rmse(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """RMSE of each forecast step and output, over all samples."""
    e = F.when(_usable(), F.col("pred") - F.col("target"))
    return preds.groupBy(*_group(by), "step", "param").agg(F.sqrt(F.avg(e * e)).alias("rmse"))


# --- distributions ---------------------------------------------------------------------------


def _running(
    values: DataFrame, by: Sequence[str], value: str, weights: Mapping[str, str], whole: Mapping[str, str] | None = None
) -> DataFrame:
    """Running totals of weights in order of distinct values, and whole sums, per group. Values may
    cluster, so the buckets follow their distribution."""
    sums = [{n: col(w) for n, w in (given or {}).items()} for given in (weights, whole)]
    return scan(values, Axis(time=value, keys=by, parts=256), Scan(total=sums[0], whole=sums[1]))


def with_group(df: DataFrame, table: DataFrame, by: Sequence[str], fields: Sequence[str], size: str) -> DataFrame:
    """The rows with the fields of their group's row in ``table``, which has the group's number of rows as ``size``.
    Rows of large groups stay where they are; the others are joined, and no group among them is hot."""
    names = [f"`{f}`" for f in fields]
    held = df.withColumn("__g", of_large_groups(df, table, by, size, F.struct(*[F.col(n) for n in names])))
    columns = [col(c) for c in df.columns]
    large = held.where("__g is not null").select(*columns, *[F.col("__g")[f].alias(f) for f in fields])
    small = join_keys(held.where("__g is null").drop("__g"), table.select(*_group(by), *[F.col(n) for n in names]), by)
    return large.unionByName(small.select(*columns, *[F.col(n) for n in names]))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: ``n`` and ``q0, q1, …`` per group.

    The built-in exact ``percentile`` holds all distinct values of a group in one task; here equal
    values are counted first and order statistics are read from running counts.
    """
    counts = df.where(finite(col(value))).groupBy(*_group(by), col(value)).agg(F.count(F.lit(1)).alias("__c"))
    rows = _running(counts, by, value, {"__upto": "__c"}, {"n": "__c"})
    before = F.col("__upto") - F.col("__c")

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < F.col("__upto")), col(value)))

    aggs = []
    for i, p in enumerate(probabilities):
        place = F.lit(p) * (F.col("n") - 1)
        aggs += [at(F.floor(place)).alias(f"__lo{i}"), at(F.ceil(place)).alias(f"__hi{i}")]
    found = rows.groupBy(*_group(by), "n").agg(*aggs)
    out = []
    for i, p in enumerate(probabilities):
        place = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(f"q{i}"))
    return found.select(*_group(by), "n", *out)


def error_spread(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Box-plot numbers of the signed error: quartiles, and whiskers at the furthest error within
    1.5 interquartile ranges of the box."""
    errors = preds.select(*_group(by), (F.col("pred") - F.col("target")).alias("err")).where(finite(F.col("err")))
    box = exact_quantiles(errors, by, "err", (0.25, 0.5, 0.75))
    box = box.select(*_group(by), "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    e = F.col("err")
    boxes = ["n", "q1", "median", "q3"]
    whiskers = (
        with_group(errors, box, by, boxes, "n")
        .groupBy(*_group(by), *boxes)
        .agg(
            F.min(F.when(e >= F.col("q1") - reach, e)).alias("low"),
            F.max(F.when(e <= F.col("q3") + reach, e)).alias("high"),
        )
    )
    return whiskers.withColumn("low", F.least("low", "q1")).withColumn("high", F.greatest("high", "q3"))


# --- classes ---------------------------------------------------------------------------------


def binarize_predictions(preds: DataFrame, limits: Mapping[str, float] | DataFrame, params: Sequence[str] | None = None) -> DataFrame:
    """Threshold predictions and targets by the limit of their output; a missing value counts as 0.

    ``limits`` is a mapping or the long table ``(param, limit)``, one row per output.  An output
    without a limit is an error: at once for ``params``, else when its rows are read.
    """
    if isinstance(limits, DataFrame):
        table = limits.where("limit is not null").agg(
            F.map_from_entries(F.collect_list(F.struct("param", F.col("limit").cast("double"))))
        ).scalar()
    else:
        if params is not None:
            require_limits(params, limits)
        table = F.create_map(*[F.lit(x) for kv in limits.items() for x in (kv[0], float(kv[1]))])
    known = F.try_element_at(table, F.col("param"))
    missing = F.raise_error(F.concat(F.lit("no limit for column: "), F.coalesce(F.col("param"), F.lit("null"))))
    limit = F.coalesce(known, missing.cast("double"))
    return preds.withColumn("__limit", limit).select(
        *[
            exceeds_or_zero(col(c), F.col("__limit")).alias(c) if c in ("pred", "target") else col(c)
            for c in preds.columns
        ]
    )


def classification_metrics(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Confusion matrix, accuracy, precision, recall and F1 of 0/1 predictions; undefined is 0."""
    ok = _usable()
    p, t = F.col("pred") == 1, F.col("target") == 1

    def count(test):
        return F.count_if(ok & test)

    tp, fp, fn, tn = count(p & t), count(p & ~t), count(~p & t), count(~p & ~t)
    counts = preds.groupBy(*_group(by)).agg(tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"))

    def share(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
        }
    )


def score_counts(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives at it (``pos``, ``neg``), down to
    it (``tp``, ``fp``) and in all (``p``, ``n``). Equal scores form one step."""
    positive = (F.col("target") == 1).cast("bigint")
    counts = (
        preds.where(_usable())
        .groupBy(*_group(by), F.col("pred").cast("double").alias("score"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
        .withColumn("__down", -F.col("score"))
    )
    return _running(counts, by, "__down", {"tp": "pos", "fp": "neg"}, {"p": "pos", "n": "neg"}).drop("__down")


def _with_end(steps: DataFrame, by: Sequence[str], end: dict[str, float]) -> DataFrame:
    """Points and, for each group, the point of the curve that no score stands for (null score)."""
    groups = steps.select(*_group(by)).distinct()
    return steps.unionByName(groups.select(*_group(by), F.lit(None).cast("double").alias("score"), *[F.lit(v).alias(k) for k, v in end.items()]))


def roc_points(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Points of the ROC curve by score; the start (0, 0) has no score."""
    steps = score_counts(preds, by).select(
        *_group(by), "score", F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr")
    )
    return _with_end(steps, by, {"fpr": 0.0, "tpr": 0.0})


def roc_auc(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Area under the ROC curve by trapezoids; null when a class is missing."""
    steps = score_counts(preds, by)
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2)
    return steps.groupBy(*_group(by)).agg(
        F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc")
    )


def pr_points(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Points of precision over recall by score; the end, recall 0 and precision 1, has no score."""
    steps = score_counts(preds, by).select(
        *_group(by), "score",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide("tp", "p"), F.lit(1.0)).alias("recall"),
    )
    return _with_end(steps, by, {"precision": 1.0, "recall": 0.0})


def pr_auc(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Area under precision over recall by trapezoids, from recall 0 and precision 1.

    Without positives recall counts as 1 everywhere, which gives 0.5.
    """
    steps = score_counts(preds, by)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    here = tp / (tp + fp)
    before = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), F.lit(1.0))
    area = F.sum(pos * (here + before) / 2)
    return steps.groupBy(*_group(by)).agg(
        F.coalesce(F.try_divide(area, F.sum("pos").cast("double")), F.lit(0.5)).alias("pr_auc")
    )
