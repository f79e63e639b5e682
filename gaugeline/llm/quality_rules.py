"""Learned decision lists: quality rules that read as ``feature >= x and feature < y``.

Sequential covering on labelled documents.  A rule for junk grows by the condition with the highest
information gain over all thresholds, is pruned from its end on documents kept aside, and is accepted if
it is precise on both parts; the documents it covers leave, and the next rule grows on the rest.  The
driver sees counts by (feature, threshold interval) only, a table whose size depends on neither
documents nor labels.  The list becomes one ordered ``when … when … otherwise`` expression.  Everything
runs as DataFrame operations.

Words are runs without space, tab, line feed, vertical tab, form feed and carriage return.

Corner cases: null and empty texts measure 0 throughout and fail the base rule (fewer than ``MIN_WORDS``
words); shares of nothing are 0; a document with several labels counts once for each, null labels and
labels without a document do not count; without labels of both kinds there are no rules; repeated rows
are measured one by one; an empty table gives an empty table; columns pass through, and measured
columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.columns import beside, unused
from gaugeline.llm.words import WORD, let, words
from gaugeline.sources.tables import fresh_path

MIN_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = " \t\n\x0b\x0c\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


@dataclass(frozen=True)
class Condition:
    feature: str
    least: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= F.lit(self.threshold) if self.least else value < F.lit(self.threshold)

    def __str__(self):
        return f"{self.feature} {'>=' if self.least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self):
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        """True unless a rule applies; the first that does decides."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
        return F.lit(True) if out is None else out.otherwise(True)

    def deciding(self) -> Column:
        """Number of the rule that decides, null if none applies."""
        out = None
        for i, rule in enumerate(self.rules):
            out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
        return F.lit(None).cast("int") if out is None else out


# --- measures --------------------------------------------------------------------------------


def _repeat_words(w: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words found twice or more.  Texts whose windows all hash
    differently, nearly all, are done at once; the others compare the windows themselves."""
    places = F.sequence(F.lit(1), F.size(w) - F.lit(WINDOW - 1))

    def exact(keyed: Column) -> Column:
        def twice(x, j):
            return F.when((F.get(keyed, j - 1)["k"] == x["k"]) | (F.get(keyed, j + 1)["k"] == x["k"]), x["p"])

        at = F.array_sort(F.filter(F.transform(keyed, twice), lambda p: p.isNotNull()))
        return let(at, lambda d: F.aggregate(
            F.transform(d, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(d, j + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda a, b: a + b,
        ))

    def keyed() -> Column:
        return F.sort_array(F.transform(places, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("k"), i.alias("p"))))

    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    differ = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(w) <= WINDOW, 0).when(differ, 0).otherwise(let(keyed(), exact))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measure(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with ``MEASURES`` (long).  Without ``keep_text`` the text column is left out."""
    t = F.coalesce(F.col(text), F.lit(""))
    by_word = let(words(t), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeat")))
    names = [c for c in beside(docs.columns, MEASURES) if keep_text or c != text]
    word, line = unused(names, "by_word"), unused(names, "by_line")
    found = docs.select(
        *names, by_word.alias(word), by_line.alias(line), F.length(F.translate(t, _BLANKS, "")).alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"), _count(t, _CAPITALS).alias("n_capitals"), _count(t, "!?").alias("n_marks"),
    )
    values = {
        "n_words": F.col(f"{word}.n"), "n_repeat_words": F.col(f"{word}.repeat"),
        "n_dup_lines": F.col(f"{line}.repeat"), "n_lines": F.col(f"{line}.n"),
    }
    return found.select(*names, *[values.get(m, F.col(m)).cast("bigint").alias(m) for m in MEASURES])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules may test, from the measures."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0).cast("double")

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "repeated_line_share": share("n_dup_lines", "n_lines"),
        "repeated_word_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }


# --- learning --------------------------------------------------------------------------------


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _cell(value: Column) -> Column:
    """A (non-negative) value cut to two significant digits."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 1)
    return F.when(value > 0, F.floor(value / step) * step).otherwise(0.0)


def _thresholds(rows: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """For each feature the cells that have values, a few hundred whatever the rows, so equal rows give
    equal thresholds in any order.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("f"), _cell(F.col(n)).alias("x")) for n in names])
    found = rows.select(F.explode(cells).alias("c")).select("c.f", "c.x").distinct().collect()
    return {name: sorted(r.x for r in found if r.f == name) for name in names}


def fit(
    measured: DataFrame, junk: Column, most_rules: int = 8, most_conditions: int = 3,
    precision: float = 0.9, least_covered: float = 0.005,
) -> DecisionList:
    """Learn rules for ``junk`` (boolean; rows where it is null do not count) on all given rows.

    ``least_covered``: a rule must cover this share of all junk, so that single documents make none.
    """
    spark = measured.sparkSession
    names = list(features())
    path = fresh_path(spark, "labelled")
    identity = F.xxhash64(*[F.col(m) for m in MEASURES], junk)
    measured.where(junk.isNotNull()).select(
        *[c.alias(n) for n, c in features().items()], junk.alias("junk"), (F.pmod(identity, F.lit(3)) < 2).alias("grow")
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    found = rows.agg(F.sum(F.col("junk").cast("bigint")).alias("junk"), F.count("*").alias("all")).first()
    if not found["junk"] or found["junk"] == found["all"]:
        return DecisionList(())
    edges = _thresholds(rows, names)
    path = fresh_path(spark, "intervals")

    def interval(name: str) -> Column:
        """How many thresholds are at most the value."""
        value = F.col(name)
        return F.size(F.filter(F.array(*map(F.lit, edges[name])), lambda edge: edge <= value)).alias(name)

    rows.select("junk", "grow", *map(interval, names)).groupBy("junk", "grow", *names).count().write.parquet(path)
    table = spark.read.parquet(path)

    def test(c: tuple[str, bool, int]) -> Column:
        name, least, k = c
        return F.col(name) > k if least else F.col(name) <= k

    def holds(conditions) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & test(c)
        return out

    def covered(rules) -> Column:
        out = F.lit(False)
        for r in rules:
            out = out | holds(r)
        return out

    def totals(part: DataFrame, *by: str):
        n = F.col("count")
        return part.groupBy(*by).agg(
            F.sum(F.when(F.col("junk"), n).otherwise(0)).alias("p"), F.sum(F.when(~F.col("junk"), n).otherwise(0)).alias("n")
        ).collect()

    def grow(left: DataFrame) -> list:
        rule: list = []
        while len(rule) < most_conditions:
            part = left.where(F.col("grow") & holds(rule))
            by = part.select("junk", "count", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("k")) for n in names])).alias("x"))
            counts = totals(by.select("junk", "count", "x.f", "x.k"), "f", "k")
            first = [r for r in counts if r.f == names[0]]
            p0, n0 = sum(r.p for r in first), sum(r.n for r in first)
            if not p0 or not n0:
                break
            best = (0.0, None)
            for name in names:
                own = sorted((r.k, r.p, r.n) for r in counts if r.f == name)
                p = n = 0
                for k, dp, dn in own[:-1]:
                    p, n = p + dp, n + dn
                    best = max(best, (_gain(p0, n0, p, n), (name, False, k)), (_gain(p0, n0, p0 - p, n0 - n), (name, True, k)), key=lambda b: b[0])
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    def prune(left: DataFrame, rule: list):
        """The prefix of the rule with the best balance on the part kept aside; its counts on both parts."""
        sums = []
        for i in range(1, len(rule) + 1):
            for grow_part in (False, True):
                of_part = (F.col("grow") == grow_part) & holds(rule[:i])
                sums += [F.sum(F.when(of_part & (F.col("junk") == j), F.col("count")).otherwise(0)) for j in (True, False)]
        got = [x or 0 for x in left.agg(*sums).first()]
        value = lambda p, n: (p - n) / (p + n) if p + n else -1.0
        best = max(range(len(rule)), key=lambda i: (value(*got[4 * i : 4 * i + 2]), -i))
        return rule[: best + 1], got[4 * best : 4 * best + 4]

    rules: list = []
    while len(rules) < most_rules:
        left = table.where(~covered(rules))
        rule = grow(left)
        if not rule:
            break
        rule, (p, n, gp, gn) = prune(left, rule)
        if p + gp < max(3, least_covered * found["junk"]) or gp < precision * (gp + gn) or p + n and p < precision * (p + n):
            break
        rules.append(rule)

    def condition(c) -> Condition:
        # the interval above k begins at edge k (the (k + 1)-th), so both sides test against one edge
        name, least, k = c
        return Condition(name, least, float(edges[name][k]))

    return DecisionList(tuple(Rule(tuple(condition(c) for c in r)) for r in rules))


def judge(measured: DataFrame, rules: DecisionList) -> DataFrame:
    """Measured documents with ``base_failed``, ``rule`` (number of the rule that rejects, else null) and
    ``kept``."""
    kept = measured.select(*beside(measured.columns, ("base_failed", "rule", "kept")))
    return kept.withColumns({"base_failed": base_failed(), "rule": rules.deciding(), "kept": ~base_failed() & rules.verdict()})


def learn_and_judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", keep_text: bool = True):
    """Measure all documents, learn from those that ``labels`` (key, label: 0 is junk) names, and judge
    all.

    Measures are stored without texts.  With ``keep_text`` they are taken once more beside the texts,
    which costs less than to store or shuffle these.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "measures")
    measure(docs, text, keep_text=False).write.parquet(path)
    measured = spark.read.parquet(path)
    marks = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("marked"), (F.col(label) == 0).alias("junk"))
    own = measured.select(F.col(key).alias("document"), *MEASURES)
    known = own.join(marks, F.col("document") == F.col("marked"))
    # what the base rule rejects needs no other rule
    rules = fit(known.where(~base_failed()), F.col("junk"))
    return judge(measure(docs, text) if keep_text else measured, rules)
