"""Calibration logs: parsing, summaries with corrections, and the sensor jump at each calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions import HOUR_US, col, leading_number, parse_time
from gaugeline.operators.ordered import Axis, Record, Scan, instant, instant_bucket, scan

# Marks in the log format, and its time format.
EXPORT_HEADER = "KorEXO Calibration File Export"
CHAPTER_MARK = "----------"
LOG_TIME_FORMATS = ("M/d/yyyy h:mm:ss a",)
MIN_ROWS_BETWEEN = 13

#: Paragraphs of one Arrow batch.
_BATCH_ROWS = 2048

# Line ends and the white space of Latin-1.
_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85"
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"


def _paragraph_reader() -> Callable[[str], Iterator[tuple[int, int, str, dict[str, str]]]]:
    """A function from a log's text to ``(chapter, paragraph, parameter type, fields)``.  It is made here so
    that it travels to the executors by value."""
    header, mark, line_ends, space = EXPORT_HEADER, CHAPTER_MARK, _LINE_ENDS, _SPACE

    def one_line_end(text):
        text = text.replace("\r\n", "\n")
        for end in line_ends:
            if end in text:
                text = text.replace(end, "\n")
        return text

    def without_headers(text):
        """The text without lines that begin with the header."""
        kept, done, at = [], 0, text.find(header)
        while at >= 0:
            first, last = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            last = last + 1 or len(text)
            if not text[first:at].strip(space):
                kept.append(text[done:first])
                done = last
            at = text.find(header, last)
        return "".join(kept) + text[done:]

    def pairs(lines):
        """``key=,value`` lines."""
        out = []
        for line in lines:
            key, found, value = line.partition("=,")
            if found:
                out.append((key.strip(space), value.strip(space)))
        return out

    def numbered(entries):
        """A key that repeats becomes ``"key n"``; of equal names the last in order of the keys counts."""
        fields, seen = dict(entries), {}
        if len(fields) == len(entries):
            return fields
        fields = {}
        for key, value in sorted(entries, key=lambda x: x[0]):
            n = seen[key] = seen.get(key, 0) + 1
            fields[key if n == 1 else f"{key} {n}"] = value
        return fields

    def read(text):
        for chapter, part in enumerate(without_headers(one_line_end(text)).split(mark)):
            paragraphs = [p for p in [x.strip(space) for x in part.strip(space).split("\n\n")] if p]
            if len(paragraphs) < 2:
                continue
            meta = dict(pairs(paragraphs[0].split("\n")))
            kind = meta.get("Parameter Type", "Unknown")
            for paragraph, body in enumerate(paragraphs[1:]):
                yield chapter, paragraph, kind, meta | numbered(pairs(body.split("\n")[1:]))

    return read


def parse_logs(logs: DataFrame, content: str = "content") -> DataFrame:
    """Log texts to one row per data paragraph: ``(other columns…, chapter, paragraph,
    parameter_type, fields)``.

    Lines with the export header are dropped; chapters end at a dashed mark, paragraphs at a blank
    line.  The first paragraph holds metadata, which is copied to every other paragraph of the
    chapter; the heading line of a paragraph is skipped.  Texts are read one at a time in Python
    workers, without a shuffle: a task holds a log and a batch of paragraphs.
    """
    read, most = _paragraph_reader(), _BATCH_ROWS
    others = [c for c in logs.columns if c != content]
    added = T.StructType().add("chapter", T.IntegerType()).add("paragraph", T.IntegerType()).add("parameter_type", T.StringType())
    added = added.add("fields", T.MapType(T.StringType(), T.StringType()))
    schema = T.StructType([logs.schema[c] for c in others] + added.fields)

    def batch_of(batch, rows):
        where, chapter, paragraph, kind, fields = zip(*rows, strict=True)
        ends = np.cumsum([0, *map(len, fields)])
        keys, values = (pa.array(chain.from_iterable(x), pa.string()) for x in (fields, map(dict.values, fields)))
        at = pa.array(where, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                *[batch.column(i).take(at) for i in range(len(others))],
                pa.array(chapter, pa.int32()), pa.array(paragraph, pa.int32()), pa.array(kind, pa.string()),
                pa.MapArray.from_arrays(pa.array(ends, pa.int32()), keys, values),
            ],
            names=[*others, "chapter", "paragraph", "parameter_type", "fields"],
        )

    def run(batches):
        for batch in batches:
            texts, rows = batch.column(len(others)), []
            for i in range(batch.num_rows):
                for row in read(texts[i].as_py() or ""):
                    rows.append((i, *row))
                    if len(rows) == most:
                        yield batch_of(batch, rows)
                        rows = []
            if rows:
                yield batch_of(batch, rows)

    return logs.select(*[col(c) for c in others], col(content)).mapInArrow(run, schema)


def summarize(parsed: DataFrame, points: int = 3, fields: str = "fields") -> DataFrame:
    """Calibration summary: times, span, and for each point pre and post values and the correction
    post - pre. Values carry a unit in the log; the leading number counts."""

    def field(name: str) -> Column:
        return F.try_element_at(col(fields), F.lit(name))

    last, start, end = (
        parse_time(field(f"{n} Time"), LOG_TIME_FORMATS)
        for n in ("Last Calibration", "Calibration Start", "Calibration End")
    )
    out = [c for c in parsed.columns if c != fields]
    columns = [col(c) for c in out] + [
        last.alias("last_calibration"),
        start.alias("calibration_start"),
        end.alias("calibration_end"),
        field("Calibration Status").alias("status"),
    ]
    columns += [
        (end - last).alias("timespan"),
        ((F.unix_micros(end) - F.unix_micros(last)) / 1e6).alias("timespan_seconds"),
    ]
    for n in range(1, points + 1):
        tail = "" if n == 1 else f" {n}"
        pre, post = (leading_number(field(f"{w} Calibration Value{tail}")) for w in ("Pre", "Post"))
        columns += [pre.alias(f"pre{n}"), post.alias(f"post{n}"), (post - pre).alias(f"correction{n}")]
    return parsed.select(*columns)


def corrections_long(summary: DataFrame, ids: Sequence[str], points: int = 3) -> DataFrame:
    """``(ids…, series, value)``: one row per correction."""
    names = [f"correction{n}" for n in range(1, points + 1)]
    return summary.select(*[col(i) for i in ids], *names).unpivot(
        [col(i) for i in ids], [col(n) for n in names], "series", "value"
    )


def calibration_jumps(
    calibrations: DataFrame,
    sensor: DataFrame,
    axis: Axis,
    value: str,
    *,
    time: str = "calibration_end",
    reach_hours: float = 24,
    min_rows: int = MIN_ROWS_BETWEEN,
) -> DataFrame:
    """Add the sensor values around each calibration and their absolute difference; one row for each
    input row.

    ``before`` comes from the last sensor row in ``[t - reach, t)``, ``after`` from the first in
    ``(t, t + reach]``; a null value in that row stays null.  ``between_count`` counts sensor rows
    since the previous calibration, ``(previous, t]``.  The values are null for the first
    calibration, with fewer than ``min_rows`` rows between, or if a side is empty.  Of calibrations of
    one time the first, in order of their columns, counts; no rows lie between it and the others.  A
    calibration without a time finds nothing.

    Calibration times, each once, enter one ordered scan just before and just after sensor rows of
    their time: the first mark sees the row before, the second the row after, and the distance of the
    second from the previous time's second mark is the row count.
    """
    keys = axis.key_cols
    reach = int(reach_hours * HOUR_US)
    payload = [c for c in calibrations.columns if c not in axis.keys]
    whole = F.struct(*[col(c) for c in payload])
    # equal calibrations are counted and dealt out again at the end
    counted = calibrations.select(*keys, whole.alias("__p")).groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    at = F.col("__p")[time]
    times = counted.where(at.isNotNull()).groupBy(*keys, at.alias("__t")).agg(F.min("__p").alias("__first"))
    asked = times.select(*keys, "__t", "__first", F.explode(F.array(F.lit(-1), F.lit(1))).alias("__o"))
    asked = asked.withColumn("__u", instant(F.col("__t"), F.col("__o")))
    read = sensor.where(col(axis.time).isNotNull()).select(
        *keys, F.lit(0).alias("__o"), instant(col(axis.time)).alias("__u"), col(value).cast("double").alias("__v")
    )
    o = F.col("__o")
    reading = Record(o == 0, {"u": (F.col("__u") / 4).cast("bigint"), "v": F.col("__v")})
    seen = scan(
        asked.unionByName(read, allowMissingColumns=True),
        axis.with_(time="__u", tie=()),
        Scan(last={"__left": reading}, following={"__right": reading}, prior={"__prev": Record(o > 0, {"u": F.col("__u")})}),
        bucket=instant_bucket(axis, "__u"),
        position="__rn",
    ).where(o != 0)
    # between two second marks stand the rows and the first mark of the later time
    between = F.col("__rn") - F.col("__prev.rn") - 2
    found = seen.groupBy(*keys, "__t", "__first").agg(
        F.max(F.when(o < 0, F.col("__left.v"))).alias("__left"),
        F.max(F.when(o > 0, F.col("__right.v"))).alias("__right"),
        F.max(F.when(o > 0, between)).alias("__rows"),
    )
    us = F.unix_micros("__t")
    left, right, rows = F.col("__left"), F.col("__right"), F.col("__rows")
    usable = (rows >= min_rows) & (left["u"] >= us - reach) & (right["u"] <= us + reach)
    jumps = found.select(
        F.struct(*keys, F.col("__t").alias("t")).alias("__at"), "__first",
        F.when(usable, left["v"]).alias("__before"), F.when(usable, right["v"]).alias("__after"), "__rows",
    )
    dealt = counted.select(
        *keys, "__p", F.struct(*keys, at.alias("t")).alias("__at"), F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__copy")
    )
    # calibrations without a time find nothing and need no join, in which they would be one hot key
    copies = dealt.where(at.isNotNull()).join(jumps, "__at", "left").unionByName(dealt.where(at.isNull()), allowMissingColumns=True)
    counts = (F.col("__copy") == 1) & F.coalesce(F.col("__p") == F.col("__first"), F.lit(False))
    before, after = F.when(counts, F.col("__before")), F.when(counts, F.col("__after"))
    return copies.select(
        *keys,
        *[F.col("__p")[c].alias(c) for c in payload],
        before.alias("before"),
        after.alias("after"),
        F.abs(after - before).alias("difference"),
        F.coalesce(F.when(counts, rows), F.lit(0)).cast("bigint").alias("between_count"),
    )
