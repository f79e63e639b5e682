"""Personal data: patterns, and a semi-Markov conditional random field over whole spans.

The base are four patterns: email, ip, card (14 to 19 digits that pass Luhn) and phone (``+`` and 10 to
15 digits).  The field adds what the patterns miss: written-out addresses, numbers without the plus sign.
It reads regions around digits and at signs, cut into atoms (runs of letters, runs of digits, single
other characters), and scores candidate segments by features of the whole span: digits, groups,
separators, checksum, domain, octets, the word before.  Viterbi over segments of at most ``LONGEST``
atoms chooses boundaries and kinds together.

It is trained by conditional likelihood, forward and backward over segments, on at most ``fit_regions``
regions that hold base spans, and on copies of them in which plus signs, separators and at signs are
written otherwise; what the patterns reject is outside.  An added span never overlaps a base span.

Corner cases: a null text has no spans; without regions to learn from nothing is added; repeated rows are
read one by one; an empty table gives an empty table; columns pass through, and result columns replace
input columns of the same name.
"""

from __future__ import annotations

import bisect
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.columns import beside, unused

KINDS = ("email", "ip", "card", "phone")
FIT_REGIONS = 400
LONGEST = 24

# Repeats that never give back what they took hold no memory for it; nothing follows them.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
# Where a span of the field may lie: around an at sign (written out too), or seven digits in groups.
_AT = re.compile(r"@|[\[({] ?at ?[\])}]")
_FROM_AT = re.compile(r"(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]+)*")
_SEVEN = re.compile(r"[0-9](?:[ ().+/-]{0,3}[0-9]){6,}+")
_AROUND = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _passes(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in span.split("."))
    if kind == "card":
        digits = span.replace(" ", "").replace("-", "")
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_digits(span)) <= 15
    return True


def _emails(text: str):
    """An address is found from its at sign, so that a long run of letters is passed over once."""
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        begin = end + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        end = m.end() if m else at + 1
        if m:
            yield begin, end
        at = text.find("@", end)


def _dotted(text: str):
    """Four numbers between dots, one after the other in a longer chain."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[i : i + 4])) + 3
                yield at, at + size
                at += size + 1


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    found = {
        "email": _emails(text),
        "ip": _dotted(text) if "." in text else (),
        "card": (m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 14),
        "phone": (m.span() for m in _PHONE.finditer(text)) if "+" in text else (),
    }
    return {kind: [(a, b) for a, b in found[kind] if _passes(kind, text[a:b])] for kind in KINDS}


# --- regions and segments --------------------------------------------------------------------


def marks(text: str):
    """Leftmost places, one after the other, of an at sign with a word on either side or of seven digits in groups.

    Both are found from what is rare in them, at signs and digits, and are extended to the left."""
    signs, numbers = _signs(text), _numbers(text)
    end = 0
    sign, number = next(signs, None), numbers(0)
    while sign or number:
        if number and number[1] < end:
            number = numbers(end)
            continue
        # the word before a sign may have been taken by the match before
        if sign and max(sign[0], end) >= sign[1]:
            sign = next(signs, None)
            continue
        at_sign = max(sign[0], end) if sign else len(text)
        at_number = max(number[0], end) if number else len(text)
        if at_number < at_sign:
            yield at_number, number[2]
            end, number = number[2], numbers(number[2])
        else:
            yield at_sign, sign[2]
            end, sign = sign[2], next(signs, None)


def _signs(text: str):
    """``(begin of the word before, its end, end of the match)`` of every at sign with a word behind it."""
    passed = 0
    for m in _AT.finditer(text):
        to = m.start() - (text[m.start() - 1 : m.start()] == " ")
        found = _FROM_AT.match(text, m.start())
        if found and to > passed:
            yield passed + len(text[passed:to].rstrip(_LOCAL)), to, found.end()
        passed = m.end()


def _numbers(text: str):
    """``search(place)``: ``(begin with signs before, first digit, end)`` of the next seven digits in groups."""

    def search(place: int):
        m = _SEVEN.search(text, place)
        if m is None:
            return None
        begin = m.start()
        while begin > place and text[begin - 1] in "+(":
            begin -= 1
        return begin, m.start(), m.end()

    return search


def regions(text: str):
    """Parts of the text that the field reads, widened to some context, joined where they overlap."""
    spans: list[list[int]] = []
    for begin, end in marks(text):
        a, b = max(0, begin - _AROUND), min(len(text), end + 2)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return spans


def atoms(part: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(part)]


_CUES = {
    "email": re.compile(r"(?i)mail|contact|write"), "ip": re.compile(r"(?i)\bip\b|host|server|addr"),
    "card": re.compile(r"(?i)card|visa|credit|account"), "phone": re.compile(r"(?i)phone|tel|call|mobile|fax"),
}
_GOES_ON = re.compile(r" ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9]|[ ().+/-]{0,3}[0-9]")
_DOT = re.compile(r"\.|[\[({] ?dot ?[\])}]")
FEATURES = 31


def features(part: str, a: int, b: int) -> np.ndarray | None:
    """Features of a whole span, None if it can be no entity."""
    span = part[a:b]
    head, tail = span[0], span[-1]
    if not (head.isalnum() or head in "+(") or not tail.isalnum() and tail not in ")":
        return None
    digits = _digits(span)
    at = len(_AT.findall(span))
    if len(digits) < 7 and not at and span.count(".") != 3:
        return None
    groups = re.findall(r"[0-9]+", span)
    letters = sum(c.isalpha() for c in span)
    before, after = part[a - 1 : a], part[b : b + 1]
    n = len(digits)
    x = np.zeros(FEATURES)
    x[0] = 1
    x[1] = at == 1
    x[2] = at > 1
    if at == 1:
        local, domain = _AT.split(span, maxsplit=1)
        labels = [p.strip() for p in _DOT.split(domain)]
        x[3] = len(labels) > 1 and all(re.fullmatch(r"[A-Za-z0-9-]+", p) for p in labels)
        x[4] = bool(re.fullmatch(r"[A-Za-z]{2,}", labels[-1]))
        x[5] = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?", local))
    octets = span.split(".")
    x[6] = len(octets) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in octets)
    x[7] = bool(letters) and not at
    x[8] = 14 <= n <= 19
    x[9] = x[8] and not letters and luhn(digits)
    x[10] = 10 <= n <= 15
    x[11] = n < 10
    x[12] = n > 19
    x[13] = head == "+" or span.startswith("00")
    x[14] = head == "(" or "(" in span and ")" in span
    x[15] = len(groups) == 1
    x[16] = 2 <= len(groups) <= 4
    x[17] = len(groups) > 4
    x[18] = bool(groups) and len(groups) > 1 and all(len(g) == 4 for g in groups[:-1])
    x[19] = len(groups) >= 2 and len(groups[-1]) == 4 and len(groups[-2]) == 3
    x[20] = bool(set(span) - set("0123456789+-() .")) and not at
    x[21] = bool(re.search(r"[^0-9A-Za-z]{3}", span)) and not at
    x[22] = before.isalnum() or before in ("+", "(") and bool(before)
    x[23] = after.isalnum()
    x[24] = before in (".", "@", "_", "%", "-") and bool(before)
    lead = part[max(0, a - _AROUND) : a]
    for i, kind in enumerate(KINDS):
        x[25 + i] = bool(_CUES[kind].search(lead))
    x[29] = span.count("(") != span.count(")")
    x[30] = bool(_GOES_ON.match(part, b))
    return x


def segments_from(part: str, cut: list[tuple[int, int]]):
    """``(first atom, past the last, features)`` of all segments that may be entities, by first atom."""
    digits, other = [0], [0]  # before each atom; other characters are those that allow fewer than seven digits
    for a, b in cut:
        number = part[a] in "0123456789"
        digits.append(digits[-1] + (b - a if number else 0))
        other.append(other[-1] + (part[a] in "@.[({" or (b - a == 2 and part[a:b] == "at")))
    for i in range(len(cut)):
        c = part[cut[i][0]]
        if not (c.isalnum() or c in "+("):
            continue
        for j in range(i + 1, min(len(cut), i + LONGEST) + 1):
            if digits[j] - digits[i] < 7 and other[j] == other[i]:
                continue
            x = features(part, cut[i][0], cut[j - 1][1])
            if x is not None:
                yield i, j, x


def candidates(part: str, cut: list[tuple[int, int]]) -> list:
    return list(segments_from(part, cut))


# --- the field -------------------------------------------------------------------------------
# A segmentation is a sequence of entities and single outside atoms.  Outside atoms score 0, an entity
# of kind k scores weights[k] . features, so the bias feature sets what an entity must beat.


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def gradient(weights: np.ndarray, n: int, segments: list, gold: set) -> tuple[np.ndarray, float]:
    """Gradient of the log-likelihood of the gold segments ``(i, j, kind)``, and the likelihood."""
    scores = [weights @ x for *_, x in segments]
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j, _) in enumerate(segments):
        ending[j].append(s)
        starting[i].append(s)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = _logsum([forward[j - 1]] + [forward[segments[s][0]] + v for s in ending[j] for v in scores[s]])
    for i in range(n - 1, -1, -1):
        backward[i] = _logsum([backward[i + 1]] + [backward[segments[s][1]] + v for s in starting[i] for v in scores[s]])
    total, out, likelihood = forward[n], np.zeros_like(weights), -forward[n]
    for (i, j, x), score in zip(segments, scores, strict=True):
        expected = np.exp(forward[i] + score + backward[j] - total)
        for k in range(len(KINDS)):
            if (i, j, k) in gold:
                expected[k] -= 1
                likelihood += score[k]
        out -= expected[:, None] * x
    return out, likelihood


def viterbi(weights: np.ndarray, n: int, segments) -> list[tuple[int, int, int]]:
    """The best segmentation's entities ``(i, j, kind)``.  Segments come by first atom and are scored as they
    come, so only the best one to end at each atom is held."""
    outside, best, back = 0, [0.0] * (n + 1), [None] * (n + 1)
    ending = [-math.inf] * (n + 1)

    def settle(to: int):
        nonlocal outside
        while outside < to:
            outside += 1
            best[outside] = best[outside - 1]
            if ending[outside] > best[outside]:
                best[outside] = ending[outside]
            else:
                back[outside] = None

    for i, j, x in segments:
        settle(i)
        score = weights @ x
        k = int(score.argmax())
        if best[i] + score[k] > ending[j]:
            ending[j], back[j] = best[i] + score[k], (i, j, k)
    settle(n)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append(back[j])
            j = back[j][0]
    return out[::-1]


def examples(part: str, draw: random.Random):
    """The region and copies written otherwise, each with its spans ``(start, end, kind)``."""
    spans = sorted((a, b, k) for k, kind in enumerate(KINDS) for a, b in base_spans(part)[kind])
    clean, end = [], 0
    for a, b, k in spans:
        if a >= end:
            clean.append((a, b, k))
            end = b
    yield part, clean

    def rewritten(change):
        text, out, at = "", [], 0
        for a, b, k in clean:
            text += part[at:a]
            span = change(part[a:b], KINDS[k])
            out.append((len(text), len(text) + len(span), k))
            text += span
            at = b
        return text + part[at:], out

    def spelled(span, kind):
        if kind == "email":
            local, domain = span.rsplit("@", 1)
            opening, closing = draw.choice(["[]", "()"])
            return f"{local} {opening}at{closing} " + domain.replace(".", f" {opening}dot{closing} ")
        if kind == "phone":
            return draw.choice(["00" + span[1:], re.sub(r"^\+[0-9]{1,3}[ .-]+", "", span)])
        return span

    def spaced(span, kind):
        if kind == "phone":
            return re.sub(r"[ .-]+", draw.choice([" ", "-", "."]), span)
        if kind == "card" and span.isdigit():
            return draw.choice([" ", "-"]).join(span[i : i + 4] for i in range(0, len(span), 4))
        return span

    if clean:
        yield rewritten(spelled)
        yield rewritten(spaced)


def train(parts: list[str], epochs: int = 8, rate: float = 0.3, penalty: float = 0.002, seed: int = 3) -> np.ndarray:
    """Weights by AdaGrad on the conditional likelihood."""
    draw = random.Random(seed)
    held = []
    for part in parts:
        for text, spans in examples(part, draw):
            cut = atoms(text)
            if len(cut) > 40 * LONGEST:
                continue
            begins, ends = {a: i for i, (a, _) in enumerate(cut)}, {b: i + 1 for i, (_, b) in enumerate(cut)}
            segments = candidates(text, cut)
            known = {(i, j) for i, j, _ in segments}
            gold = {(begins[a], ends[b], k) for a, b, k in spans if a in begins and b in ends and (begins[a], ends[b]) in known}
            if len(gold) == len(spans) and segments:
                held.append((len(cut), segments, gold))
    weights = np.zeros((len(KINDS), FEATURES))
    weights[:, 0] = -2
    seen = np.full_like(weights, 1e-6)
    for _ in range(epochs if held else 0):
        draw.shuffle(held)
        for n, segments, gold in held:
            step, _ = gradient(weights, n, segments, gold)
            step -= penalty * weights
            seen += step * step
            weights += rate * step / np.sqrt(seen)
    return weights


def added_spans(text: str, weights: np.ndarray, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    taken = _merged(s for spans in base.values() for s in spans)
    begins, ends = [a for a, _ in taken], [b for _, b in taken]
    out = []
    for a, b in regions(text):
        part = text[a:b]
        inside = taken[bisect.bisect_right(ends, a) : bisect.bisect_left(begins, b)]
        if inside and _only(part, a, inside):
            continue
        cut = atoms(part)
        for i, j, k in viterbi(weights, len(cut), segments_from(part, cut)):
            begin, end = a + cut[i][0], a + cut[j - 1][1]
            if bisect.bisect_right(ends, begin) == bisect.bisect_left(begins, end):
                out.append((begin, end, KINDS[k]))
    return out


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _only(part: str, a: int, inside: list[tuple[int, int]]) -> bool:
    """Nothing is left to read besides the base spans."""
    left, at = [], 0
    for s, e in inside:
        left += [part[at : max(0, s - a)], " " * (min(e - a, len(part)) - max(0, s - a))]
        at = max(0, e - a)
    return next(marks("".join([*left, part[at:]])), None) is None


# --- documents -------------------------------------------------------------------------------


def fit(docs: DataFrame, text: str = "text", fit_regions: int = FIT_REGIONS) -> np.ndarray:
    """Train on at most ``fit_regions`` regions, those of least hash, of all documents."""

    def run(batches):
        for batch in batches:
            parts = []
            for value in batch.column("text").to_pylist():
                if value:
                    for a, b in regions(value):
                        if b - a <= 400:
                            part = value[a:b]
                            parts.append((any(base_spans(part).values()), part))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.bool_()), pa.array([p[1] for p in parts], pa.string())], names=["held", "part"])

    # only texts with an at sign, a plus sign or seven digits in groups can hold a region
    some = docs.select(F.col(text).alias("text")).where(F.col("text").rlike(r"@|[\[({] ?at ?[\])}]|[0-9](?:[ ().+/-]{0,3}[0-9]){6}"))
    found = some.mapInArrow(run, "held boolean, part string").groupBy("part").agg(F.first("held").alias("held"))
    order = [F.xxhash64("part"), F.col("part")]
    # three of four regions hold a base span, so that every kind is seen
    with_base = found.where("held").orderBy(*order).limit(fit_regions * 3 // 4)
    without = found.where("not held").orderBy(*order).limit(fit_regions - fit_regions * 3 // 4)
    return train(sorted(r.part for r in with_base.union(without).collect()))


def find(docs: DataFrame, text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """The documents with ``spans`` (array of kind, start, end in code points, and whether it was
    added), ``n_email`` … ``n_phone`` (base spans) and ``n_added``."""
    weights = fit(docs, text) if weights is None else weights
    new = ["spans", *(f"n_{k}" for k in KINDS), "n_added"]
    names = beside(docs.columns, new)
    span = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("added", T.BooleanType())]
    )
    fields = [T.StructField("spans", T.ArrayType(span)), *[T.StructField(n, T.LongType()) for n in new[1:]]]
    schema = T.StructType([docs.schema[c] for c in names] + fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))

    def run(batches):
        for batch in batches:
            spans, counts = [], {n: [] for n in new[1:]}
            for value in batch.column(text).to_pylist():
                base = base_spans(value or "")
                more = added_spans(value, weights, base) if value else []
                listed = [(a, KINDS.index(k), k, b, False) for k in KINDS for a, b in base[k]] + [(a, KINDS.index(k), k, b, True) for a, b, k in more]
                spans.append([{"kind": k, "start": a, "end": b, "added": x} for a, _, k, b, x in sorted(listed)])
                for k in KINDS:
                    counts[f"n_{k}"].append(len(base[k]))
                counts["n_added"].append(len(more))
            columns = [batch.column(c) for c in names] + [pa.array(spans, kind)] + [pa.array(counts[n], pa.int64()) for n in new[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=names + new)

    return docs.mapInArrow(run, schema)


def mask(docs: DataFrame, text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """The documents with every span of ``text`` replaced by its kind in angle brackets."""
    masked = unused(docs.columns, "masked")
    found = find(docs.withColumn(masked, F.lit(None).cast("string")), text, weights)

    def run(batches):
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if value:
                    parts, end = [], len(value)
                    for s in sorted(spans, key=lambda s: (-s["start"], -s["end"])):
                        if s["end"] <= end:
                            parts += [value[s["end"] : end], f"<{s['kind']}>"]
                            end = s["start"]
                    value = "".join([value[:end], *reversed(parts)])
                out.append(value)
            at = batch.schema.get_field_index(masked)
            yield batch.set_column(at, masked, pa.array(out, pa.string()))

    return found.mapInArrow(run, found.schema).withColumn(text, F.col(masked)).drop(masked)
