"""Spelling variants by PartEnum signatures.

Words are maximal runs of Latin letters (``A-Z``, ``a-z`` and U+00C0 to U+00FF), A-Z lower-cased.  Two words are near
if they differ by one inserted, deleted or replaced character.  A word's letters are a multiset, seen as a
binary vector with one place for each letter and occurrence (the second ``e`` is a place of its own); near
words have vectors at a Hamming distance of at most two.  The places are dealt into ``parts`` parts, so two near
words agree on all parts but two, and a signature stands for each choice of two parts left out.  Words are
joined on equal signatures, and each pair that meets is verified; it counts under the first signature it
shares, so no pair counts twice.

How it runs: words are counted by Spark; signatures are shuffled, sorted and walked in Arrow batches, in
which the words of a signature are compared, many signatures at once: those whose first halves agree, then
those whose last halves do.
A signature with more than ``block`` words is cut into blocks, and each pair of blocks is a group of its own.
What leaves a task is a count and the best near word of each word, not pairs.  Roots are found by pointer jumping:
counts double from a word to its form, so chains are short.

Corner cases: a null or empty text has no words; rows of equal id count each; an empty table gives an empty
table; other columns are not read; a null id reads as no characters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.links import stored
from gaugeline.llm.words import distinct_spans, mix, text_bytes

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
PARTS, BLOCK = 6, 2048
#: Texts are taken in groups of about so many bytes, to bound the arrays.
GROUP_BYTES = 1 << 21
#: Longer runs get their checksum one by one.
_LONG = 64
#: Bytes of a word compared as arrays, from either end; longer words are compared one by one where these agree.
_WIDE = 32
_ROWS, _PAIRS = 1 << 16, 1 << 18


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    return table


_CRC = _crc_table()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs, and the text of each.  U+00C0 to U+00FF are 0xC3 and one more byte."""
    wide = data == 0xC3
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data] | wide
    inside[2:-1] |= wide[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    first[inner] |= inside[1:-1][inner]
    last[inner - 1] |= inside[1:-1][inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each span behind what its ``begun`` checksum has covered, a byte of all spans at a time."""
    state, size = ~begun.astype(np.uint32), ends - starts
    at, done = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(at):
        state[at] = _CRC[(state[at] ^ data[starts[at] + done]) & np.uint32(255)] ^ (state[at] >> np.uint32(8))
        done += 1
        at = at[size[at] > done]
    out = ~state
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(begun[i]))
    return out


def _counts(text: str, key: str | None, every: int, least_length: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            keys = batch.column(key).cast(pa.string()).to_pylist() if key else None
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
                said = _LOW[data[offsets[at] : offsets[to]]]
                starts, ends, of = letter_runs(said, offsets[at : to + 1] - offsets[at])
                found: Counter[str] = Counter()
                whole = np.ones(len(starts), bool)
                if key:
                    begun = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys[at:to]], np.uint32)
                    h = checksums(said, starts, ends, begun[of])
                    whole = h % np.uint32(every) != 0
                    for i in np.flatnonzero(~whole).tolist():
                        word = said[starts[i] : ends[i]].tobytes().decode()
                        k = int(h[i]) % len(word)
                        found[word[:k] + word[k + 1 :]] += 1
                codes, listed = distinct_spans(said, starts, ends)
                times = np.bincount(codes[whole], minlength=len(listed)).tolist()
                for w, n in zip(listed, times, strict=True):
                    if n:
                        found[w.decode()] += n
                kept = [(w, n) for w, n in found.items() if len(w) >= least_length]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])
                at = to

    return run


def count(
    docs: DataFrame, text: str = "text", key: str | None = None, every: int = 97,
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``(word, n)`` of the words that are long and common enough.  With ``key`` misspellings are planted: where
    ``every`` divides the CRC-32 of key, colon and word, the word loses the character that the checksum names."""
    columns = [F.col(text).cast("string").alias("text"), *([F.col(key).cast("string").alias("key")] if key else [])]
    parts = docs.select(*columns).mapInArrow(_counts("text", "key" if key else None, every, least_length), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- signatures ------------------------------------------------------------------------------


def part_hashes(words: list[bytes], parts: int) -> np.ndarray:
    """A hash for each word and part of the places that the word has there (words in Latin-1)."""
    size = np.array([len(w) for w in words], np.int64)
    letter = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((letter, of))
    letter, of = letter[order], of[order]
    fresh = np.ones(len(letter), bool)
    fresh[1:] = (letter[1:] != letter[:-1]) | (of[1:] != of[:-1])
    at = np.arange(len(letter))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    place = mix(((letter << np.uint64(32)) | nth.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(words), parts), np.uint64)
    np.add.at(out, (of, (place >> np.uint64(40)) % np.uint64(parts)), place)
    return mix(out + np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signatures(words: list[bytes], parts: int) -> np.ndarray:
    """One row per word, one column for each two parts left out."""
    hashes = part_hashes(words, parts)
    x, y = np.triu_indices(parts, 1)
    whole = hashes.sum(axis=1, dtype=np.uint64)
    return mix(whole[:, None] - hashes[:, x] - hashes[:, y] + np.arange(len(x), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _first_shared(a: list[bytes], b: list[bytes], parts: int) -> np.ndarray:
    """Number of the first signature of each pair: the first two parts that hold all that differ."""
    differ = part_hashes(a, parts) != part_hashes(b, parts)
    x, y = np.triu_indices(parts, 1)
    inside = differ.sum(axis=1)[:, None] == differ[:, x].astype(np.int64) + differ[:, y]
    return inside.argmax(axis=1)


def _sign(parts: int):
    n = parts * (parts - 1) // 2

    def run(batches):
        for batch in batches:
            words = batch.column("word")
            if not batch.num_rows:
                continue
            keys = signatures([w.encode("latin-1") for w in words.to_pylist()], parts)
            rows = np.repeat(np.arange(batch.num_rows), n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.view(np.int64).ravel(), pa.int64()), pa.array(np.tile(np.arange(n), batch.num_rows), pa.int32()),
                    words.take(pa.array(rows)), batch.column("n").take(pa.array(rows)),
                ],
                names=["sig", "which", "word", "n"],
            )

    return run


# --- verification ----------------------------------------------------------------------------


def _one_edit(a: bytes, b: bytes) -> bool:
    """Whether two different words differ by one inserted, deleted or replaced letter."""
    if abs(len(a) - len(b)) > 1:
        return False
    ahead = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    back = next((k for k in range(min(len(a), len(b))) if a[-1 - k] != b[-1 - k]), min(len(a), len(b)))
    return ahead + back >= max(len(a), len(b)) - 1


class _Words:
    """Words as arrays, aligned at their beginning and at their end."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.head = self._table([w[:_WIDE] for w in words], False)
        self.tail = self._table([w[-_WIDE:] for w in words], True)

    @staticmethod
    def _table(words: list[bytes], right: bool) -> np.ndarray:
        padded = b"".join(w[::-1].ljust(_WIDE, b"\0") if right else w.ljust(_WIDE, b"\0") for w in words)
        return np.frombuffer(padded, np.uint8).reshape(-1, _WIDE)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of different words are one edit apart."""
        size = np.maximum(self.size[i], self.size[j])
        out = np.abs(self.size[i] - self.size[j]) <= 1
        at = np.flatnonzero(out)
        i, j, size = i[at], j[at], size[at]
        # the padding of the shorter word differs from the longer one, so what agrees ends with the word
        ahead, back = (_agree(t[i], t[j]) for t in (self.head, self.tail))
        out[at] = ahead + back >= size - 1
        for k in np.flatnonzero((size > _WIDE) & ((ahead == _WIDE) | (back == _WIDE))).tolist():
            out[at[k]] = _one_edit(self.words[i[k]], self.words[j[k]])
        return out


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes agree before the first that doesn't."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), _WIDE)


def _close(group: np.ndarray, key: np.ndarray, size: np.ndarray):
    """Pairs of rows of equal group and key whose sizes differ by at most one, ever farther apart."""
    order = np.lexsort((size, key, group))
    group, key, size = group[order], key[order], size[order]
    fresh = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
    end = np.append(np.flatnonzero(fresh)[1:], len(order))[np.cumsum(fresh) - 1]
    left, step = np.arange(len(order)), 0
    while len(left):
        step += 1
        left = left[left + step < end[left]]
        left = left[size[left + step] - size[left] <= 1]  # sizes only grow from here
        for low in range(0, len(left), _PAIRS):
            i = left[low : low + _PAIRS]
            yield order[i], order[i + step]


def _compare(table: pa.Table, parts: int) -> pa.RecordBatch | None:
    """For each word, how many near words it has among these rows and which is the best; rows of a
    group (``sig``, ``a``, ``b``) stand together."""
    import pandas as pd

    group = np.cumsum(np.r_[False, np.any([np.diff(table.column(c).to_numpy()) != 0 for c in ("sig", "a", "b")], axis=0)])
    which, own, a, b = (table.column(c).to_numpy() for c in ("which", "own", "a", "b"))
    said = table.column("word").to_pylist()
    words = _Words([w.encode("latin-1") for w in said])
    n = table.column("n").to_numpy()
    # one edit leaves the first half or the last half of a word as it is
    half = min(8, int(words.size.min()) // 2)
    head, tail = (np.ascontiguousarray(t[:, :8]).view("<u8").ravel() for t in (words.head, words.tail))
    head, tail = (x & np.uint64((1 << 8 * half) - 1) for x in (head, tail))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for key in (head, tail):
        for i, j in _close(group, key, words.size):
            fits = (which[i] == which[j]) & ((a[i] == b[i]) | (own[i] != own[j]))
            if key is tail:
                fits &= head[i] != head[j]  # else met before
            i, j = i[fits], j[fits]
            near = words.near(i, j)
            i, j = i[near], j[near]
            if len(i):
                first = _first_shared([words.words[k] for k in i.tolist()], [words.words[k] for k in j.tolist()], parts)
                fits = first == which[i]
                found.append((i[fits], j[fits]))
    if not found:
        return None
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    i, j = np.r_[i, j], np.r_[j, i]
    if not len(i):
        return None
    order = sorted(range(len(said)), key=lambda k: (-n[k], words.words[k]))  # best first
    rank = np.empty(len(said), np.int64)
    rank[order] = np.arange(len(said))
    codes, _ = pd.factorize(np.array(said, object)[i])
    by = np.lexsort((rank[j], codes))
    fresh = np.flatnonzero(np.r_[True, np.diff(codes[by]) != 0])
    best = j[by[fresh]]
    pick = lambda c, rows: table.column(c).take(pa.array(rows)).combine_chunks()
    counts = np.diff(np.r_[fresh, len(by)])
    return pa.RecordBatch.from_arrays(
        [pick("word", i[by[fresh]]), pa.array(counts, pa.int64()), pick("word", best), pick("n", best)], names=["word", "n_near", "best", "best_n"]
    )


def _verified(parts: int):
    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < _ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1].as_py() for c in ("sig", "a", "b")]
            whole = np.any([table.column(c).to_numpy() != v for c, v in zip(("sig", "a", "b"), last, strict=True)], axis=0)
            cut = int(whole.sum())  # the last group may go on
            if cut and (out := _compare(table.slice(0, cut), parts)) is not None:
                yield out
            rest = table.slice(cut)
            held, size = rest.combine_chunks().to_batches(), len(rest)
        if size and (out := _compare(pa.Table.from_batches(held), parts)) is not None:
            yield out

    return run


def near_words(counted: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words of ``(word, n)`` that have near words; the best is the most
    frequent, the first in code point order of equals."""
    if parts < 3:
        raise ValueError("signatures need three parts")
    signed = counted.select("word", "n").mapInArrow(_sign(parts), "sig bigint, which int, word string, n bigint")
    # only signatures of many words need blocks
    large = stored(signed.groupBy("sig", "which").agg(F.count("*").alias("rows")).where(F.col("rows") > block), "signatures")
    placed = signed.join(large, ["sig", "which"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("rows") / block), F.lit(1)).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("sig", "which", "word", "n", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    dealt = spread.repartition("sig", "a", "b").sortWithinPartitions("sig", "a", "b", "which")
    found = dealt.mapInArrow(_verified(parts), "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", F.col("top.word").alias("best"), (-F.col("top.n")).alias("best_n")
    )


def _roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: every round doubles the way that is jumped."""
    known = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jumped = known.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        jumped = stored(jumped, "roots")
        known = jumped.drop("moved")
        if not jumped.where("moved").limit(1).count():
            return known
    raise RuntimeError("roots did not settle")


def variants(counted: DataFrame, ratio: float = RATIO, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``(word, n)``.

    The form is the best near word if it is found ``ratio`` times as often; the root is the last word on the
    way from form to form.
    """
    if ratio <= 1:
        raise ValueError("a form is more frequent than the word")
    counted = stored(counted, "words")
    near = near_words(counted, parts, block)
    taken = F.col("best_n") >= ratio * F.col("n")
    formed = stored(
        counted.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
