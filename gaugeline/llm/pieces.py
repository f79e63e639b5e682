"""Texts cut into the pieces that byte-level BPE encodes, as arrays, and encoding by distinct piece.

The pieces are the matches of

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

found from the class of each character (letter, number, space, other) instead of by a matcher.
Classes come from the tokenizers library itself, asked once per distinct character, so its Unicode
version decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from gaugeline.llm.words import distinct, text_bytes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Texts are taken in groups of about so many bytes, to bound the arrays.
GROUP_BYTES = 1 << 20
#: Distinct pieces remembered by a worker before it starts anew.
REMEMBERED = 500_000

_UNKNOWN = 255
_classes = np.full(0x110000, _UNKNOWN, np.uint8)


def _classify(points: np.ndarray) -> None:
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True)

    def whole(text: str) -> bool:
        return len(cut.pre_tokenize_str(text)) == 1

    for p in points.tolist():
        c = chr(p)
        _classes[p] = (
            LETTER if whole(f"a{c}a") else NUMBER if whole(f"1{c}1") else OTHER if whole(f"!{c}!") else SPACE
        )


def classes(points: np.ndarray) -> np.ndarray:
    found = _classes[points]
    unknown = np.unique(points[found == _UNKNOWN])
    if len(unknown):
        _classify(unknown)
        found = _classes[points]
    return found


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where pieces begin (and the end), and the first piece of each text (and the end)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    kind = classes(points)
    head = np.zeros(n + 1, bool)  # a text begins here
    head[np.searchsorted(lead, offsets)] = True
    head[n] = True
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = kind[1:] != kind[:-1]
    fresh |= head[:-1]
    space = kind == SPACE
    follows = np.empty(n, bool)  # the next character is a non-space of the same text
    follows[:-1] = ~space[1:]
    follows[-1] = False
    follows &= ~head[1:]
    joined = np.zeros(n, bool)  # the character before is a blank of the same text
    joined[1:] = points[:-1] == 32
    joined &= ~head[:-1]
    begins = (fresh & (space | ~joined)) | (space & follows)
    marks = np.flatnonzero((points == 39) & begins & fresh)
    if len(marks):
        _contractions(points, head, begins, marks)
    starts = np.append(lead[begins], len(data))
    return starts, np.searchsorted(starts[:-1], offsets)


def _contractions(points: np.ndarray, head: np.ndarray, begins: np.ndarray, marks: np.ndarray) -> None:
    n = len(points)

    def at(k: int) -> np.ndarray:
        """The k-th character after the apostrophe, 0 beyond the text."""
        inside = marks + k < n
        for j in range(1, k + 1):
            inside &= ~head[np.minimum(marks + j, n)]
        return np.where(inside, points[np.minimum(marks + k, n - 1)], 0)

    one, two = at(1), at(2)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(marks), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    for taken, size in ((short, 2), (long & ~short, 3)):
        m = marks[taken]
        begins[m + 1] = False
        after = m + size
        begins[after[after < n]] = True


class PieceCoder:
    """Encodes texts through their distinct pieces, which it remembers within a bound.

    ``encode_new(list of piece bytes)`` returns their ids, one list or array each.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], list], remembered: int = REMEMBERED):
        self.encode_new, self.remembered = encode_new, remembered
        self._forget()

    def _forget(self):
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts on end, and the ``len + 1`` places where each text's ids begin."""
        starts, first = split(data, offsets)
        if len(starts) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, pieces = distinct(data, starts)
        if len(self.known) > self.remembered:
            self._forget()
        new = [p for p in pieces if p not in self.known]
        if new:
            got = [np.asarray(x, np.uint32) for x in self.encode_new(new)]
            base = len(self.begin) - 1
            self.known.update((p, base + k) for k, p in enumerate(new))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in got])])
            self.ids = np.concatenate([self.ids, *got])
        entry = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[codes]
        sizes = (self.begin[1:] - self.begin[:-1])[entry]
        ends = np.cumsum(sizes)
        gather = np.arange(ends[-1]) + np.repeat(self.begin[entry] - (ends - sizes), sizes)
        return self.ids[gather], np.append(0, ends)[first]


def encoded(texts: pa.Array, coder: PieceCoder) -> Iterator[np.ndarray]:
    """The ids of each text, in order."""
    data, offsets = text_bytes(texts)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        ids, places = coder.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            yield ids[a:b]
        at = to
