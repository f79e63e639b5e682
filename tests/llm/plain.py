"""The operators' results in plain Python, for small tables."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_removed(rows, window):
    """``[(n_words, n_removed, kept words)]`` of texts."""
    split = [words(t) for t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def lines_deleted(rows, min_words):
    """``[(n_lines, n_deleted, left text)]`` of texts in order: a line goes if any run of lines around it
    that holds ``min_words`` words stands at an earlier place."""
    split = [(t or "").split("\n") for t in rows]
    seen, out = set(), []
    for text, lines in zip(rows, split, strict=True):
        n, gone = [len(words(x)) for x in lines], set()
        for i in range(len(lines)):
            held = 0
            for j in range(i + 1, len(lines) + 1):
                held += n[j - 1]
                if held >= min_words:
                    run = hash(tuple(lines[i:j]))
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        out.append((len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text))
    return out


def grams(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def classes(n, links):
    """Least member of the component of each of ``n`` items."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def quality(text):
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def sainte_lague(votes, seats):
    held = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * held[i] + 1), -i))
        held[best] += 1
    return held


def targets(sizes, weights, total, most):
    """Shares ``min(most * size, level * weight)`` whose sum is ``total``, the level found by bisection."""
    low, high = 0.0, most * sum(sizes) + 1.0
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * n, level * w) for n, w in zip(sizes, weights)) < total else (low, level)
    return [min(most * n, high * w) for n, w in zip(sizes, weights)]


def item_words(text):
    """Words and their places in the text."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower))
    return [m.group() for m in found], [m.span() for m in found]


def occurrences(text, items, window):
    """``(n_words, hit word numbers, spans of hit runs, ids)`` for ``items`` of ``(id, text)``."""
    ws, spans = item_words(text)
    hit, ids = set(), set()
    for key, item in items:
        w, _ = item_words(item)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for j in range(len(ws) - len(part) + 1):
                if ws[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    ids.add("" if key is None else str(key))
    runs = []
    for j in sorted(hit):
        if j - 1 in hit:
            runs[-1] = (runs[-1][0], spans[j][1])
        else:
            runs.append(spans[j])
    return len(ws), hit, runs, sorted(ids)


def collocations(rows, longest=5, least=100, top=2000, absorbed=100):
    """``[(lang, rank, phrase, a, l, r, n, score)]`` of ``(lang, text)``."""
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    some = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in some.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                x = (lang, p[i : i + k])
                if 100 * a >= absorbed * f[x]:
                    gone.add(x)
    out = []
    for (lang, p), a in some.items():
        if (lang, p) not in gone:
            cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    out.sort()
    ranks, listed = collections.Counter(), []
    for lang, score, a, p, left, right, n in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            listed.append((lang, ranks[lang], p.decode(), -a, left, right, n, -score))
    return listed


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings(n):
    """``{word: (form, root, n, n_near, form_n)}`` of ``{word: n}``."""
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelling_words(rows):
    """Counts of the words of ``(doc_id, text)`` after the deletions."""
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    """Base spans of each kind by the patterns as they are stated."""

    def passes(kind, span):
        digits = [int(c) for c in span if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in span.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in PERSONAL.items()}
