import random
import re
import time

import plain
import pytest

from gaugeline.llm import pii
from gaugeline.llm.queries import QUERIES


def test_base_patterns():
    text = "a.b@x.org, x@y +1 (274) 555-9629, 10.0.0.255; 10.0.0.256; 4111 1111 1111 1111 é 4111111111111112 a +12 345"
    found = {k: [text[a:b] for a, b in v] for k, v in pii.base_spans(text).items()}
    assert found == {"email": ["a.b@x.org"], "ip": ["10.0.0.255"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (274) 555-9629"]}
    # one failing match is dropped whole: nothing inside it is tried again
    assert pii.base_spans("12 4111 1111 1111 1111 345")["card"] == []
    assert pii.base_spans("1.2.3.4.5.6.7.8")["ip"] == [(0, 7), (8, 15)]
    assert pii.base_spans("00001.2.3.4 1.2.3.99999999999999999999999")["ip"] == [(0, 11)]


def test_query_base(spark, sf_dir, tables):
    texts = {r.doc_id: r.text or "" for r in tables["documents"].collect()}
    total = 0
    for r in QUERIES["op2_pii"](spark, sf_dir).collect():
        base = plain.personal(texts[r.doc_id])
        listed = sorted((a, pii.KINDS.index(k), f"{k}:{a}:{b}") for k in pii.KINDS for a, b in base[k])
        assert r.base_sha256 == plain.sha(",".join(x for *_, x in listed))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert {x for *_, x in listed} <= set(spans) and len(spans) == len(listed) + r.n_added
        assert all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(texts[r.doc_id]) for s in spans)
        total += len(listed)
    assert total


def _person(draw):
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    name = "".join(draw.choice("abcdefgh") for _ in range(6))
    return {
        "email": f"{name}.{digits(2)}@mail{digits(1)}.example.com", "phone": f"+1 ({digits(3)}) 555-{digits(4)}",
        "ip": ".".join(str(draw.randint(1, 254)) for _ in range(4)),
    }


def _corpus(draw, n):
    out = []
    for _ in range(n):
        p = _person(draw)
        filler = " ".join("".join(draw.choice("abcdefghijk") for _ in range(5)) for _ in range(8))
        out.append(f"{filler} {draw.choice(list(p.values()))} {filler} {draw.randint(0, 10**9)} {filler}")
    return out


def test_field_adds_what_patterns_miss():
    draw = random.Random(4)
    parts = [t[a:b] for t in _corpus(draw, 240) for a, b in pii.regions(t)]
    weights = pii.train(parts)
    hits = missed = wrong = 0
    for t in _corpus(draw, 150):
        wrong += len(pii.added_spans(t, weights, pii.base_spans(t)))
        p = _person(draw)
        local, domain = p["email"].split("@")
        for kind, span in (("email", f"{local} [at] {domain.replace('.', ' [dot] ')}"), ("phone", "00" + p["phone"][1:])):
            text = f"some words before {span} and after"
            got = pii.added_spans(text, weights, pii.base_spans(text))
            good = (18, 18 + len(span), kind) in got
            hits, missed = hits + good, missed + (not good)
    assert hits / (hits + missed) > 0.9 and wrong / 150 < 0.1


def test_gradient_matches_differences():
    import numpy as np

    part = "call 00 1 274 555 9629 or 10.0.0.1 now"
    cut = pii.atoms(part)
    segments = pii.candidates(part, cut)
    i, j, _ = segments[len(segments) // 2]
    gold = {(i, j, 3)}
    weights = np.random.default_rng(0).normal(size=(len(pii.KINDS), pii.FEATURES)) * 0.1
    step, _ = pii.gradient(weights, len(cut), segments, gold)
    for k, f in ((3, 0), (0, 10), (3, 19)):
        up, down = weights.copy(), weights.copy()
        up[k, f] += 1e-5
        down[k, f] -= 1e-5
        slope = (pii.gradient(up, len(cut), segments, gold)[1] - pii.gradient(down, len(cut), segments, gold)[1]) / 2e-5
        assert step[k, f] == pytest.approx(slope, abs=1e-5)


def test_viterbi_is_the_best_segmentation():
    import numpy as np

    part = "a 12 34 56 78 +1 b"
    cut = pii.atoms(part)
    draw = np.random.default_rng(1)
    segments = [(i, j, draw.normal(size=pii.FEATURES)) for i in range(len(cut)) for j in range(i + 1, min(len(cut), i + 4) + 1)]
    weights = draw.normal(size=(len(pii.KINDS), pii.FEATURES)) * 0.2

    def best(at):
        if at == len(cut):
            return 0.0
        return max([best(at + 1)] + [float((weights @ x).max()) + best(j) for i, j, x in segments if i == at])

    scores = {(i, j): weights @ x for i, j, x in segments}
    got = pii.viterbi(weights, len(cut), segments)
    assert sum(scores[i, j][k] for i, j, k in got) == pytest.approx(best(0))
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_corner_cases(spark):
    import numpy as np

    long = "x " * 100_000 + "me@site.org " + "7" * 5000
    rows = [(1, None, 1), (None, "", 2), (2, "me@site.org me@site.org", 3), (2, "me@site.org me@site.org", 3), (3, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_EMAIL int")
    weights = np.zeros((len(pii.KINDS), pii.FEATURES))
    weights[:, 0] = -9
    out = pii.find(docs, weights=weights)
    assert "N_EMAIL" not in out.columns and out.columns[:2] == ["doc_id", "text"]
    got = sorted((r.doc_id or 0, r.n_email, [(s.start, s.end) for s in r.spans]) for r in out.collect())
    two = (2, 2, [(0, 11), (12, 23)])
    assert got == [(0, 0, []), (1, 0, []), two, two, (3, 1, [(200_000, 200_011)])]
    masked = {(r.doc_id, r.text) for r in pii.mask(docs.where("doc_id < 3 or doc_id is null"), weights=weights).collect()}
    assert masked == {(1, None), (None, ""), (2, "<email> <email>")}
    assert pii.find(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "no data here")], "doc_id long, text string")
    assert pii.find(nothing).first().spans == []


def _noise(draw, n):
    pieces = ["@", " @ ", "[at]", "( at )", "{dot}", " [dot] ", "+", "((", "1", "12", "1234567", "555-9629", ".", " ", "-", "a", "bc", "x.y", "é", "10.0.0.1", "4111 1111 1111 1111", "+1 274 555 9629", "\n", "%"]
    return "".join(draw.choice(pieces) for _ in range(n))


def test_base_spans_equal_the_patterns():
    draw = random.Random(11)
    for _ in range(4000):
        text = _noise(draw, draw.randint(0, 30))
        assert pii.base_spans(text) == plain.personal(text), text


def test_marks_equal_one_pattern():
    pattern = re.compile(
        r"[A-Za-z0-9._%+-]+ ?(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]+)*"
        r"|[+(]*[0-9](?:[ ().+/-]{0,3}[0-9]){6,}"
    )
    draw = random.Random(12)
    for _ in range(6000):
        text = _noise(draw, draw.randint(0, 30))
        assert list(pii.marks(text)) == [m.span() for m in pattern.finditer(text)], text


@pytest.mark.parametrize("unit", ["a", "7", "me@site.org ", "(", "+", "1.", "a.", "a@", "@", "1 - "])
def test_time_is_linear(unit):
    weights = pii.train([])
    took = []
    for n in (1_000_000, 2_000_000) if unit not in ("1 - ", "a@", "@") else (10_000, 20_000):
        text = unit * (n // len(unit))
        start = time.time()
        base = pii.base_spans(text)
        pii.added_spans(text, weights, base)
        took.append(time.time() - start)
    assert took[1] < 3 * took[0] + 1 and took[1] < 20


def test_masking_keeps_a_column_of_its_helper_name(spark):
    import numpy as np

    weights = np.zeros((len(pii.KINDS), pii.FEATURES))
    weights[:, 0] = -9
    docs = spark.createDataFrame([(1, "me@site.org", "kept")], "doc_id long, text string, masked string")
    assert pii.mask(docs, weights=weights).select("text", "masked").first() == ("<email>", "kept")
