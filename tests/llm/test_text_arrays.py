import base64
import random

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from gaugeline.llm import byte_bpe, pieces, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _texts(n, alphabet="ab cé\n\t\x0b\x0c\r  中x", seed=1):
    draw = random.Random(seed)
    return [None, "", " ", "\n", "a", *("".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(n))]


def test_words_and_lines_match_plain_splits():
    texts = _texts(500)
    data, offsets = words.text_bytes(pa.array(texts))
    for finder, split in ((words.word_spans, plain.words), (words.line_spans, lambda t: (t or "").split("\n"))):
        starts, ends, first = finder(data, offsets)
        got = [[data[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]
        assert got == [split(t) for t in texts]


def test_sliced_arrays_keep_their_texts():
    texts = pa.array(["zero", None, "one two", "é", "three"])
    data, offsets = words.text_bytes(texts.slice(2, 2))
    assert data.tobytes().decode() == "one twoé" and offsets.tolist() == [0, 7, 9]


def test_hashes_depend_on_content_only():
    texts = ["aa bb aa", "cc aa", "x" * 3_000_000 + " aa"]
    data, offsets = words.text_bytes(pa.array(texts))
    starts, ends, first = words.word_spans(data, offsets)
    hashes = words.span_hashes(data, starts, ends)
    said = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(said)) == len(set(hashes.tolist()))
    assert hashes[0] == hashes[2] == hashes[4] == hashes[6]


def test_grams_stay_within_their_text():
    texts = ["a b c d", "b", "c d", "a b c", None, "b c d"]
    data, offsets = words.text_bytes(pa.array(texts))
    starts, ends, first = words.word_spans(data, offsets)
    grams, at = words.gram_hashes(words.span_hashes(data, starts, ends), first, 3)
    want = [tuple(plain.words(t)[i : i + 3]) for t in texts for i in range(len(plain.words(t)) - 2)]
    assert len(at) == len(want)
    names = {}
    for g, w in zip(grams.tolist(), want, strict=True):
        assert names.setdefault(w, g) == g
    assert len(set(names.values())) == len(names)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(library):
    texts = _texts(3000, "ab 'stredvlm\n\t !?1²½é中　\u0085 \x1cᲉ😀ǅ​'", 5)
    texts += ["x" * 5000, "ab" * 3000, "é" * 300, " " * 1000, "'s't", "it's we'll ' 've\n'd", "<|endoftext|>"]
    got = list(pieces.encoded(pa.array(texts), byte_bpe.coder(RANKS)))
    assert [g.tolist() for g in got] == [library.encode_ordinary(t or "") for t in texts]


def test_both_trees_agree(library):
    draw = random.Random(2)
    some = [bytes(draw.choice(b"abcdeft \xc3\xa9") for _ in range(draw.randint(2, 64))) for _ in range(400)]
    ranks = byte_bpe.load(RANKS)
    abreast = byte_bpe.merge_abreast(ranks, some, 64)
    for piece, ids in zip(some, abreast, strict=True):
        assert ids.tolist() == byte_bpe.merge_alone(ranks, piece)
        assert b"".join(ranks.tokens[i] for i in ids) == piece


def test_forgetting_changes_nothing():
    texts = pa.array(_texts(300, seed=9))
    ranks = byte_bpe.load(RANKS)
    small = pieces.PieceCoder(lambda p: byte_bpe.encode_pieces(ranks, p), remembered=5)
    for _ in range(3):
        assert [x.tolist() for x in pieces.encoded(texts, small)] == [x.tolist() for x in pieces.encoded(texts, byte_bpe.coder(RANKS))]


def test_groups_of_texts_do_not_change_ids(monkeypatch):
    texts = pa.array(_texts(200, seed=4))
    whole = [x.tolist() for x in pieces.encoded(texts, byte_bpe.coder(RANKS))]
    monkeypatch.setattr(pieces, "GROUP_BYTES", 16)
    assert [x.tolist() for x in pieces.encoded(texts, byte_bpe.coder(RANKS))] == whole


def test_covered():
    assert words.covered(np.array([1, 3]), 2, 6).tolist() == [False, True, True, True, True, False]
