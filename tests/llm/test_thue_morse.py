"""Texts on which hashes that are sums of terms by place agree: Thue-Morse words and their complements."""

import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from gaugeline.llm import byte_bpe, line_dedup, ngram_join, substring_dedup, token_files, words

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n, zero, one):
    return [one if i.bit_count() % 2 else zero for i in range(n)]


def _two(n, zero="a", one="b", between=""):
    return between.join(thue_morse(n, zero, one)), between.join(thue_morse(n, one, zero))


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096, 8192])
def test_hashes_differ(n):
    data = np.frombuffer("".join(_two(n)).encode(), np.uint8)
    a, b = words.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert a != b
    runs = words.run_hashes(words.mix(data.astype(np.uint64)), np.array([0, n]), np.array([n, 2 * n]))
    assert runs[0] != runs[1]


@pytest.mark.parametrize("n", [1024, 8192])
def test_token_ids_are_the_libraries(spark, tmp_path, n):
    a, b = _two(n)
    texts = [f"{a} {b}", a, f"so {b} {a}"]
    ranks = load_tiktoken_bpe(RANKS)
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip(_frame(spark, texts), RANKS).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids_sha256 == plain.sha(",".join(map(str, library.encode_ordinary(t))))
        assert got[i].decoded_sha256 == plain.sha(t)
    other = Tokenizer.from_file(JSON)
    folder = str(tmp_path / "files")
    token_files.write(_frame(spark, texts), folder, JSON, added_tokens=True)
    crc = {r.doc_id: r.ids_crc32 for r in token_files.digests(spark, folder).collect()}
    for i, t in enumerate(texts):
        ids = [*other.encode(t, add_special_tokens=False).ids, 0]
        assert crc[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n", [1024, 8192])
def test_repeats_are_of_equal_words(spark, n):
    a, b = _two(n)
    head = " ".join(f"w{i}" for i in range(34))
    texts = [f"{head} {a}", f"{head} {b}", f"{a} {head}"]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(_frame(spark, texts)).collect()}
    assert got == {i: r for i, (_, r, _) in enumerate(plain.substring_removed(texts, 35))} == {0: 0, 1: 0, 2: 0}
    got = {r.doc_id: r.n_deleted for r in line_dedup.delete_repeats(_frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0}


def test_runs_are_of_equal_lines(spark):
    blanks = _two(1024, " ", "\t", "\n")
    texts = [f"one two\n{x}\nthree four five six seven eight nine ten" for x in blanks]
    got = {r.doc_id: r.n_deleted for r in line_dedup.delete_repeats(_frame(spark, texts), min_words=10).collect()}
    assert got == {0: 0, 1: 0}


def test_grams_are_of_equal_words(spark):
    a, b = _two(1024)
    texts = [f"{a} one two three four", f"{b} one two three four", f"{a} one two three four"]
    got = {r.id: (r.class_id, r.n_links) for r in ngram_join.link(_frame(spark, texts)).collect()}
    assert got == {0: (0, 1), 1: (1, 0), 2: (0, 1)}
