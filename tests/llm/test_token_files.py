import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeline.llm import token_files
from gaugeline.llm.queries import QUERIES
from gaugeline.sources.tables import fresh_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def test_query(spark, sf_dir, tables):
    encode, start = _library(), 0
    got = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, sf_dir).collect()}
    for r in tables["documents"].orderBy("doc_id").collect():
        ids = encode(r.text)
        want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == want
        start += len(ids)


@pytest.fixture(scope="module")
def folder(spark):
    rows = [(3, "three words here", "x"), (None, "no id", "y"), (1, None, "z"), (2, "", None), (3, "three words here", "x"), (4, "it's <|endoftext|> " * 9000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = fresh_path(spark, "test-tokens")
    token_files.write(docs, out, VOCABULARY)
    return out


def test_corner_cases(spark, folder):
    encode = _library()
    got = sorted(((r.key is not None, r.key, r.ids) for r in token_files.read(spark, folder).collect()), key=str)
    want = [(False, None, encode("no id")), (True, 1, [0]), (True, 2, [0]), (True, 3, encode("three words here"))]
    assert [g for g in got if g[1] != 4] == sorted([*want, want[-1]], key=str)
    assert [g[2] for g in got if g[1] == 4] == [encode("it's <|endoftext|> " * 9000)]
    starts = sorted((r.start, r.n_tokens) for r in token_files.digests(spark, folder).collect())
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(6)]


def test_index_reads_single_frames(spark, folder):
    picked = token_files.shuffled(spark, folder, 3, seed=1)
    assert {r.shard for r in picked.collect()} <= {0, 1, 2}
    some = token_files.read_picked(spark, folder, picked.where("key = 3 or key is null")).collect()
    encode = _library()
    assert sorted((r.key or 0, r.ids) for r in some) == [(0, encode("no id")), (3, encode("three words here")), (3, encode("three words here"))]


def test_empty_table(spark):
    out = fresh_path(spark, "test-tokens")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), out, VOCABULARY)
    assert token_files.digests(spark, out).count() == 0 and token_files.read(spark, out).count() == 0


def test_damage_is_found():
    record = token_files.pack(7, np.arange(5, dtype=np.uint32), 2) + b"\n"
    ((_, whole),) = token_files.frames(record * 1)
    assert token_files.unpack(whole)[0] == 7 and token_files.unpack(whole)[1].tolist() == [0, 1, 2, 3, 4]
    for at in range(len(record)):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_files.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_files.frames(record[:-3]))
    wide = token_files.pack(None, np.array([70_000]), 4) + b"\n"
    ((_, whole),) = token_files.frames(wide)
    assert token_files.unpack(whole)[0] is None and token_files.unpack(whole)[1].tolist() == [70_000]
