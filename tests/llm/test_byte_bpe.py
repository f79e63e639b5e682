import base64
import hashlib

import plain
import public_tokenizers
import tiktoken

from gaugeline.llm import byte_bpe
from gaugeline.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library(spark, sf_dir, tables):
    library = _library()
    texts = {r.doc_id: r.text or "" for r in tables["documents"].collect()}
    got = {r.doc_id: r for r in QUERIES["op4_byte_bpe"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = library.encode_ordinary(text)
        want = (len(ids), plain.sha(",".join(map(str, ids))), plain.sha(text))
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == want


def test_corner_cases(spark):
    long = "word " * 60_000 + "z" * 30_000
    rows = [(1, None, "k"), (None, "", "k"), (2, "a a", None), (2, "a a", None), (3, long, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = byte_bpe.round_trip(docs, RANKS)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert got[1, None].n_tokens == 0 and got[1, None].ids_sha256 == plain.sha("")
    assert got[None, ""].n_tokens == 0
    assert got[3, long].decoded_sha256 == plain.sha(long)
    assert out.count() == 5
    assert byte_bpe.round_trip(docs.limit(0), RANKS).count() == 0


def test_ids_and_decoding(spark):
    docs = spark.createDataFrame([(1, "héllo wörld"), (2, None)], "doc_id long, text string")
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).orderBy("doc_id").collect()
    assert out[0].ids == _library().encode_ordinary("héllo wörld")
    assert bytes(out[0].decoded) == "héllo wörld".encode()
    assert out[1].ids == [] and bytes(out[1].decoded) == b""
    missing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decode(missing, RANKS).first().decoded) == b""
    assert hashlib.sha256(b"").hexdigest() == plain.sha("")
