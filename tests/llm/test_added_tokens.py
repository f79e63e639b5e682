"""Strings of added tokens in the token files of the query."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gaugeline.llm.queries import QUERIES

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y <|endoftext|", "no token here", None, "it's <|endoftext|> " * 3000]


def test_query_gives_the_ids_of_the_library(spark, tmp_path):
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, str(tmp_path)).collect()}
    assert library.encode(TEXTS[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
