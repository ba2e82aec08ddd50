"""Texts that hold the tokenizer's special tokens, against the plain call with its defaults."""

import zlib

import numpy as np

from scanwarden.llm import packing
from scanwarden.llm.queries import QUERIES

TEXTS = ["one <|endoftext|> two", "<|startoftext|>Alpha beta", "x<|endoftext|><|startoftext|>y", "One <|ENDOFTEXT|> two", "É one <|endoftext|> " + "word " * 3000,
         "one two", "<|endoftext|>", "< |endoftext|> it's 12", None, ""]


def test_packing_query_knows_special_tokens(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = packing.Tokenizer.from_file(packing.TOKENIZER)
    want = []
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4")
            want.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    got = QUERIES["op5_best_fit_packing"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
