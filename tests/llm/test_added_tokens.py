"""Operators 3 and 9 and the pipeline's packing against an unmodified tokenizer, on texts with its added token."""

import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import packing, token_store, words
from tessella.llm.common import string_buffers, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "plain text", None, "", "x<|endoftext|><|endoftext|>\n\ny it's", "<|endof", "text|> é", "a͸b \U0003fffd's", "日本 <|endoftext|> é"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def check(texts, library):
    ids, offsets = words.library_encoder(PATH, True)(*string_buffers(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library(text), text


def test_encoder_is_the_unmodified_librarys(library):
    assert library("a <|endoftext|> b") == [64, 220, 50256, 275]
    check(TEXTS, library)


def test_every_code_point(library):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not words.unassigned()[c]]
    texts = ["".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)}{chr(c)} x " for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    ids, offsets = words.library_encoder(PATH, True)(*string_buffers(pa.array(texts)))
    wrong = [hex(points[16 * k]) for k, x in enumerate(texts) if ids[offsets[k] : offsets[k + 1]].tolist() != library(x)]
    assert not wrong


def test_queries(spark, tmp_path, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    packed = sorted((i, crc([*library(t), 0])) for i, t in rows)
    assert sorted((r.doc_id, r.ids_crc32) for r in packing.op3_sum_of_squares(spark, str(tmp_path)).collect()) == packed
    assert sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()) == packed
    start = 0
    for r, (i, t) in zip(sorted(token_store.op9_plane_files(spark, str(tmp_path)).collect(), key=lambda r: r.start), rows, strict=True):
        ids = [*library(t), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)
