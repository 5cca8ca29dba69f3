"""Operator 5: held-out accuracy, calibration, and the sums against a direct evaluation."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import language
from tessella.llm.common import string_buffers

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs.where(~language.fold(F.col("doc_id"))))


def test_held_out_accuracy(spark, docs):
    got = language.op5_subword_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang is not None]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    taken = [r for r in held if r.accepted]
    assert len(taken) > 0.8 * len(held) and np.mean([r.lang_pred == r.lang for r in taken]) > 0.98


def test_sums_by_definition(model):
    texts = ["", "a", "The thing, and the", "été déjà là", "x" * 3000, "12 34"]
    offsets, data = string_buffers(pa.array(texts))
    got = model.logits(offsets, data)
    table = language.byte_map()
    for k, text in enumerate(texts):
        padded = [32] * 3 + [int(table[b]) for b in text.encode()] + [32] * 3
        shift, total = 17, np.zeros(len(model.languages))
        for at in range(2, 2 + len(text.encode()) + 1):
            three = padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16
            four = three | (padded[at + 3] if at + 3 < len(padded) else 32) << 24
            a = (three * 2654435761 & 0xFFFFFFFF) >> shift
            b = ((four ^ four >> 15) * 2246822519 & 0xFFFFFFFF) >> shift
            total += model.weights[:, a].astype(float) + model.weights[:, b]
        assert np.allclose(got[k], total / (2 * (len(text.encode()) + 1) * language.POINT) + model.bias)
        alone = model.logits(*string_buffers(pa.array([text])))
        assert (alone[0] == got[k]).all()


def test_rows_without_letters(spark, model):
    rows = [(1, None), (2, ""), (3, "12 + 34 _ ?"), (4, "é"), (4, "é"), (None, "the"), (5, "?" * 5000 + "a"), (6, "\U0001d7d8 ½ ²")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, lang_pred string, id int")
    got = {r.id: (r.lang_pred, r.score) for r in language.predict(df, model).collect()}
    assert got[1] == got[2] == got[3] == got[6] == ("und", 0.0)
    assert got[4][0] in model.languages and got[5][0] in model.languages and got[None][0] in model.languages
    assert language.predict(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(df, None).collect()} == {"und"}
    assert language.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def test_labels_decide(spark):
    df = spark.createDataFrame([(i, "aba bab abba" if i % 2 else "xyz zyx yxz", "A" if i % 2 else None) for i in range(60)], "doc_id long, text string, lang string")
    assert language.fit(df).languages == ["A"]
