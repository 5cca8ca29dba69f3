"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 5).

A text is a bag of hashed 3- and 4-byte pieces of its lower-cased letters, with blanks where words end. Its vector is
the mean of the pieces' embeddings; a linear softmax over the learned languages follows. Embeddings and weights are
trained in numpy by stochastic gradient descent on a bounded sample of labelled rows. On a fold of the sample kept out
of the training, a temperature makes probabilities honest, and a threshold is set so that the accepted predictions of
that fold have at most MAX_ERROR errors; `accepted` says whether a score reaches it.

For prediction the two layers are multiplied out to one weight per piece and language, as integers, so a text's score
is an exact sum that doesn't depend on how rows are batched.

Defined results: lang_pred is `und` with score 0 where the text is null or has no letter, or where there was nothing to
learn from; rows without a language are never learned from; held_out is null for a null id; equal texts get equal
predictions; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship, slices, string_buffers

#: Labelled rows in the sample (as expected over all languages), and languages at most.
SAMPLE_ROWS, MOST_LANGUAGES = 2400, 200
BUCKETS, DIM, EPOCHS, RATE, MAX_ERROR, PAD = 1 << 15, 16, 12, 2.0, 0.01, 3
POINT = 1 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@functools.cache
def byte_map() -> np.ndarray:
    """Lower-case ASCII letters and all bytes from 128; everything else is a blank."""
    out = np.full(256, 32, np.uint32)
    out[128:] = np.arange(128, 256)
    for b in range(ord("a"), ord("z") + 1):
        out[b] = out[b - 32] = b
    return out


def pieces(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the pieces of 3 and of 4 bytes at each place of the padded texts, and where each text's places begin."""
    n = len(offsets) - 1
    padded = np.full(len(data) + PAD * (n + 2), 32, np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + PAD * (row + 1)] = byte_map()[data]
    three = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16)
    four = three | padded[3:] << np.uint32(24)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    first = offsets[:-1] + PAD * np.arange(1, n + 1) - 1
    return three * np.uint32(2654435761) >> shift, (four ^ four >> np.uint32(15)) * np.uint32(2246822519) >> shift, first


def bags(offsets: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    a, b, first = pieces(offsets, data)
    out = []
    for at, n in zip(first.tolist(), (np.diff(offsets) + 1).tolist(), strict=True):
        seen, count = np.unique(np.concatenate([a[at : at + n], b[at : at + n]]), return_counts=True)
        out.append((seen.astype(np.int32), (count / (2 * n)).astype(np.float32)))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets, times POINT
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        a, b, first = pieces(offsets, data)
        n = np.diff(offsets) + 1
        bounds = np.stack([first, first + n], 1).ravel()
        out = np.empty((len(n), len(self.languages)))
        for k, w in enumerate(self.weights):
            sums = np.add.reduceat(w[a].astype(np.int64) + w[b], bounds)[::2] if len(n) else np.zeros(0)
            out[:, k] = sums / (2 * n * POINT) + self.bias[k]
        return out

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        return softmax(self.logits(offsets, data) / self.temperature)


def train(samples: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> Model:
    """samples: buckets, shares and language of each labelled text. Every fifth is kept for calibration."""
    languages = sorted({lang for _, _, lang in samples})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held = order[::5] if len(samples) >= 50 else order[:0]
    taught = np.setdiff1d(order, held)
    target = np.array([languages.index(lang) for _, _, lang in samples], int)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float64)
    weights, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    steps, step = max(1, EPOCHS * len(taught)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(taught):
            rate = RATE * (1 - step / steps)
            step += 1
            seen, share, _ = samples[i]
            rows = embed[seen]
            vector = share @ rows
            error = softmax(vector @ weights + bias)
            error[target[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(vector, error)
            bias -= 0.1 * rate * error
            embed[seen] = rows - rate * len(seen) ** 0.5 * np.outer(share, back)
    joint = (embed @ weights).T
    model = Model(languages, np.clip(np.rint(joint * POINT), -(1 << 30), 1 << 30).astype(np.int32), bias)
    if len(held):
        z = np.stack([(model.weights[:, samples[i][0]] @ samples[i][1].astype(np.float64)) / POINT + bias for i in held])
        truth = target[held]
        at = np.arange(len(held))
        goal = np.full(z.shape, 1 / (len(held) + 2) / z.shape[1])  # smoothed, so that a fold without errors doesn't make it sure
        goal[at, truth] += 1 - goal.sum(1)
        losses = {t: -(goal * np.log(softmax(z / t) + 1e-300)).sum(1).mean() for t in np.geomspace(0.05, 20, 60)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(z / model.temperature)
        best, wrong = p.max(1), p.argmax(1) != truth
        by = np.argsort(-best, kind="stable")
        error = np.cumsum(wrong[by]) / np.arange(1, len(by) + 1)
        fine = np.flatnonzero(error <= MAX_ERROR)
        model.threshold = float(best[by][fine[-1]]) if len(fine) else 1.0
    return model


def sample(labelled: DataFrame, *, id_col: str, text_col: str, lang_col: str, rows: int) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Bags of about `rows` labelled texts, spread evenly over the languages by a hash of the id. Bags are made on the
    executors from whole texts; what comes to the driver is bounded by rows x distinct buckets."""
    ship(labelled.sparkSession)
    table = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = table.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return []
    wanted = rows / len(counts)
    point = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    taken = F.lit(False)
    for lang, n in counts:
        taken = taken | ((F.col("lang") == lang) & (point < int(min(1.0, wanted / n) * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = bags(*string_buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([b.tobytes() for _, b in got], pa.binary())], ["id", "lang", "seen", "share"])

    got = table.where(taken).select(F.col("id").cast("string").alias("id"), "text", "lang").mapInArrow(run, "id string, lang string, seen binary, share binary").collect()
    got.sort(key=lambda r: (r.id or "", bytes(r.seen), bytes(r.share), r.lang))
    return [(np.frombuffer(r.seen, np.int32), np.frombuffer(r.share, np.float32), r.lang) for r in got]


def predict(df: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, accepted for every row; only the text is looked at."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                offsets, data = string_buffers(part.column("text"))
                raw, ends = data.tobytes(), offsets.tolist()
                known = np.array([has_letter(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], bool)
                names, score, accepted = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
                if model and known.any():
                    p = model.scores(offsets, data)
                    best = p.argmax(1)
                    names[known] = np.array(model.languages, object)[best[known]]
                    score[known] = p[np.arange(n), best][known]
                    accepted = known & (score >= model.threshold)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], ["id", "lang_pred", "score", "accepted"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, accepted boolean")


def has_letter(text: bytes) -> bool:
    for i in range(0, len(text), 4096):
        # a letter stands near the start of nearly every text; a window may cut a character, which "ignore" passes over
        if LETTER.search(text[max(0, i - 3) : i + 4099].decode("utf-8", "ignore")):
            return True
    return False


def fold(doc_id: Column) -> Column:
    """True for the rows that are held out of the learning."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model | None:
    got = sample(df, id_col=id_col, text_col=text_col, lang_col=lang_col, rows=rows)
    return train(got) if got else None


def op5_subword_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~fold(F.col("doc_id"))))
    rows = predict(docs, model).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
