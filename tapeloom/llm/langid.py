"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of bits; one linear classifier for each bit reads hashed character n-grams and tells
whether the text's language has that bit. Decoding weighs each bit's logistic loss by how well the bit's classifier
did on the sample, adds the losses of each codeword, and takes the least; the share of the best codeword in the
softmax of negative losses is the score, and a best and a second codeword that are too close flag the text as
ambiguous.

Learning is on a bounded sample: of each language the ``SAMPLE`` texts with the smallest hash of their ids, whole.
Tasks turn them into feature vectors; these are what the driver learns from. Prediction reads every text whole.
A null text or one without a letter gets ``und`` and score 0. Without labelled texts every text gets ``und``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.tables import prepare
from tapeloom.llm.text import chunks

#: Texts of each language to learn from.
SAMPLE = 400
#: Hashed cells of n-grams of each length, and the lengths in bytes of lower-cased text.
CELLS, LENGTHS = 4096, (1, 2, 3, 4)
#: Gradient steps, step size and decay of the bit classifiers.
STEPS, RATE, DECAY = 300, 4.0, 1e-4
#: A best share below this is ambiguous.
CLEAR = 0.6
#: Texts described at once: a row of features takes 64 kB.
ROWS = 256
MULTIPLIER = np.uint32(0x9E3779B1)

#: Bytes as read: A-Z lower-cased, digits and ASCII marks and controls all one blank.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def profile(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row for each text: root shares of its n-grams by cell, lengths side by side. Runs of blanks count once."""
    n = len(at) - 1
    text = FOLD[data]
    owner = np.repeat(np.arange(n), np.diff(at))
    stay = np.ones(len(text), bool)
    stay[1:] = ~((text[1:] == 32) & (text[:-1] == 32))
    text, owner = text[stay].astype(np.uint32), owner[stay]
    out = np.zeros((n, CELLS * len(LENGTHS)), np.float32)
    code = np.zeros(len(text), np.uint32)
    for k, length in enumerate(LENGTHS):
        if len(text) < length:
            break
        code = text.copy() if length == 1 else (code[: len(text) - length + 1] << np.uint32(8)) | text[length - 1 :]
        whole = owner[: len(code)] == owner[length - 1 :]
        cell = ((code * MULTIPLIER) >> np.uint32(20)).astype(np.int64)  # CELLS = 2 ** 12
        place = owner[: len(code)] * CELLS + cell
        counts = np.bincount(place[whole], minlength=n * CELLS).reshape(n, CELLS)
        total = counts.sum(axis=1, keepdims=True)
        out[:, k * CELLS : (k + 1) * CELLS] = np.sqrt(counts / np.maximum(total, 1))
    return out


def codewords(count: int) -> np.ndarray:
    """Bits (+1 or -1) of each of ``count`` classes: all splits in two up to six classes, drawn splits beyond."""
    if count <= 6:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=max(0, count - 1)) if -1 in s]
        return np.array(splits, np.float64).T.reshape(count, -1)
    draw = np.random.default_rng(count)
    bits = 4 * int(np.ceil(np.log2(count))) + 8
    best, width = None, -1
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], size=(count, bits))
        code = code[:, np.abs(code.sum(axis=0)) < count]
        apart = min((code[i] != code[j]).sum() for i in range(count) for j in range(i))
        if apart > width:
            best, width = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and its share."""
        margin = features @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        return share.argmax(axis=1), share.max(axis=1)


def fit(features: np.ndarray, langs: list[str]) -> Model:
    """Logistic classifiers of all bits at once, by full-batch steps with classes of equal weight."""
    names = sorted(set(langs))
    which = np.array([names.index(x) for x in langs], np.int64)
    code = codewords(len(names))
    if len(names) == 1:
        code = np.ones((1, 1))
    target = code[which]
    weight = (1 / np.bincount(which, minlength=len(names)))[which]
    weight /= weight.sum()
    w, b = np.zeros((features.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1])
    for _ in range(STEPS):
        pull = target / (1 + np.exp(np.clip(target * (features @ w + b), -30, 30))) * weight[:, None]
        w += RATE * (features.T @ pull.astype(np.float32) - DECAY * w)
        b += RATE * pull.sum(axis=0)
    right = (weight[:, None] * ((features @ w + b) * target > 0)).sum(axis=0)
    trust = np.maximum(0.05, 2 * right - 1)
    return Model(names, code, w, b, trust / trust.mean())


def sample(docs: DataFrame, learn: Column, size: int, text_col: str, lang_col: str, id_col: str) -> tuple[np.ndarray, list[str]]:
    """Features and languages of at most ``size`` texts of each language."""
    keys = [docs[id_col].cast("string").alias("key"), docs[lang_col].cast("string").alias("lang"), F.xxhash64(docs[id_col], docs[lang_col]).alias("draw")]
    able = docs.where(learn & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    # without texts: cut to a share that surely holds enough, then rank the few that are left
    labelled = able.select(*keys)
    count = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), (4.0 * size + 100.0) / F.col("n"))
    near = labelled.join(count, "lang").where(F.shiftrightunsigned("draw", 1) <= share * float(1 << 63))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key"))
    ids = near.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "key", "draw").distinct()
    texts = able.select(*keys, docs[text_col].cast("string").alias("text"))
    chosen = texts.join(F.broadcast(ids), ["lang", "key", "draw"]).select("lang", "text")  # ``size`` rows for each language

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in chunks(batch.column(1), rows=ROWS):
                rows = profile(data, at).astype(np.float16)
                yield pa.record_batch([batch.column(0).slice(row, len(rows)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "features"])

    got = chosen.mapInArrow(describe, "lang string, features binary").toArrow()
    rows = sorted(zip(got["lang"].to_pylist(), got["features"].to_pylist(), strict=True))
    features = np.stack([np.frombuffer(f, np.float16) for _, f in rows]).astype(np.float32) if rows else np.zeros((0, CELLS * len(LENGTHS)), np.float32)
    return features, [x for x, _ in rows]


def learned(docs: DataFrame, learn: Column, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    features, langs = sample(docs, learn, size, text_col, lang_col, id_col)
    return fit(features, langs) if langs else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for row, data, at in chunks(batch.column(1), rows=ROWS):
                n = len(at) - 1
                texts = pc.fill_null(batch.column(1).slice(row, n), "")
                lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                names, shares = np.full(n, "und", object), np.zeros(n)
                if own is not None and lettered.any():
                    best, share = own.decode(profile(data, at))
                    names[lettered] = np.array(own.languages, object)[best[lettered]]
                    shares[lettered] = share[lettered]
                yield pa.record_batch([batch.column(0).slice(row, n), pa.array(names.tolist(), pa.string()), pa.array(shares), pa.array(lettered & (shares < CLEAR))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def language_digest(docs: DataFrame) -> DataFrame:
    model = learned(docs, ~held_out())
    return identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
