"""Language identification with error-correcting output codes.

Each language has a codeword of bits; one binary classifier per bit reads hashed byte n-grams. A text goes to the
language whose codeword has the smallest loss against the classifiers' margins, bits weighted by how well they are
predicted; a small lead over the second best flags the answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, text_blocks

DIM, GRAMS, BITS = 4096, (1, 2, 3), 15
#: Bounds of the training sample: so many texts in all, spread evenly over the languages, and where there are very many
#: languages so many of each.
SAMPLE, LEAST = 4000, 4
STEPS, RATE, AMBIGUOUS = 150, 0.05, 0.2


def _letters() -> np.ndarray:
    """Bytes as the classifiers see them: ASCII letters in lower case, other ASCII characters as spaces."""
    t = np.full(256, 32, np.uint8)
    for b in range(128, 256):
        t[b] = b
    for b in range(97, 123):
        t[b] = t[b - 32] = b
    return t


def _features(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of hashed n-gram counts, one row per text."""
    texts = len(offsets) - 1
    x = table[data].astype(np.uint32)
    doc = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offsets))
    counts = np.zeros(texts * DIM, np.float32)
    gram = np.zeros(len(x), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(x) < n:
            break
        gram = gram[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :]
        if n in GRAMS:
            same = doc[: len(gram)] == doc[n - 1 :]
            h = (gram + np.uint32(n)) * np.uint32(2654435761)
            at = doc[: len(gram)] * DIM + (h >> np.uint32(32 - 12)).astype(np.int64)
            counts += np.bincount(at[same], minlength=texts * DIM).astype(np.float32)
    rows = np.sqrt(counts.reshape(texts, DIM))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def codebook(classes: int, bits: int = BITS) -> np.ndarray:
    """Codewords of +1 and -1 with the largest smallest distance among random draws; every bit splits the classes."""
    rng = np.random.default_rng(9)
    bits = max(bits, 4 * int(np.ceil(np.log2(max(classes, 2)))))
    best, far = None, -1
    # Random words of such length hardly ever meet, so with many classes one draw will do.
    for _ in range(max(1, min(300, 10**7 // classes**2))):
        book = np.where(rng.random((classes, bits)) < 0.5, -1, 1)
        flat = np.abs(book.sum(axis=0)) == classes
        if classes > 1:
            book[rng.integers(0, classes, bits)[flat], np.flatnonzero(flat)] *= -1
        if classes > 3000:
            return book
        gaps = (bits - book @ book.T) // 2 + bits * np.eye(classes, dtype=int)
        if gaps.min() > far:
            best, far = book, gaps.min()
    return best


@dataclass
class OutputCodes:
    languages: list[str]
    book: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, probability and whether the answer is ambiguous."""
        margin = 4 * np.tanh((x @ self.weights + self.bias) / 4)
        # A bit costs a codeword the one of two losses that its sign selects.
        up, down = np.logaddexp(0, -margin) * self.trust, np.logaddexp(0, margin) * self.trust
        loss = up @ (self.book > 0).T + down @ (self.book < 0).T
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        lead = top[:, -1] - top[:, -2] if p.shape[1] > 1 else np.ones(len(p))
        return loss.argmin(axis=1), p.max(axis=1), lead < AMBIGUOUS


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> OutputCodes:
    """Train all bits' logistic classifiers together."""
    book = codebook(len(languages))
    goal = book[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], book.shape[1]), np.float32), np.zeros(book.shape[1], np.float32)
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, STEPS + 1):
        g = -goal / (1 + np.exp(goal * (x @ w + b))) / len(x)
        for value, grad, a, s in ((w, x.T @ g + 1e-7 * w, m[0], m[1]), (b, g.sum(axis=0), m[2], m[3])):
            a += 0.1 * (grad - a)
            s += 0.01 * (grad**2 - s)
            value -= RATE * 5 * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    right = ((x @ w + b) * goal > 0).mean(axis=0).clip(0.51, 0.999)
    trust = np.log(right / (1 - right))
    return OutputCodes(languages, book, w, b, trust / trust.mean())


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _letters()
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(1), 256):
            rows = _features(data, offsets, table).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "lang", "x"]
            )


def train(docs: DataFrame, held_out) -> OutputCodes | None:
    """Fit on a sample of documents with a language that are not held out; None where there is no such document.

    Every value of lang is learned: SAMPLE texts are spread evenly over the languages, and where that leaves less than
    LEAST of each, LEAST of each are taken. The driver holds these as rows of 8 kB: 4,000 of them, or LEAST times the
    number of languages where there are more than 1,000. A hash of doc_id and text draws a few more than wanted, counted by
    distinct hashes, since repeated rows share one, and always a language's first; the first of each language by that hash
    are taken, a repeated row once.
    """
    rows = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~held_out & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text"))
    place = F.pmod("draw", F.lit(1 << 40))
    counts = rows.select("lang", "draw").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.min(place).alias("foremost"))
    counts = stage(counts, "languages")
    languages = counts.count()
    if not languages:
        return None
    each = max(SAMPLE // languages, LEAST)
    drawn = each + 4 * each**0.5 + 10
    rows = rows.join(counts, "lang").filter((place < F.lit(drawn * (1 << 40)) / F.col("texts")) | (place == F.col("foremost")))
    rows = rows.groupBy("lang", "draw", "doc_id").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    rows = rows.withColumn("first", first).filter(F.col("first") <= each).select("doc_id", "text", "lang")
    chosen = rows.mapInArrow(_feature_batches, "doc_id long, lang string, x binary").orderBy("lang", "doc_id", "x").collect()
    names = sorted({r["lang"] for r in chosen})
    of = {name: i for i, name in enumerate(names)}
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in chosen]).astype(np.float32)
    return fit(x, np.array([of[r["lang"]] for r in chosen]), names)


def _predict_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value, _letters()
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1), 256):
                if model is None:
                    names, p, unsure = ["und"] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
                else:
                    best, p, unsure = model.predict(_features(data, offsets, table))
                    names = [model.languages[i] for i in best]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(np.round(p, 6).astype(np.float64)), pa.array(unsure)],
                    ["doc_id", "letters", "lang", "p", "unsure"],
                )

    return run


def identify(docs: DataFrame, mod: int = 3, left: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    Predictions read the text only; languages are learned from documents that are not held out. lang_pred is ``und``
    with score 0 where the text is null or has no letter, or where nothing could be learned. Null doc_id is not held
    out and never a training row. Rows that repeat a doc_id are predicted one by one. Texts of any length are read
    whole, blocks of about 500 kB at a time. Extra columns are ignored; an empty table gives an empty table.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == left, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, held))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", F.lower(text).alias("text"), text.rlike(r"\p{L}").alias("letters"))
    found = texts.mapInArrow(_predict_batches(model), "doc_id long, letters boolean, lang string, p double, unsure boolean")
    return found.select(
        "doc_id",
        held.alias("held_out"),
        F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"),
        (F.col("unsure") | ~F.col("letters")).alias("ambiguous"),
    )
