"""Language identification by a string kernel with Nyström landmarks and ridge regression.

A text is the set of its hashed character n-grams of one to three letters (a
blended spectrum, presence only).  The kernel of two texts is the number of common
n-grams over the geometric mean of their sizes.  Landmarks, drawn from the labelled
sample, map every text to a short vector; one ridge regression per language against
the rest is solved there.  A prediction is then two matrix products per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reqsift.llm.common import whole_text

BINS = 1 << 14
GRAMS = 3
#: Bounds of the labelled sample that the classifier is fitted on (expected number of
#: distinct texts; of each language at least ``LEAST``), and of its landmarks.
SAMPLE, LEAST, LANDMARKS = 2048, 32, 192
RIDGE = 1e-3
UNKNOWN = "und"
_SLICE = 1 << 20


def presence(text: str) -> np.ndarray:
    """Which of the ``BINS`` hashed n-grams occur anywhere in the text."""
    seen = np.zeros(BINS, dtype=bool)
    text = text.lower()
    for begin in range(0, len(text), _SLICE):
        part = text[begin : begin + _SLICE + GRAMS - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        state = np.zeros(len(codes), dtype=np.uint32)
        for n in range(GRAMS):
            if len(codes) <= n:
                break
            state = (state[: len(codes) - n] + codes[n:]) * np.uint32(0x9E3779B1)
            state ^= state >> np.uint32(15)
            seen[state & np.uint32(BINS - 1)] = True
    return seen


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """Landmarks as packed bits, and what turns kernel values into one score per language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """One row of one-versus-rest scores per row of presence bits."""
        return self._kernel(seen) @ self.weights

    def _kernel(self, seen: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_marks"):
            marks = np.unpackbits(self.landmarks, axis=1, count=BINS).astype(np.float32)
            self._marks = marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
        x = seen.astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x @ self._marks.T

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i in range(0, len(texts), 64):
            part = texts[i : i + 64]
            if not self.languages:
                names += [UNKNOWN] * len(part)
                scores += [0.0] * len(part)
                continue
            found = self.scores(np.stack([presence(t) for t in part]))
            best = found.argmax(1)
            for text, k, s in zip(part, best.tolist(), found[np.arange(len(part)), best].tolist()):
                known = has_letter(text)
                names.append(self.languages[k] if known else UNKNOWN)
                scores.append(min(1.0, max(0.0, (1 + s) / 2)) if known else 0.0)
        return names, scores


def fit(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """A model from ``labelled(text, lang)``; rows without a language are left out.

    The sample is drawn by a hash of the text, with equal shares of the languages, so
    copies count once and no source dominates.  It alone comes to the driver, as bits.
    """
    rows = labelled.filter(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), whole_text(F.col("text")).alias("text")
    ).withColumn("key", F.xxhash64("text"))
    texts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not texts:
        return Model([], np.zeros((0, BINS // 8), np.uint8), np.zeros((0, 0)))
    share = max(LEAST, sample // len(texts))
    rate = F.lit(0.0)
    for lang, n in texts.items():
        rate = F.when(F.col("lang") == lang, F.lit(1.1 * share / max(n, 1))).otherwise(rate)
    chosen = rows.filter(F.pmod("key", F.lit(1 << 30)) < rate * (1 << 30)).dropDuplicates(["lang", "key"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(presence(t.as_py())).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                names=["lang", "key", "bits"],
            )

    drawn = sorted(
        chosen.select("lang", "key", "text").mapInArrow(bits, "lang string, key long, bits binary").collect()
    )
    languages = sorted(texts)
    at = {lang: i for i, lang in enumerate(languages)}
    seen = np.frombuffer(b"".join(r.bits for r in drawn), np.uint8).reshape(len(drawn), -1)
    label = np.asarray([at[r.lang] for r in drawn])
    # Landmarks in equal shares: the r-th text of each language before any (r+1)-th.
    turn = np.zeros(len(label), dtype=np.int64)
    for k in range(len(languages)):
        turn[label == k] = np.arange((label == k).sum())
    model = Model(languages, seen[np.lexsort((label, turn))[:landmarks]], np.zeros((0, 0)))
    return _solve(model, seen, label)


def _solve(model: Model, seen: np.ndarray, label: np.ndarray) -> Model:
    marks = np.unpackbits(model.landmarks, axis=1, count=BINS)
    values, vectors = np.linalg.eigh(model._kernel(marks).astype(np.float64))
    good = values > 1e-6 * values.max(initial=1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = model._kernel(np.unpackbits(seen, axis=1, count=BINS)).astype(np.float64) @ root
    target = np.where(label[:, None] == np.arange(len(model.languages)), 1.0, -1.0)
    # Languages weigh the same however many texts each has in the sample.
    weight = (1.0 / np.bincount(label, minlength=len(model.languages))[label])[:, None]
    weight /= weight.mean()
    left = mapped.T @ (weight * mapped) + RIDGE * len(label) * np.eye(mapped.shape[1])
    ridge = np.linalg.solve(left, mapped.T @ (weight * target))
    return Model(model.languages, model.landmarks, (root @ ridge).astype(np.float32))


def predicted(text: Column, model: Model) -> Column:
    """``struct<lang_pred, score>`` of a text column.

    ``und`` with score 0 for a null text, one without a letter, and if no language was
    learned; otherwise the language of the best one-versus-rest score, scaled to 0..1 and
    of equal scores the first by name.  Empty tables and repeated rows need no rule.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(whole_text(text))


def with_letter(text: Column) -> Column:
    """Whether a text has a letter; a null one has none."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(has_letter).astype(bool)

    return found(whole_text(text))
