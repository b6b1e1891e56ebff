"""Quality grades by ordinal cumulative-link regression.

Grades g_0 < ... < g_K share one weight vector over hashed text features, and K
ordered thresholds cut the same scale: P(grade <= g_j) = s(t_j - w.x) with the
logistic s.  The model gives the expected grade and the tail probability
P(grade >= target), on which selection is made; the cut is at most 0.5 and never so
high that more than 1 - keep_good of the well-graded training texts would go.

Features: each blank-separated chunk counts by its hash (lower case) and by its
shape (letters, capitals, digits folded to classes, runs to one), and a chunk equal
to the one before counts as a repeat; counts are divided by the number of chunks,
so a text's length has no say.  All chunks of a text are read.

The model is fitted on at most ``rows`` labelled documents, those with the smallest
hash of the id (a documented bound); what is gathered of them are sparse counts,
never texts.  Every document is scored.

Defined cases: a null text or one without chunks has no features and gets the
model's prior, its thresholds alone; null labels and ids are not learnt from; with fewer than
two grades every document gets the one grade (or null without any) and is kept;
a probability that equals the cut keeps the document; repeated rows get equal
results, and of labels that repeat an id each counts; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrow_groups import lean

BUCKETS = 1 << 16
REPEAT = 0
REMEMBERED = 500_000
_SHAPES = ((re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[0-9]+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1"))


class Features(dict):
    """Bucket pairs (word, shape) of chunks, remembered by chunk."""

    def __missing__(self, chunk: bytes) -> int:
        text = chunk.decode("utf-8", "replace")
        word = 1 + zlib.crc32(text.lower().encode()) % (BUCKETS - 1)
        for pattern, mark in _SHAPES:
            text = pattern.sub(mark, text)
        shape = 1 + zlib.crc32(b"\0" + text.encode()) % (BUCKETS - 1)
        value = self[chunk] = word << 32 | shape
        return value

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Word buckets, shape buckets, repeats and number of chunks of a text."""
        if len(self) > REMEMBERED:
            self.clear()
        chunks = raw.split()
        both = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        repeats = sum(map(bytes.__eq__, chunks[1:], chunks))
        return both >> 32, both & 0xFFFFFFFF, repeats, len(chunks)


@dataclass
class Model:
    grades: tuple[float, ...] = ()
    thresholds: tuple[float, ...] = ()
    weights: np.ndarray | None = None
    target: int = 0
    cut: float = 0.0

    def tails(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= g_j) for j = 1..K, a column each."""
        at = np.array(self.thresholds)[None, :] - linear[:, None]
        return 1 / (1 + np.exp(np.clip(at, -30, 30)))

    def described(self, linear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= target)."""
        tails = self.tails(linear)
        grades = np.array(self.grades)
        return grades[0] + tails @ np.diff(grades), tails[:, self.target - 1]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[float], keep_good: float = 0.99, steps: int = 150, ridge: float = 1e-5) -> Model:
    """Fit shared weights and ordered thresholds to sparse rows (buckets, values)."""
    grades = tuple(sorted(set(labels)))
    if len(grades) < 2:
        return Model(grades)
    y = np.searchsorted(grades, labels)
    sizes = np.array([len(b) for b, _ in rows])
    bucket, value = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    used, where = np.unique(bucket, return_inverse=True)
    k, n = len(grades) - 1, len(rows)
    shares = np.clip(np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(shares / (1 - shares))
    # Thresholds as first value and logarithms of the gaps, so that they stay ordered.
    state = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(state), np.zeros_like(state)

    def sigma(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    for step in range(1, steps + 1):
        w, cuts = state[: len(used)], np.cumsum(np.concatenate([state[len(used)][None], np.exp(state[len(used) + 1 :])]))
        linear = np.bincount(owner, w[where] * value, n)
        edges = np.concatenate([np.full((n, 1), -np.inf), cuts[None, :] - linear[:, None], np.full((n, 1), np.inf)], axis=1)
        upper, lower = edges[np.arange(n), y + 1], edges[np.arange(n), y]
        high, low = np.where(np.isinf(upper), 1.0, sigma(upper)), np.where(np.isinf(lower), 0.0, sigma(lower))
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        slope_linear = (d_high - d_low) / n
        slope_cuts = np.zeros(k)
        np.add.at(slope_cuts, y[y < k], -d_high[y < k] / n)
        np.add.at(slope_cuts, y[y > 0] - 1, d_low[y > 0] / n)
        slope = np.empty_like(state)
        slope[: len(used)] = np.bincount(where, slope_linear[owner] * value, len(used)) + ridge * w
        tail = np.cumsum(slope_cuts[::-1])[::-1]
        slope[len(used)] = tail[0]
        slope[len(used) + 1 :] = tail[1:] * np.exp(state[len(used) + 1 :])
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        state -= 0.3 / np.sqrt(step / 10 + 1) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = state[: len(used)]
    cuts = np.cumsum(np.concatenate([state[len(used)][None], np.exp(state[len(used) + 1 :])]))
    model = Model(grades, tuple(map(float, cuts)), weights, k)
    linear = np.bincount(owner, weights[bucket] * value, n)
    good = model.described(linear)[1][y == k]
    model.cut = float(min(0.5, np.quantile(good, 1 - keep_good)))
    return model


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        buckets, values = [], []
        for raw in batch.column("text").cast(pa.large_binary()):
            words, shapes, repeats, n = features.of(raw.as_py() or b"")
            every, counts = np.unique(np.concatenate([words, shapes, np.full(repeats, REPEAT)]), return_counts=True)
            buckets.append(every.astype(np.int32))
            values.append((counts / max(n, 1)).astype(np.float32))
        columns = [batch.column("place"), batch.column("label"), pa.array(buckets, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, ["place", "label", "buckets", "shares"])


def train(docs: DataFrame, labels: DataFrame, rows: int = 4_000, label: str = "quality", keep_good: float = 0.99) -> Model:
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    order = F.struct(F.xxhash64("doc_id").alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"))
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(order.alias("place"), "label", "text")
    # Texts become counts before rows are ordered, so no task or driver holds many texts.
    place = found.schema["place"].dataType.simpleString()
    sparse = found.mapInArrow(lean(_sparse), f"place {place}, label double, buckets array<int>, shares array<float>")
    sample = sparse.orderBy("place", "label").limit(rows).select("label", "buckets", "shares").collect()
    sample.sort(key=lambda r: (r[0], r[1], r[2]))
    return fit([(np.array(r[1], np.int64), np.array(r[2], np.float64)) for r in sample], [r[0] for r in sample], keep_good)


def _linear(model: Model, features: Features, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for i, raw in enumerate(column.cast(pa.large_binary())):
        words, shapes, repeats, n = features.of(raw.as_py() or b"")
        if n:
            out[i] = (model.weights[words].sum() + model.weights[shapes].sum() + repeats * model.weights[REPEAT]) / n
    return out


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            expected, tail = model.described(_linear(model, features, batch.column("__text")))
            others = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(expected), pa.array(tail)], [*others, "expected_grade", "tail_probability"])
    return score


def _keeper(model: Model, text: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            _, tail = model.described(_linear(model, features, batch.column(text)))
            yield batch.filter(pa.array(tail >= model.cut))
    return keep


def select(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    return docs if model.weights is None else docs.mapInArrow(lean(_keeper(model, text)), docs.schema)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns with expected_grade, tail_probability and kept, for every row."""
    keep = keep or ("doc_id",)
    base = docs.select(*keep, F.col("text").alias("__text"))
    if model.weights is None:
        grade = F.lit(model.grades[0] if model.grades else None).cast("double")
        return base.select(*keep, grade.alias("expected_grade"), F.lit(1.0).alias("tail_probability"), F.lit(True).alias("kept"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__text")
    out = base.mapInArrow(lean(_scorer(model)), f"{fields}, expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= model.cut)
