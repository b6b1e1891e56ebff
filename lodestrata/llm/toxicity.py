"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts.  The ordinary one is
trained by zstandard on windows of ordinary text.  Trained in the same way on toxic
texts, a dictionary mostly predicts ordinary text, which those consist of as well
(README has the figures); so the toxic one is made of what the two kinds of text
differ in: a greedy cover of the toxic training texts by short byte strings that
hardly occur, or hardly recur, in ordinary ones, completed by zstandard's trainer on
the places where these strings stand.  Its content is put before the ordinary
content, so both dictionaries predict ordinary text alike and only toxic passages
compress better with the second.  A text is cut at words into windows;
a window's gain is its compressed length with the ordinary dictionary less that
with the toxic one.  Number and share of the windows whose gain reaches each of a
few thresholds, and of those on which the toxic part alone saves as much against no
dictionary, go through a logistic curve, calibrated on training texts that the
dictionaries had not seen; a score of 0.5 is the calibrated cut, which is lowered where
fewer than ALLOWED of the unseen ordinary texts reach it.

The model is fitted on a bounded sample: of each class the ``per_class`` labelled ids
with the smallest hash, and of these in that order the texts that fit into
``sample_bytes`` together (one that does not fit is passed over, whatever its length
would be elsewhere in the order); of rows that share an id the shortest text counts.
The ordinary dictionary is trained on at most ORDINARY_WINDOWS of their windows (so the
driver's memory is bounded), taken evenly from all of them;
every document is scored over its whole text.  The model is a few ten kB and goes
to the tasks with the function.

Defined cases: null and empty texts get the score of a text without marked
windows; documents without a label are scored like others; a null id is never
held out and never learnt from; a score of exactly 0.5 predicts 1; with no toxic or
no ordinary training text all scores are the share of toxic training texts; repeated rows get equal scores; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrow_groups import lean

WINDOW_WORDS = 4
#: A run before each window: without it zstandard stores short windows uncompressed and their lengths say nothing.
PAD = b"\0" * 96
LEVEL, MIN_MATCH = 6, 3
ORDINARY_BYTES = 16_384
ORDINARY_WINDOWS = 60_000
TOXIC_BYTES = 2_048
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Before a string that must occur more than once in a text (a word contains no such byte).
TWICE = b"\0"
_LENGTHS = (4, 5, 6, 7, 8)
THRESHOLDS = (1, 2, 3, 4, 6)
#: Share of ordinary texts, unseen by the dictionaries, that may be above the cut.
ALLOWED = 0.01


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    found = _WORD.findall(text.lower().encode())
    return [PAD + b" " + b" ".join(found[i : i + words]) + b" " for i in range(0, len(found), words)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    if not content:
        return zstandard.ZstdCompressor(compression_params=options)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options)


def _lengths(engine: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    """Compressed lengths; parts go to the library in one call."""
    if not parts:
        return np.zeros(0, np.int64)
    return np.fromiter(map(len, engine.multi_compress_to_buffer(parts, threads=0)), np.int64, len(parts))


def _strings(text: str) -> set[bytes]:
    """Byte strings of a few lengths inside the text's words, blanks at word ends included, and with TWICE before it each that occurs again."""
    times: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower().encode())).items():
        padded = b" " + word + b" "
        for k in _LENGTHS:
            for x in {padded[i : i + k] for i in range(len(padded) - k + 1)}:
                times[x] += n
    return set(times) | {TWICE + x for x, n in times.items() if n > 1}


def _frequent(texts: list[str], share: float) -> Counter:
    """Byte strings in at least that share of the texts (lossy counting, so memory stays small)."""
    tally: Counter = Counter()
    for seen, text in enumerate(texts, 1):
        tally.update(_strings(text))
        if seen % 100 == 0:
            tally = Counter({x: n for x, n in tally.items() if n >= seen * share / 2})
    return Counter({x: n for x, n in tally.items() if n >= max(2, len(texts) * share)})


def _cover(toxic: list[str], ordinary: list[str], times: int = 3, most: int = 200) -> list[bytes]:
    """Strings that cover each toxic text up to ``times`` times and are rare, or rarely occur twice, in ordinary ones."""
    least = max(2, len(toxic) // 200)
    tally = _frequent(toxic, 1 / 200)
    plain: Counter = Counter()
    for text in ordinary:
        plain.update(_strings(text) & tally.keys())
    fit = {x for x, n in tally.items() if n / len(toxic) >= 20 * (plain[x] + 0.5) / (len(ordinary) + 1)}
    where: dict[bytes, list[int]] = {x: [] for x in fit}
    for i, text in enumerate(toxic):
        for x in _strings(text) & fit:
            where[x].append(i)
    need = np.full(len(toxic), times)
    gain = {x: len(w) for x, w in where.items() if w}
    chosen: list[bytes] = []
    while gain and len(chosen) < most:
        best = max(gain, key=lambda x: (gain[x], len(x), x))
        now = int((need[where[best]] > 0).sum())
        if now < least:
            del gain[best]
        elif now < gain[best]:
            gain[best] = now
        else:
            chosen.append(best)
            need[where[best]] -= 1
            del gain[best]
    return list(dict.fromkeys(x.removeprefix(TWICE) for x in chosen))


@dataclass
class Model:
    """Dictionary contents and the logistic curve over marked windows."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()
    base: float = 0.0
    _engines: tuple | None = field(default=None, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_engines": None}

    def savings(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes saved on each window: by the toxic dictionary against the ordinary one, by the ordinary one and by the toxic part against none."""
        if self._engines is None:
            self._engines = tuple(map(_compressor, (b"", self.toxic, self.ordinary, self.toxic + self.ordinary)))
        bare, part, ordinary, toxic = (_lengths(e, parts) for e in self._engines)
        return ordinary - toxic, bare - ordinary, bare - part

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: log count and share of the windows at or above each threshold, for both comparisons."""
        parts, sizes = [], []
        for text in texts:
            own = windows(text)
            parts += own
            sizes.append(len(own))
        gain, ordinary, part = self.savings(parts)
        sizes = np.array(sizes, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(owner, x, len(sizes)) if len(owner) else np.zeros(len(sizes))

        columns = [total(ordinary) / np.maximum(sizes, 1) / 10]
        for saved in (part, gain):
            for threshold in THRESHOLDS:
                marked = total(saved >= threshold)
                columns += [np.log1p(marked), 10 * marked / np.maximum(sizes, 1)]
        return np.column_stack(columns)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.toxic or not self.weights:
            return np.full(len(texts), self.base)
        x = self.features(texts) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3e-3) -> np.ndarray:
    """Newton steps for a small weighted logistic regression with intercept."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    weight = weight / weight.sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ ((p - y) * weight) + penalty @ w
        bend = (design * (p * (1 - p) * weight)[:, None]).T @ design + penalty
        w -= np.linalg.solve(bend, slope)
    return w


def _evenly(texts: list[str], most: int) -> list[bytes]:
    """At most that many windows, at even steps through all texts."""
    total = sum(-(-len(_WORD.findall(t.lower().encode())) // WINDOW_WORDS) for t in texts)
    most = min(most, total)
    every = (w for t in texts for w in windows(t))
    return [w for n, w in enumerate(every) if (n + 1) * most // total > n * most // total]


def _dictionaries(bad: list[str], good: list[str]) -> tuple[bytes, bytes]:
    """Ordinary and toxic dictionary content; the toxic one is empty if nothing sets toxic texts apart."""
    ordinary = _trained(_evenly(good, ORDINARY_WINDOWS), ORDINARY_BYTES)
    chosen = _cover(bad, good)
    if not chosen:
        return ordinary, b""
    content = b"".join(reversed(chosen))[-TOXIC_BYTES:]
    keys = re.compile(b"|".join(map(re.escape, sorted(chosen, key=len, reverse=True))))
    samples = [m for t in bad for w in windows(t) for m in keys.findall(w)]
    return ordinary, content + _trained(samples, TOXIC_BYTES - len(content)) if len(content) < TOXIC_BYTES else content


def fit(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """Train both dictionaries and calibrate the curve.

    Copies of a text count once.  The curve is fitted on texts that the
    dictionaries it is fitted with have not seen (two halves, each calibrated with
    the dictionaries of the other), then the dictionaries are trained on all.
    ``share`` is the share of toxic rows among all labelled ones, where the sample
    has another.
    """
    rows = sorted(set(zip(texts, toxic)), key=lambda r: (zlib.crc32(r[0].encode()), r))
    model = Model(base=float(np.mean(toxic)) if len(toxic) else 0.0)
    bad, good = [t for t, label in rows if label], [t for t, label in rows if not label]
    if len(bad) < 2 or len(good) < 2:
        return model
    share = len(bad) / len(rows) if share is None else share
    xs, ys = [], []
    for fold in (0, 1):
        ordinary, content = _dictionaries(bad[fold::2], good[fold::2])
        if not content:
            continue
        half = Model(ordinary, content)
        for part, label in ((bad[1 - fold :: 2], 1.0), (good[1 - fold :: 2], 0.0)):
            xs.append(half.features(part))
            ys.append(np.full(len(part), label))
    if not xs:
        return model
    y = np.concatenate(ys)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max(len(y) - y.sum(), 1))
    x = np.concatenate(xs)
    weights = _logistic(x, y, weight)
    # Toxic texts are few, so the even cut misses many: it is lowered to the score that only ALLOWED of the unseen ordinary texts reach.
    weights[0] -= min(0.0, float(np.quantile(x[y == 0] @ weights[1:] + weights[0], 1 - ALLOWED)))
    model.weights = tuple(map(float, weights))
    model.ordinary, model.toxic = _dictionaries(bad, good)
    return model


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained by zstandard; the plain samples where it needs more of them."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, sample_bytes: int) -> list:
    """(text, label) of a bounded sample of labelled rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label"))
    # Ids and lengths are chosen first, so texts are neither shuffled nor sorted: at most 2 * per_class ids are broadcast.
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("bytes").alias("bytes"))
    chosen = []
    for value in (0, 1):
        left = sample_bytes
        for row in sizes.where(F.col("label") == value).orderBy(*order).limit(per_class).collect():  # per_class rows of numbers
            if row["bytes"] <= left:
                left -= row["bytes"]
                chosen.append((row["doc_id"], value, row["bytes"]))
    wanted = docs.sparkSession.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, bytes int")
    found = texts.join(F.broadcast(wanted), "doc_id").where(F.octet_length("text") == F.col("bytes"))
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label").collect()


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1_000, sample_bytes: int = 16 << 20) -> Model:
    rows = training_rows(docs, labels, "toxic", per_class, sample_bytes)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit([r[0] for r in rows], [int(r[1]) for r in rows], known)


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                values = model.scores([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(values, pa.float64())], ["doc_id", "held_out", "score"])
    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = base.mapInArrow(lean(_scorer(model)), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
