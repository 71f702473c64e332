"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log of their smoothed class count ratio, and
a linear hinge-loss model is fitted to them by dual coordinate descent.  The
n-grams are of words and of word shapes (letters, capitals and digits each
collapsed to one sign, other signs kept; a word equal to the one before it has a
shape of its own), hashed into ``dimensions`` slots.

The fit uses at most ``per_class`` labelled documents of each class, those with
the smallest hash of their id; scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import hashing
from terrace.llm.common import free_name, prepare


@dataclass(frozen=True)
class Quality:
    per_class: int = 2500
    dimensions: int = 1 << 18
    word_n: tuple[int, ...] = (1, 2)
    shape_n: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12
    threshold: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """weight: per slot, ratio already multiplied in; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SAME_WORD = np.uint64(0x1234567)


def features(texts: list[bytes], how: Quality) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of each text, texts in order, and where each text's begin (one more entry for the end)."""
    buf, begins = hashing.buffer_of(texts)
    starts, ends = hashing.spans_of(buf)
    first = np.searchsorted(starts, begins)
    words = hashing.hashes_of(np.frombuffer(hashing.LOWER, np.uint8)[buf], starts, ends)
    signs = _SHAPE[buf]
    kept = np.ones(len(signs), bool)
    kept[1:] = (signs[1:] != signs[:-1]) | (signs[1:] == 0x20)
    place = np.cumsum(kept)
    # A run of one sign counts as one, so a span's collapsed form has as many signs as kept positions.
    shapes = hashing.hashes_of(signs[kept], place[starts] - 1, place[ends - 1])
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[first < len(words)]] = False  # the word before a text's first is another text's
    shapes = np.where(again, shapes ^ _SAME_WORD, shapes)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
    found = []
    for kind, (units, sizes) in enumerate(((words, how.word_n), (shapes, how.shape_n))):
        for n in sizes:
            if len(units) >= n:
                inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
                slot = hashing.mix(hashing.ngrams(units, n) + np.uint64(64 * kind + n)) % np.uint64(how.dimensions)
                found.append(((owner[n - 1 :] << np.uint64(32)) | slot)[inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    both = np.unique(np.concatenate(found))
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(both >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))


@dataclass(frozen=True)
class Rows:
    """The slots of many texts in one array; text i has ``slots[begins[i] : begins[i + 1]]``."""

    slots: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64))

    def __len__(self) -> int:
        return len(self.begins) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.slots[self.begins[i] : self.begins[i + 1]]


def fit(rows: Rows, labels: np.ndarray, how: Quality) -> Model:
    """Log-count ratios, dual coordinate descent on the scaled indicators of unit length, then a logistic link."""
    if not len(rows) or labels.all() or not labels.any():
        return Model(np.zeros(how.dimensions, np.float32), 0.0, 1.0, 2.0 if len(rows) and labels.all() else -2.0 if len(rows) else 0.0)
    of_good = np.repeat(labels, np.diff(rows.begins))
    good, bad = (np.bincount(rows.slots[x], minlength=how.dimensions) + how.smoothing for x in (of_good, ~of_good))
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    norms = np.array([max(np.linalg.norm(ratio[rows[i]]), 1e-9) for i in range(len(rows))])
    rng = np.random.default_rng(how.seed)

    def descend(which: np.ndarray) -> tuple[np.ndarray, float]:
        weight, bias, dual = np.zeros(how.dimensions), 0.0, np.zeros(len(rows))
        share = labels[which].mean()
        caps = np.where(labels, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * how.cost
        for _ in range(how.epochs):
            for i in rng.permutation(which):
                at = rows[i]
                y, x = (1.0 if labels[i] else -1.0), ratio[at] / norms[i]
                slope = y * (weight[at] @ x + bias) - 1.0
                new = min(max(dual[i] - slope / (x @ x + 1.0), 0.0), caps[i])
                if (step := (new - dual[i]) * y) != 0.0:
                    weight[at] += step * x
                    bias += step
                    dual[i] = new
        return weight, bias

    order = rng.permutation(len(rows))
    margins = np.zeros(len(rows))
    for part in (order[::2], order[1::2]):  # each half is judged by the other's model
        weight, bias = descend(np.setdiff1d(order, part))
        for i in part:
            margins[i] = weight[rows[i]] @ ratio[rows[i]] / norms[i] + bias
    slope, shift = 1.0, 0.0
    targets = labels.astype(float) * 0.998 + 0.001
    design = np.stack([margins, np.ones(len(rows))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ (slope, shift), -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (targets - p) - 1e-3 * np.array([slope, shift]))
        slope, shift = slope + step[0], shift + step[1]
    weight, bias = descend(order)
    # Both factors that scoring needs per slot: the weight times the ratio, and the ratio's square for the length.
    return Model(np.stack([weight * ratio, ratio**2]).astype(np.float32), float(bias), float(max(slope, 1e-6)), float(shift))


def score(texts: list[bytes], model: Model, how: Quality) -> np.ndarray:
    slots, begins = features(texts, how)
    if model.weight.ndim == 1:
        margins = np.zeros(len(texts))
    else:
        sums = np.concatenate((np.zeros((2, 1)), np.cumsum(model.weight[:, slots].astype(np.float64), axis=1)), axis=1)
        dot, square = sums[:, begins[1:]] - sums[:, begins[:-1]]
        margins = dot / np.maximum(np.sqrt(np.maximum(square, 0)), 1e-9)
    return 1 / (1 + np.exp(-np.clip(model.slope * (margins + model.bias) + model.shift, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, how: Quality = Quality(), *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", held_out: int = 5) -> Model:
    """Fit on labelled rows whose crc32 of the id as text, modulo ``held_out``, is not 0 (all of them if held_out is 0).

    Labels other than 0 and 1 and null ids are passed over; an id with several
    labels counts as 1 if any is; of several texts of an id the smallest is used.
    At most ``per_class`` ids of each class are used.
    """
    spark = prepare(docs.sparkSession)
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if held_out:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % held_out != 0)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    kept = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.per_class) for y in (0, 1)]
    ids = spark.createDataFrame([tuple(r) for part in kept for r in part.collect()], "doc_id long, label int")  # 2 * per_class rows at most
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for frame, texts in hashing.pieces(whole):
                found, begins = features(texts, how)
                yield pd.DataFrame({"doc_id": frame.doc_id.to_numpy(), "label": frame.label.to_numpy(), "slots": [found[a:b].astype(np.int32) for a, b in zip(begins[:-1], begins[1:])]})

    # At most 2 * per_class texts' slots, as two flat arrays.
    got = rows.mapInPandas(slots, "doc_id long, label int, slots array<int>").orderBy("doc_id").toArrow().combine_chunks()
    if not got.num_rows:
        return fit(Rows.of([]), np.zeros(0, bool), how)
    lists = got["slots"].chunk(0)
    return fit(Rows(lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)), got["label"].to_numpy().astype(bool), how)


def scored(docs: DataFrame, model: Model, how: Quality = Quality(), *, text: str = "text", score_to: str = "score", predicted_to: str = "predicted") -> DataFrame:
    """All rows and columns of ``docs`` with two more: a score from 0 to 1 and the prediction, 0 or 1.

    Null and empty texts have no n-gram and get the score of the bias alone.  The
    new columns are the last; a column of ``docs`` that has such a name stays, and
    the new one's gets underscores before it.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # two floats a slot: 2 MB

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            frame = pd.DataFrame({"text": batch})
            yield pd.Series(np.concatenate([np.zeros(0), *(score(texts, shared.value, how) for _, texts in hashing.pieces(frame))]))

    score_to = free_name(docs, score_to)
    found = docs.withColumn(score_to, run(F.col(text).cast("string")))
    return found.withColumn(free_name(found, predicted_to), (F.col(score_to) >= how.threshold).cast("int"))
