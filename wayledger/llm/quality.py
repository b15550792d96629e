"""Quality classifier: naive Bayes support vector machine over n-gram indicators.

Features are indicators, hashed into ``DIMS`` places: byte trigrams of the text as it stands (case and punctuation count), words, word
pairs, and patterns of words repeated at a distance of one to three words.  Each indicator is scaled by its log-count ratio between the
classes, the scaled vector is brought to length 1, and a linear hinge-loss model is fitted by dual coordinate descent.  A logistic curve
fitted on rows held back from the descent, weighted to the classes' shares among the labels, turns margins into scores.

The model is fitted on at most ``SAMPLE`` labelled rows for each class, the ones with the smallest hashes of their id; that bound makes
the sample safe to broadcast and to train on in the driver.  Scoring is one pass over all texts without a shuffle.

Defined results: null text is empty and scores like any text without features (by the bias alone); ids with labels of both classes, null
labels or null ids are not learned from; if a class has no labelled row, every score is 0.5; repeated rows score alike; an empty table
gives an empty result; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.llm.arrays import mix64, plain_strings, text_bytes, text_slices, word_hashes
from wayledger.llm.tables import mapped

DIMS = 1 << 18
#: Labelled rows of each class that the model is fitted on.
SAMPLE = 3000
#: Every so many rows of the sample are held back for the logistic curve.
HELD_BACK = 5
EPOCHS = 12
PENALTY = 1.0
REPEATS = 3


class Features:
    """Indicator features of texts; one object for each worker keeps its scratch space."""

    def __init__(self) -> None:
        self.last = np.full(DIMS, -1, np.int64)
        self.at = 0

    def distinct(self, places: np.ndarray) -> np.ndarray:
        """Each place once: of equal ones the last written stays."""
        here = np.arange(self.at, self.at + len(places))
        self.at += len(places)
        self.last[places] = here
        return places[self.last[places] == here]

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The features of each text of a slice."""
        raw, starts = text_bytes(column)
        words, firsts = word_hashes(column)
        wide = raw.astype(np.uint32)
        grams = np.zeros(max(len(raw) - 2, 0), np.uint32)
        if len(grams):
            grams = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(14)
        single = (words >> np.uint64(46)).astype(np.int64)
        pairs = (mix64(words[:-1] * np.uint64(31) + words[1:]) >> np.uint64(46)).astype(np.int64) if len(words) else single
        for i in range(len(column)):
            s, e, a, b = starts[i], starts[i + 1], firsts[i], firsts[i + 1]
            parts = [grams[s : max(s, e - 2)].astype(np.int64), single[a:b], pairs[a : max(a, b - 1)]]
            own = words[a:b]
            repeats = [p for p in range(1, REPEATS + 1) if _runs(own, p)]
            yield self.distinct(np.concatenate([*parts, np.array(repeats, np.int64)]))


def _runs(words: np.ndarray, distance: int) -> bool:
    """Is there a run of 3 * distance words that each equal the one ``distance`` before?"""
    same = np.concatenate([[0], np.cumsum(words[distance:] == words[:-distance])]) if len(words) > distance else np.zeros(1)
    need = 3 * distance
    return len(same) > need and bool((same[need:] - same[:-need] == need).any())


@dataclass
class Model:
    """margin = bias + sum(weight of a text's features) / length of its scaled vector; score = logistic(slope * margin + shift)."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        length = np.sqrt((self.ratio[features] ** 2).sum()) if len(features) else 0.0
        return self.bias + (self.weight[features].sum() / length if length > 0 else 0.0)

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of the smoothed shares of each feature in class 1 over class 0."""
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == c]), minlength=DIMS) + 1.0 for c in (0, 1)]
    shares = [c / c.sum() for c in counts]
    return np.log(shares[1] / shares[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, penalty: float, epochs: int, seed: int):
    """(weights, bias) of the L1-loss support vector machine by dual coordinate descent; the bias is a feature of value 1."""
    rng = np.random.default_rng(seed)
    weight, bias = np.zeros(DIMS), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    square = np.array([(v**2).sum() + 1 for v in values])
    alpha = np.zeros(len(rows))
    # both classes weigh the same
    most = penalty * np.where(labels == 1, len(labels) / (2 * (labels == 1).sum()), len(labels) / (2 * (labels == 0).sum()))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * ((weight[rows[i]] * values[i]).sum() + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weight, bias


def logistic_fit(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(slope, shift) by Newton steps on the weighted log loss, held close to (2, 0) by a weak prior."""
    at = np.array([2.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        gradient = x.T @ (weights * (p - labels)) + 1e-3 * len(labels) * (at - [2.0, 0.0])
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * len(labels) * np.eye(2)
        at = at - np.linalg.solve(hessian, gradient)
    return float(max(at[0], 0.1)), float(at[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, share: float, seed: int) -> Model:
    """The model from features and labels of a sample; ``share`` of class 1 among all labels."""
    held = np.arange(len(rows)) % HELD_BACK == HELD_BACK - 1
    if len({*labels[~held]}) < 2:
        return Model(np.zeros(DIMS), np.zeros(DIMS), 0.0, 1.0, 0.0)
    train = [r for r, h in zip(rows, held, strict=True) if not h]
    ratio = log_count_ratios(train, labels[~held])
    values = []
    for r in train:
        v = ratio[r]
        values.append(v / max(np.sqrt((v**2).sum()), 1e-12))
    weight, bias = dual_descent(train, values, labels[~held], PENALTY, EPOCHS, seed)
    model = Model(weight * ratio, ratio, bias, 1.0, 0.0)
    back = labels[held]
    if len({*back}) == 2:
        margins = np.array([model.margin(r) for r, h in zip(rows, held, strict=True) if h])
        weights = np.where(back == 1, share / (back == 1).mean(), (1 - share) / (back == 0).mean())
        model.slope, model.shift = logistic_fit(margins, back.astype(float), weights)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model:
    """Fit on ``labels`` (doc_id, label 0 or 1) and the texts of ``docs`` (doc_id, text)."""
    one = (
        labels.where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    )
    share = one.agg(F.avg("label")).first()[0]
    picked = [one.where(F.col("label") == c).orderBy("h", "doc_id").limit(sample) for c in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows at most
    texts = docs.select("doc_id", "text").join(few, "doc_id").select("h", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Features()
        for batch in batches:
            text = plain_strings(batch.column(2))
            for lo, hi in text_slices(text):
                rows = [r.astype(np.int32).tobytes() for r in tool.of(text.slice(lo, hi - lo))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["h", "label", "f"]
                )

    # by hash; a repeated id gives a row for each text, of which as many as the bound are used
    got = mapped(texts, run, "h long, label int, f binary").orderBy("h", "f").limit(2 * sample).collect()
    rows = [np.frombuffer(r["f"], np.int32) for r in got]
    return fit_rows(rows, np.array([r["label"] for r in got], int), float(share or 0.0), seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with quality_score (a column of that name is replaced); the whole text counts."""
    docs = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, fitted = Features(), shared.value
        for batch in batches:
            column = batch.schema.get_field_index("text")
            text = plain_strings(batch.column(column))
            scores = [fitted.score(r) for lo, hi in text_slices(text) for r in tool.of(text.slice(lo, hi - lo))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "quality_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, run, f"{kinds}, quality_score double")
