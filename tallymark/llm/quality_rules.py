"""Quality rules: counts of whole texts, and a calibrated linear model over n-grams.

A document fails by the fixed base rules, or because the model holds it for bad.
The model is a logistic regression over hashed word and character n-grams, fitted
to labelled quality rows; a second part of the sample turns its margin into a
probability (Platt scaling), which is compared with a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm.common import texts
from tallymark.llm.features import mean_weights
from tallymark.llm.labelled import sample

BITS = 17
TRAINING_ROWS = 4_000  # bound of the labelled sample; every fourth row calibrates
STEPS = 60
BLOCK_DOCUMENTS = 128  # training documents that a step looks at together, for memory
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8  # words
MIN_PROBABILITY = 0.3
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Model:
    """Probability that a text is good: sigmoid(slope * margin + offset)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probabilities(self, raw: list[bytes]) -> np.ndarray:
        margin = mean_weights(raw, self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _regression(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch gradient steps with per-weight scaling, a block of documents at a time."""
    label = np.array([y for y, _, _ in docs], float)
    # both classes weigh the same in the fit; calibration brings the true share back
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    blocks = []
    for start in range(0, len(docs), BLOCK_DOCUMENTS):
        part = docs[start : start + BLOCK_DOCUMENTS]
        keys = np.concatenate([k for _, k, _ in part])
        values = np.concatenate([(n / n.sum()).astype(np.float32) for _, _, n in part])
        owner = np.repeat(np.arange(len(part), dtype=np.int32), [len(k) for _, k, _ in part])
        blocks.append((slice(start, start + len(part)), keys, values, owner))
    curve = np.full(1 << BITS, 1e-9)
    for rows, keys, values, owner in blocks:
        curve += np.bincount(keys, weight[rows][owner] * values * values, 1 << BITS)
    scale = 1 / np.sqrt(curve)
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(STEPS):
        slope, drift = np.zeros(1 << BITS), 0.0
        for rows, keys, values, owner in blocks:
            margin = np.bincount(owner, weights[keys] * values, len(label[rows])) + bias
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label[rows])
            slope += np.bincount(keys, error[owner] * values, 1 << BITS)
            drift += error.sum()
        weights -= 0.5 * scale * slope
        bias -= 0.5 * drift
    return weights, bias


def _calibration(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset by Newton's method on smoothed targets."""
    good, bad = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    center, width = margin.mean(), margin.std() + 1e-9
    x = np.stack([(margin - center) / width, np.ones(len(margin))])
    fit = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(fit @ x, -30, 30)))
        curve = (x * np.maximum(p * (1 - p), 1e-6)) @ x.T + 1e-4 * np.eye(2)
        fit = fit - np.clip(np.linalg.solve(curve, x @ (p - target) + 1e-4 * fit), -2, 2)
    return float(fit[0] / width), float(fit[1] - fit[0] * center / width)


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Model:
    """Fit and calibrate.  Without rows of both labels on either side the share of
    good rows stands for every probability, and 1 without any row."""
    docs = [(y, k, n.astype(np.int32)) for y, _, k, n in rows if len(k)]
    fitted, held = [d for i, d in enumerate(docs) if i % 4], docs[::4]
    if len({y for y, _, _ in fitted}) < 2 or len({y for y, _, _ in held}) < 2:
        share = (sum(r[0] for r in rows) + 1) / (len(rows) + 1)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))) if share < 1 else 500.0)
    weights, bias = _regression(fitted)
    weights = weights.astype(np.float32)
    margin = np.array([(weights[k] * n).sum() / n.sum() + bias for _, k, n in held])
    return Model(weights, bias, *_calibration(margin, np.array([y for y, _, _ in held], float)))


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Train on up to ``rows`` labelled documents outside the held-out fold."""
    return train(sample(documents, labels, BITS, rows))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first ones included.

    Windows are compared exactly: runs of 2, 4 and 8 words are numbered by the
    pair of half as long runs they consist of.
    """
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    runs = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    span = 1
    while span < window:
        left, right = runs[:-span], runs[span:]
        _, runs, counts = np.unique(left * (runs.max() + 1) + right, return_inverse=True, return_counts=True)
        if len(counts) == len(runs):
            return 0
        span *= 2
    covered = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(counts[runs] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines and repeated words of a text."""
    raw = text.encode()
    words = raw.split()  # bytes are split at exactly space and U+0009 to U+000D
    spaces = sum(raw.count(c) for c in _SPACES)
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def judge(documents: DataFrame, model: Model, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Counts, probability and verdict of every document, next to the scan.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, probability, base_failed, kept``.  Null and empty texts have
    no words, so they fail; a null ``doc_id`` stays null; repeated rows are judged
    each; other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(texts(batch))
            found = np.array([counts(t) for t in own], np.int64)
            chance = shared.value.probabilities([t.encode() for t in own])
            failed = (found[:, 0] < MIN_WORDS) | (100 * found[:, 4] > MAX_REPEAT_PERCENT * found[:, 0])
            columns = [pa.array(found[:, i]) for i in range(5)]
            columns += [pa.array(chance), pa.array(failed), pa.array(~failed & (chance >= min_probability))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names, "probability", "base_failed", "kept"])

    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, probability double, base_failed boolean, kept boolean"
    return documents.select("doc_id", "text").mapInArrow(run, schema)
