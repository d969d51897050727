"""Quality classifier: supervised subword embeddings.

Every hashed word and character n-gram has a learned vector.  A document is the
average of its features' vectors; a softmax layer over that average says how
likely label 1 is.  Vectors and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled documents.

Averaging and the layer are both linear, so for scoring every bucket's vector is
multiplied with the layer once, and a document's margin is the mean of its
features' products: the same number, with one float per bucket to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import column, raw_texts
from tallymark.llm.features import mean_weights
from tallymark.llm.labelled import fold, sample

BITS = 17  # buckets: 2**17, 512 KB of floats to broadcast
DIMENSIONS = 12
TRAINING_ROWS = 3_000  # bound of the labelled sample
EPOCHS = 6
RATE = 0.4
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Margin of label 1 over label 0: the mean of a document's weights, plus the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        margin = np.clip(mean_weights(texts, self.weights) + self.bias, -500, 500)
        return 1 / (1 + np.exp(-margin))


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]], seed: int = 11) -> Model:
    """Fit vectors and softmax layer; with no labelled rows every score is 1 (nothing is known to be bad)."""
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), 500.0)
    dice = np.random.default_rng(seed)
    vectors = dice.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    docs = [(y, k, n) for y, _, k, n in rows if len(k)]
    if not docs:
        share = (sum(r[0] for r in rows) + 1) / (len(rows) + 2)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in dice.permutation(len(docs)):
            label, keys, counts = docs[i]
            # worked out at each visit: kept, the shares of all rows would be most of the driver's numbers
            share = (counts / counts.sum()).astype(np.float32)
            rate = RATE * (1 - done / steps)
            done += 1
            own = vectors[keys]
            hidden = share @ own
            margin = hidden @ layer + bias
            odds = np.exp(margin - margin.max())
            error = odds / odds.sum()
            error[label] -= 1
            # every feature's gradient is its share of the average's; one common factor keeps rare features moving
            vectors[keys] = own - (rate * np.sqrt(share))[:, None] * (layer @ error)
            layer -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
    margin = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(margin.astype(np.float32), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Train on up to ``rows`` labelled documents outside the held-out fold."""
    return train(sample(documents, labels, BITS, rows))


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, next to the scan.

    Only the text decides a score.  Empty and null texts have no features and get
    the score of the bias; a null ``doc_id`` stays null and counts as an empty id
    for the fold; repeated rows are scored each; other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(list(raw_texts(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, all their columns as they are.

    Only texts go to Python and only scores come back; rows are filtered where they are.
    Null and empty texts have the score of the bias; repeated rows are judged each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            raw = [value.as_py() or b"" for value in part.cast(pa.binary())]
            yield pa.array(shared.value.scores(raw))

    return documents.where(scores(column("text")) >= threshold)
