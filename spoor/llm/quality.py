"""Quality scores by supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and character
n-grams; a softmax layer on that average gives the classes. Vectors and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.textvec import MIX, STEP, word_hashes

BUCKETS = 1 << 17
DIM = 8
EPOCHS = 5
RATE = 0.6
SEED = 42
# the bound of the training sample: whole texts, in the order of a hash of the id
TRAIN_ROWS = 3000
TRAIN_CHARS = 32_000_000
THRESHOLD = 0.7


def _spread(h: np.ndarray, salt: int) -> np.ndarray:
    """Bucket numbers of 64-bit hashes."""
    h = (h + np.uint64(salt)) * MIX
    return ((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - 17)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Bucket numbers, with repeats, of words, word pairs and character 3- to 5-grams.

    A word that repeats the one before gives one shared pair, so that repetition is seen
    in words never met in training. A null or empty text has no feature.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    padded = np.concatenate([[32], np.where(data < 33, 32, data), [32]]).astype(np.uint64)
    out = []
    words, _, _ = word_hashes(padded)
    if len(words):
        pairs = words[:-1] * STEP + words[1:]
        pairs[words[:-1] == words[1:]] = 1
        out += [_spread(words, 1), _spread(pairs, 2)]
    gram = padded[:-1] * STEP + padded[1:]
    for n in (3, 4, 5):
        if len(padded) < n:
            break
        gram = gram[: len(padded) - n + 1] * STEP + padded[n - 1 :]
        out.append(_spread(gram, n + 10))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """Per bucket, what its vector adds to the logit of class 1, and the layer's bias.

    The average and the layer are linear, so the vector of a bucket times the layer is all
    that scoring needs.
    """

    pull: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = features(text)
        logit = self.bias + (self.pull[found].mean() if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Fit on texts with labels 0 or 1; one class or no row gives a constant score."""
    if not len(texts) or len(set(labels)) < 2:
        rate = (sum(labels) + 0.5) / (len(labels) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(SEED)
    rows = []
    for text in texts:
        ids, counts = np.unique(features(text), return_counts=True)
        rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            rate = np.float32(RATE * (1 - done / steps) + 1e-3)
            done += 1
            ids, share = rows[i]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer.T @ p
            layer -= rate * np.outer(p, hidden)
            bias -= rate * 0.1 * p
            if len(ids):
                # each feature takes a full step, as if it were drawn alone
                vectors[ids] -= rate * np.minimum(1, share * len(ids))[:, None] * back
    pull = vectors @ (layer[1] - layer[0])
    return Model(pull.astype(np.float32), float(bias[1] - bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS,
) -> Model:
    """Train on at most ``rows`` labelled texts of at most ``chars`` characters together.

    Rows without text or label, and ids whose labels disagree, are left out. One task holds
    the bounded sample and trains; the driver gets the weights, which are of fixed size.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("z"))
        .where("y = z")
        .select("id", "y")
    )
    given = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")
    ).where(F.col("text").isNotNull())
    # the choice moves ids and lengths only; the chosen rows, bounded by ``rows``, are broadcast
    sizes = (
        given.select("id", "t", F.length("text").alias("n"))
        .join(known, "id")
        .withColumn("at", F.xxhash64("id", "t"))
        .orderBy("at")
        .limit(rows)
        .collect()
    )
    chosen, total = {}, 0
    for r in sizes:
        total += r["n"]
        if total > chars:
            break
        chosen[r["id"], r["t"]] = (r["at"], r["y"])
    if not chosen:
        return train([], [])
    keys = docs.sparkSession.createDataFrame(
        [(i, t, at, y) for (i, t), (at, y) in chosen.items()], "id long, t long, at long, y int"
    )
    sample = given.join(F.broadcast(keys), ["id", "t"]).dropDuplicates(["id", "t"])

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches)).sort_values("at")
        model = train(whole["text"].tolist(), whole["y"].tolist())
        yield pd.DataFrame({"pull": [model.pull.tobytes()], "bias": [model.bias]})

    sample = sample.select("at", "text", "y").repartition(1)
    found = sample.mapInPandas(trained, "pull binary, bias double").first()
    return Model(np.frombuffer(found["pull"], np.float32), found["bias"])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1 of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(t) for t in batch], dtype=float)

    return docs.withColumn(name, scored(F.col(text_col)))
