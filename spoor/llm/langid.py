"""Language of texts by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.textvec import MIX, STEP

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTH = 0.1
UNKNOWN = "und"
# the bound of the training sample: whole texts of each language, by a hash of the text
TRAIN_ROWS = 1500
TRAIN_TASKS = 12
SLICES = 32


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams of a batch, and the row each belongs to.

    Texts are lower-cased, and every run of characters that are not letters counts as one
    space, so that digits, marks and markup say nothing about the language.
    """
    clean = []
    for t in texts:
        letters = "".join(c if c.isalpha() else " " for c in set(t or ""))
        table = {ord(c): " " for c, k in zip(set(t or ""), letters) if k == " "}
        clean.append(" " + " ".join((t or "").translate(table).lower().split()) + " ")
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint64)
    rows = np.repeat(np.arange(len(clean)), [len(c) for c in clean])
    ids, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * STEP + codes[n - 1 :] + np.uint64(1)
        if n not in ORDERS:
            continue
        whole = rows[: len(h)] == rows[n - 1 :]  # no gram across two texts
        if n == 1:
            whole &= codes != 32
        mixed = (h[whole] + np.uint64(n)) * MIX
        ids.append(((mixed ^ (mixed >> np.uint64(29))) * MIX >> np.uint64(48)).astype(np.int64))
        owners.append(rows[: len(h)][whole])
    return np.concatenate(ids), np.concatenate(owners)


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS
) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (bucket x language) with the log prior in the last row.

    Learns from at most ``rows`` whole texts of each language, counted on the executors; the
    driver adds up at most ``TRAIN_TASKS`` count vectors a language.
    """
    given = docs.select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("t")
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # the choice moves hashes only; the chosen ones, bounded by ``rows`` a language, are broadcast
    part = Window.partitionBy("lang", F.pmod("t", F.lit(SLICES))).orderBy("t")
    keys = given.select("lang", "t").distinct().withColumn("r", F.row_number().over(part))
    keys = keys.where(F.col("r") <= -(-rows // SLICES)).select("lang", "t")
    few = given.join(F.broadcast(keys), ["lang", "t"]).dropDuplicates(["lang", "t"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for at in range(0, len(part), 64):
                    ids, _ = grams(part["text"].tolist()[at : at + 64])
                    sums[lang] = sums.get(lang, 0) + np.bincount(ids, minlength=BUCKETS)
                seen[lang] = seen.get(lang, 0) + len(part)
        for lang, total in sums.items():
            yield pd.DataFrame(
                {"lang": [lang], "n": [seen[lang]], "counts": [total.astype("<i8").tobytes()]}
            )

    counted = few.select("lang", "text").repartition(TRAIN_TASKS).mapInPandas(
        count, "lang string, n long, counts binary"
    )
    sums: dict[str, np.ndarray] = {}
    for r in counted.toLocalIterator():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["counts"], "<i8")
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    counts = np.stack([sums[x] for x in langs], axis=1).astype(float) + SMOOTH
    logs = np.log(counts / counts.sum(0))
    prior = np.full((1, len(langs)), -np.log(len(langs)))
    return langs, np.vstack([logs, prior]).astype(np.float32)


def predict(
    docs: DataFrame, langs: list[str], logs: np.ndarray, text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``lang_pred`` and the posterior ``score`` of each whole text.

    ``und`` with score 0 for a null text, a text without any letter, or no language learned.
    Of equal posteriors the first language in order wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # buckets x languages

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matrix = shared.value
        for batch in texts:
            names, scores = [], []
            for at in range(0, len(batch), 16):
                part = batch.iloc[at : at + 16].tolist()
                ids, owners = grams(part)
                sums = np.stack(
                    [
                        np.bincount(owners, matrix[ids, j], minlength=len(part)) + matrix[-1, j]
                        for j in range(len(langs))
                    ],
                    axis=1,
                ) if langs else np.zeros((len(part), 0))
                for text, row in zip(part, sums):
                    if not langs or text is None or not any(c.isalpha() for c in text):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(row.argmax())
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(row - row[best]).sum()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    named = docs.drop("lang_pred", "score").withColumn("__p", predicted(F.col(text_col)))
    return named.select("*", "__p.*").drop("__p")
