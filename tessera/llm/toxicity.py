"""Toxicity (operator 10): a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Training reads a bounded sample of labelled rows (`max_rows`, by a hash of the id): document counts of each hashed
n-gram for both labels are summed on Spark, the `n_features` with the highest chi-square stay, each is scaled
by its log-count ratio, and logistic regression weighs them. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.grams import text_hashes
from tessera.llm.shared import bounded_sample, forget, kept, kept_schema, parts, rows_where, written

ORDERS = (4, 5, 6)
BITS = 20


def buckets(text: str | None) -> np.ndarray:
    return text_hashes(text or "", ORDERS) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class Model:
    """Bucket numbers, their weights (already times the log-count ratio) and the intercept."""

    bucket: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.bucket] = self.weight
        return out

    def scores(self, texts: list[str | None], dense: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each text."""
        margins = np.full(len(texts), self.intercept)
        for i, text in enumerate(texts):
            found = buckets(text)
            margins[i] += dense[np.unique(found[dense[found] != 0])].sum(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(margins, -500, 500)))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in parts(batches):
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label, np.unique(buckets(text))] += 1
    found = np.flatnonzero(counts.any(axis=0))
    for part in np.array_split(found, len(found) // 50_000 + 1):
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["bucket", "clean", "toxic"])


def _fit(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on the scaled features that each row has, by Adam."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows) if rows else np.empty(0, np.int64)
    value = scale[feature]
    theta, first, second = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    share = (labels.sum() + 1) / (len(labels) + 2)
    theta[-1] = np.log(share / (1 - share))
    for t in range(1, rounds + 1):
        margin = np.bincount(at, value * theta[feature], len(rows)) + theta[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels
        slope = np.append(np.bincount(feature, value * error[at], len(scale)), error.sum()) / max(1, len(rows))
        slope[:-1] += penalty * theta[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return theta[:-1] * scale, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, n_features: int = 2048, rounds: int = 300, penalty: float = 1e-3) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1; other values and nulls are left out).

    The sampled labels are at most about `max_rows` rows, so they are broadcast and no text is shuffled. Null texts
    count as empty; a repeated label counts again. Without labelled rows every text scores one half.
    """
    chosen = labels.select(F.col("doc_id").alias("labelled_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and labelled_id is not null")
    chosen = bounded_sample(chosen, "labelled_id", max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("label", F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    rows = written(rows, "labelled-texts")  # a bounded sample, read three times below
    counts = rows.select("label", "text").mapInArrow(_document_counts, "bucket int, clean int, toxic int")
    counts = counts.groupBy("bucket").agg(F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    if not n0 + n1:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0)
    n, both = n0 + n1, F.col("clean") + F.col("toxic")
    gap = F.col("toxic") * n0 - F.col("clean") * n1
    chi2 = n * gap * gap / (n0 * n1 * both * (n - both) + F.lit(1e-9))
    best = counts.where(both >= 3).withColumn("chi2", chi2).orderBy(F.desc("chi2"), "bucket").limit(n_features).select("bucket", "clean", "toxic").toPandas().sort_values("bucket")
    bucket = best["bucket"].to_numpy(np.int64)
    p, q = best["toxic"].to_numpy() + 1, best["clean"].to_numpy() + 1
    scale = np.log((p / (n1 + 2)) / (q / (n0 + 2)))

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[bucket] = np.arange(len(bucket))
        for batch in parts(batches):
            found = [np.unique(x[x >= 0]) for x in (place[buckets(t)] for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["label", "doc_id", "features"])

    data = rows.mapInArrow(selected, "label int, doc_id long, features array<int>").toPandas().sort_values(["doc_id", "label"], kind="stable")
    weight, intercept = _fit([np.asarray(x, np.int64) for x in data["features"]], data["label"].to_numpy(np.float64), scale, rounds, penalty)
    return Model(bucket, weight, intercept)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, score (0 to 1) and predicted (1 if score >= 0.5).

    One row for each row of docs, repeated ones too; null and empty texts get the score of the intercept and the n-grams
    of a blank; an empty table gives no rows. A kept column with the name of a result is called kept_<name>.
    """
    names = [*docs.select(*kept(keep, ["score", "predicted"])).columns, "score", "predicted"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in parts(batches):
            scores = model.scores(batch.column(batch.num_columns - 1).to_pylist(), dense)
            columns = [*batch.columns[:-1], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*keep, F.col(text).alias("scored_text")).mapInArrow(of_batches, kept_schema(docs, keep, "score double, predicted int"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; all, if the model has learned nothing."""
    if not len(model.bucket):
        return docs
    return rows_where(docs, text, lambda texts: (model.scores(texts, model.dense()) < threshold).tolist())
