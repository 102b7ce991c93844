"""Quality classifier: regularised quadratic discriminant over document statistics.

A text gives a fixed number of statistics (lengths, shares of character kinds,
repetition, variety), each logged or log-odds transformed so that they are
nearer to normal.  Each class has a mean and a covariance, shrunk towards the
pooled covariance and that towards its diagonal; Cholesky factors are kept, and
the score is the logistic of the difference of the two Mahalanobis log-densities
plus the log prior odds.  Means and covariances come from sums that each task
makes of its own rows, so all labelled rows are used and none are moved.

Cases: null, empty and blank texts have statistics as any other.  Labels that
are null are not learned from.  Of repeated labels of a doc_id each counts.
While one of the classes has no labelled row, every score is 0.5.  Every row
gives a row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._common import forget, settle, slices, utf8

_KINDS = {
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n",
    "stop": b".,;:",
    "bang": b"!?",
    "bar": b"|<>{}[]\\/_=",
    "mark": b"#$%&*@^~+",
    "high": bytes(range(0x80, 0x100)),
}
N_FEATURES = 19


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of a whole text."""
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if n else np.zeros(256)
    words = data.split()
    m = len(words)
    lower = [w.lower() for w in words]
    lines = [x for x in data.split(b"\n") if x.strip()]
    odds = lambda part, whole: float(np.log((part + 0.5) / (whole - part + 0.5)))
    seen = counts[counts > 0] / max(1, n)
    out = [float(np.log1p(n)), float(np.log1p(m))]
    out += [odds(int(sum(counts[c] for c in kind)), n) for kind in _KINDS.values()]
    out.append(odds(len(set(lower)), m) / (1 + 0.2 * float(np.log1p(m))))
    out.append(odds(sum(a == b for a, b in zip(lower, lower[1:])), max(0, m - 1)))
    out.append(odds(len(lines) - len(set(lines)), len(lines)))
    out.append(float(np.log1p(n / max(1, m))))
    out.append(float(-(seen * np.log2(seen)).sum()) if n else 0.0)
    out.append(odds(sum(not w[-1:].isalnum() and w[-1] < 0x80 for w in words), m))
    out.append(odds(sum(w.isupper() for w in words), m))
    return out


def featurise(documents: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, its statistics and the named other columns; one narrow pass over whole texts."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for i, j in slices(texts):
                own = batch.slice(i, j - i)
                values = pa.array([statistics(t or b"") for t in texts[i:j]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([own.column(0), values, *own.columns[2:]], ["doc_id", "features", *own.schema.names[2:]])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType())), *docs.schema.fields[2:]])
    return docs.mapInArrow(run, schema)


class Discriminant:
    """Two shrunk Gaussians, from (n, sums, sums of products) of each class."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, diagonal: float = 0.1):
        self.moments = moments if len(moments) == 2 and all(m[0] > 0 for m in moments.values()) else {}
        self.shrink, self.diagonal = shrink, diagonal

    @cached_property
    def classes(self) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
        """For each class: log prior, mean, inverse Cholesky factor and log determinant."""
        total = sum(m[0] for m in self.moments.values())
        scatter = {k: p / n - np.outer(s / n, s / n) for k, (n, s, p) in self.moments.items()}
        pooled = sum(self.moments[k][0] / total * c for k, c in scatter.items())
        pooled = (1 - self.diagonal) * pooled + self.diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
        out = []
        for k in (0, 1):
            n, s, _ = self.moments[k]
            weight = (self.shrink * total / 2) / (self.shrink * total / 2 + n)
            factor = np.linalg.cholesky((1 - weight) * scatter[k] + weight * pooled)
            out.append((np.log(n / total), s / n, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.moments or not len(x):
            return np.full(len(x), 0.5)
        density = [prior - (((x - mean) @ inverse.T) ** 2).sum(axis=1) / 2 - log_det / 2 for prior, mean, inverse, log_det in self.classes]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -50, 50)))


def fit(features: DataFrame, labels: DataFrame, label: str) -> Discriminant:
    """Learn from the rows of features whose doc_id has a 0 or 1 in ``labels[label]``."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    train = features.join(own, "doc_id").select("label", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy()
                x = np.asarray(batch.column(1).flatten()).reshape(len(y), N_FEATURES)
                for k in (0, 1):
                    own = x[y == k]
                    sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["label", "sums"])

    parts = train.mapInArrow(run, "label int, sums array<double>").select("label", F.posexplode("sums").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
    moments = {}
    for r in parts.collect():  # two classes of 1 + d + d * d sums
        moments.setdefault(r.label, np.zeros(1 + N_FEATURES + N_FEATURES**2))[r.k] = r.v
    return Discriminant({k: (m[0], m[1 : 1 + N_FEATURES], m[1 + N_FEATURES :].reshape(N_FEATURES, -1)) for k, m in moments.items()})


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    """Adds score, and drops the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, N_FEATURES) if batch.num_rows else np.empty((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.score(x), 9)), *batch.columns[2:]], ["doc_id", "score", *batch.schema.names[2:]])

    schema = T.StructType([features.schema["doc_id"], T.StructField("score", T.DoubleType()), *features.schema.fields[2:]])
    return features.mapInArrow(run, schema)


def held_out(doc_id: str, folds: int, fold: int):
    """Whether crc32 of doc_id as text leaves ``fold``; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned outside the held-out fold, and the named other columns.

    Where other columns are wanted, statistics are made again beside them, so texts never move.
    """
    features = settle(featurise(documents))
    model = fit(features, labels.where(~held_out("doc_id", 3, 1)), "quality")
    if columns:
        forget(features)
    scores = scored(featurise(documents, columns) if columns else features, model)
    more = (F.col(f"_{c}").alias(c) for c in columns)
    return scores.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)
