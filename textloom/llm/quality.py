"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over the statistics of ``docstats``; its covariance is shrunk
towards the pooled one and towards a multiple of the identity, and its Cholesky factor is
computed and inverted once. A document's score is the logistic of the difference of the two
log-densities (Mahalanobis terms by the cached inverse factor), with the slope and offset of
that logistic fitted on differences from densities that have not seen the row.

Defined cases: null text counts as empty; an empty text has the statistics zero and is
scored like any other; repeated ids give a row each; extra columns are ignored; without
labels of both classes every score is the share of label 1 (0.5 without labels); labels
that are null or neither 0 nor 1 are not learnt from; of several labels of one id each counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import held_out, small_batches, table, text_blocks
from textloom.llm.docstats import NAMES, document_stats

#: Labelled rows that a model is fitted on, at most: those with the smallest hash of their id.
MAX_FIT_ROWS = 16_000


@dataclass
class Discriminant:
    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    #: Inverses of the Cholesky factors, transposed: (z - centre) @ it has the Mahalanobis distance as its length.
    inverses: np.ndarray
    log_dets: np.ndarray
    offset: float
    slope: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -12, 12)
        dens = []
        for k in (0, 1):
            y = (z - self.centres[k]) @ self.inverses[k]
            dens.append(-0.5 * (y * y).sum(1) - self.log_dets[k])
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.slope * np.clip(self.margin(x), -200, 200) + self.offset
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit_logistic(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Offset and slope by Newton's method, with a little ridge on the slope; the slope is positive."""
    w, x = np.zeros(2), np.column_stack([np.ones(len(m)), m])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-3 * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 1e-6))


def densities(x: np.ndarray, y: np.ndarray, to_pooled: float, to_identity: float) -> Discriminant:
    """The Gaussians of both classes; their difference as it is, without slope and offset."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -12, 12)
    d, parts = z.shape[1], [z[y == k] for k in (0, 1)]
    centres = np.array([p.mean(0) for p in parts])
    own = [(p - c).T @ (p - c) / len(p) for p, c in zip(parts, centres, strict=True)]
    pooled = sum(len(p) * s for p, s in zip(parts, own, strict=True)) / len(z)
    inverses, dets = [], []
    for s in own:
        s = (1 - to_pooled) * s + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * (np.trace(s) / d + 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(s)
        inverses.append(np.linalg.inv(factor).T)
        dets.append(np.log(np.diag(factor)).sum())
    return Discriminant(mean, scale, centres, np.array(inverses), np.array(dets), 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_identity: float = 0.02, folds: int = 4) -> Discriminant | float:
    """The model, or the share of label 1 where a class is missing; its slope and offset from differences that the other folds' densities give."""
    if len(y) < 4 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    model = densities(x, y, to_pooled, to_identity)
    # rows of each class go to the folds in turn
    fold = np.zeros(len(y), int)
    for k in (0, 1):
        fold[y == k] = np.arange(int((y == k).sum())) % folds
    margin = model.margin(x)
    if min((y == 0).sum(), (y == 1).sum()) >= 2 * folds:
        for f in range(folds):
            margin[fold == f] = densities(x[fold != f], y[fold != f], to_pooled, to_identity).margin(x[fold == f])
    model.offset, model.slope = fit_logistic(np.clip(margin, -200, 200), y.astype(float))
    return model


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep and ``stats`` (array of doubles, as in docstats.NAMES)."""
    small_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("stats", T.ArrayType(T.DoubleType()))

    def run(batches):
        for b in batches:
            found = np.vstack([document_stats(raw, off) for _, _, raw, off in text_blocks(b.column("__t"))] or [np.zeros((0, len(NAMES)))])
            flat = pa.array(found.ravel())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(NAMES)), flat)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), stats], [*keep, "stats"])

    return docs.select(*keep, F.col(text).alias("__t")).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most max_rows labelled rows that may be learnt from, those with the smallest hash."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id", "__y")
        .limit(max_rows)
    )
    # at most max_rows rows of 12 bytes: a size bound that no input can break
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> Discriminant | float:
    """Fit on a bounded sample of labelled rows, whose statistics (max_rows rows of doubles, those with the least hash of their id) come to the driver."""
    rows = features(labelled_sample(docs, labels, label, max_rows), ["doc_id", "__y"])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "__y", "stats").limit(max_rows).toPandas()
    if not len(rows):
        return 0.5
    return fit(np.array(rows["stats"].tolist()), rows["__y"].to_numpy())


def score_quality(docs: DataFrame, model: Discriminant | float, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the score as a last column; no shuffle, whole texts, block by block."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != column]
    schema = docs.select(*names).schema.add(column, "double")

    def run(batches):
        for b in batches:
            parts = []
            for _, _, raw, off in text_blocks(b.column(text)):
                parts.append(np.full(len(off) - 1, model) if isinstance(model, float) else model.score(document_stats(raw, off)))
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(score)], [*names, column])

    return docs.select(*names).mapInArrow(run, schema)


def op10_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
