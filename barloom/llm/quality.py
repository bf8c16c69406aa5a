"""A quality classifier learned from trusted positives and unlabelled web text.

Features come from the bytes of the whole text: shares of single bytes that are ASCII
marks, shares of pairs of adjacent byte classes, and a few shapes (lengths, words that
repeat).  They are computed on the executors in one pass over the bytes.

Training minimises the non-negative unbiased risk of positive-unlabelled learning::

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the logistic loss, over trusted positives (rows labelled 1) and unlabelled rows (a
draw of all documents outside the held-out fold; labels of 0 are never read).  Where the
second term is negative the step goes the other way, which keeps the model from explaining
away positives.  Steps shrink to nothing and the weights are the mean of the second half's.

The class prior ``pi`` is estimated from positives and unlabelled rows alone.  A first
model is trained on half of the positives; above any score, the share of unlabelled rows
is at least ``pi`` times the share of positives that it hasn't seen, so the least ratio of
the two over several scores, with one standard error for the positives, is the estimate
(the mean of both halves').

Only features of a bounded sample reach the driver: the ``sample`` positives and the
``sample`` unlabelled rows whose ids hash lowest.  Scoring covers every row.

The score is the model's probability of label 1; it depends on the text only.
Null and empty texts get the score of all-zero shares.  Ties and repeated rows are
harmless: a score is a function of its row.  With no positives in the labels, or no other
document, every score is 0.5.  Extra columns pass through; ``score``, ``held_out`` and
``predicted`` replace columns of those names in ``classify``, and ``drop_low_quality``
returns the columns it was given with their own values.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.workspace import private, tidy
from barloom.session import ship_package

#: At most so many positives and so many unlabelled rows are gathered for training.
SAMPLE = 5_000
THRESHOLD = 0.3
#: Added to a feature's deviation, so that one that hardly any text has doesn't decide alone: shares are below 1.
FLOOR = 0.1
FOLDS = 5

# Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 full stop and comma, 6 other ASCII mark, 7 the rest.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[[44, 46]] = 0, 1, 2, 3, 4, 5
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
N_FEATURES = 64 + len(_MARKS) + 5


def features(data: bytes) -> np.ndarray:
    """One vector of a text's UTF-8 bytes."""
    out = np.zeros(N_FEATURES, np.float32)
    n = len(data)
    if not n:
        return out
    x = np.frombuffer(data, np.uint8)
    c = _CLASS[x]
    if n > 1:
        out[:64] = np.sqrt(np.bincount(c[:-1] * np.uint8(8) + c[1:], minlength=64) / (n - 1))
    out[64 : 64 + len(_MARKS)] = np.sqrt(np.bincount(x, minlength=256)[_MARKS] / n)
    words = data.split()
    w = max(len(words), 1)
    again = sum(map(eq, words, words[1:]))
    out[-5:] = np.log1p(n) / 10, min(n / w, 50.0) / 10, np.log1p(w) / 10, np.sqrt(again / w), len(set(words)) / w
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_step(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk of positives as such, rest of the risk, and the step's gradient by the scores of positives and unlabelled rows."""
    softplus = lambda z: np.logaddexp(0, z)
    rest = softplus(zu).mean() - prior * softplus(zp).mean()
    as_positive = -prior * (1 - _sigmoid(zp)) / len(zp)
    gp, gu = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    return prior * softplus(-zp).mean(), rest, *((as_positive + gp, gu) if rest >= 0 else (-gp, -gu))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 1e-2) -> Model:
    """Full-batch Adam on the non-negative risk; no random numbers."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + FLOOR
    p, u = (np.clip((a - mean) / scale, -6, 6) for a in (positive.astype(np.float64), unlabelled.astype(np.float64)))
    x = np.zeros(p.shape[1] + 1)
    m, v, late = (np.zeros_like(x) for _ in range(3))
    for t in range(1, steps + 1):
        w, b = x[:-1], x[-1]
        _, _, gp, gu = risk_step(p @ w + b, u @ w + b, prior)
        g = np.append(gp @ p + gu @ u + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        late += x * (t > steps // 2)
    x = late / (steps - steps // 2)
    return Model(mean, scale, x[:-1], x[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows; 0.5 where there is but one positive."""
    if len(positive) < 2:
        return 0.5
    found = []
    for seen, rest in ((positive[::2], positive[1::2]), (positive[1::2], positive[::2])):
        model = train(seen, unlabelled, 0.5)
        of_rest, of_all = model.score(rest.astype(np.float64)), model.score(unlabelled.astype(np.float64))
        cuts = np.quantile(of_rest, np.linspace(0.05, 0.5, 10))
        found.append(min((of_all >= c).mean() / ((of_rest >= c).mean() + len(rest) ** -0.5) for c in cuts))
    return float(np.clip(np.mean(found), 0.05, 0.95))


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _with_features(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_buffer().to_pybytes() if t.is_valid else b"").tobytes() for t in b.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(x, pa.binary())], names=schema.names)

    ship_package(docs.sparkSession)
    return docs.select(*columns, F.col(text_col).alias("__text")).mapInArrow(tidy("quality", run), schema)


def _drawn(ids: DataFrame, id_col: str, seed: int, sample: int) -> DataFrame:
    """The ``sample`` ids whose hashes are lowest."""
    rank = F.xxhash64(F.col(id_col), F.lit(seed))
    # Twice the share that is needed is sorted, not all ids.
    share = 2 * sample / max(ids.count(), 1)
    near = ids.where(rank < int((share - 0.5) * (1 << 64))) if share < 0.5 else ids
    return near.distinct().orderBy(rank, id_col).limit(sample)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Train on positives and on documents outside the held-out fold; None where there is no positive."""
    ids = docs.select(id_col).where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    # Labels are joined by id: an id is positive if any of its labels is.
    trusted = labels.where("quality = 1").select(id_col).where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).distinct()
    chosen = _drawn(trusted, id_col, 17, sample).withColumn("positive", F.lit(1)).unionByName(_drawn(ids, id_col, 29, sample).withColumn("positive", F.lit(0)))
    found = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    # One text an id, however often the id is repeated.
    picked = found.groupBy("positive", id_col).agg(F.min("text").alias("text"))
    rows = _with_features(picked, ["positive", id_col], "text").orderBy("positive", id_col).select("positive", "x").collect()  # at most 2 * sample rows of 400 bytes
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, N_FEATURES)
    positive = np.array([r["positive"] == 1 for r in rows], bool)
    if not positive.any() or positive.all():
        return None
    return train(x[positive], x[~positive], estimate_prior(x[positive], x[~positive]))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` (or the columns ``keep``) with the score as column ``name``."""
    keep = [c for c in (keep or docs.columns) if c != name]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None or not b.num_rows:
                s = np.full(b.num_rows, 0.5)
            else:
                s = model.score(np.stack([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(len(keep))]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64())], names=schema.names)

    ship_package(docs.sparkSession)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tidy("quality", run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    scored = score(docs, fit(docs, labels, id_col, text_col), text_col, keep)
    return scored.withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    name = private("__score", docs.columns)
    return score(docs, fit(docs, labels, id_col, text_col), text_col, name=name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def crc32_fold(doc_id: int) -> int:
    """The fold as plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
