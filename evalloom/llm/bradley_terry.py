"""Quality scores learned from preference pairs (Bradley-Terry).

A document of label 1 is preferred over a document of label 0. The chance that
document i is preferred over j is sigmoid(s_i - s_j) with s = w . x; w minimises
the logistic loss on feature differences over deterministic pairs. The
threshold is the quantile of the training scores that leaves the share of label
1 above it; scores are shifted so that this quantile becomes 0.3.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import python_ready
from evalloom.llm.profile import rule_counts

#: Labelled rows that the fit uses at most; those whose ids have the smallest hashes.
MAX_TRAIN_ROWS = 20_000
MAX_PAIRS = 200_000
CUT = 0.3
FEATURES = ("log_words", "word_length", "distinct", "repeated", "dup_lines", "symbols", "upper", "digits", "bars", "bangs", "stops", "commas", "lines", "high")

_CLASSES = [b"#*$%&<>", bytes(range(65, 91)), b"0123456789", b"|", b"!", b".?", b",;:", b"\n", bytes(range(128, 256))]
_MASKS = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _MASKS[list(_c), _k] = 1


def features(text: bytes) -> list[float]:
    """The features of one text; an empty one has all zeros."""
    words, spaces, _, dup, repeat, distinct = rule_counts(text)
    if not words:
        return [0.0] * len(FEATURES)
    size = len(text) - spaces
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MASKS) / len(text)
    symbols, upper, digits, bars, bangs, stops, commas, lines, high = shares.tolist()
    return [math.log1p(words), size / words / 10, distinct / words, repeat / words, dup / words, symbols, upper, digits, bars, bangs, stops, commas, lines, high]


def _featured(batches):
    for batch in batches:
        rows = [features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("_bytes")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def featured(docs: DataFrame) -> DataFrame:
    python_ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("_bytes")).mapInArrow(_featured, f"doc_id {kind}, x array<double>")


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher where label 1 is likelier; ``CUT`` at the threshold."""
        s = ((x - self.mean) / self.scale) @ self.weights - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def fit(x: np.ndarray, label: np.ndarray, penalty: float = 1e-3, steps: int = 30) -> Ranker:
    """Newton steps on the mean logistic loss over pairs; without both labels all scores are equal."""
    if not len(x) or label.min() == label.max():
        return Ranker(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    n = min(MAX_PAIRS, len(good) * len(bad))
    k = np.arange(n)
    # walks both lists at different strides, so that the pairs differ and every row takes part
    d = z[good[k % len(good)]] - z[bad[(k + k // math.lcm(len(good), len(bad))) % len(bad)]]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        gradient = -(d * p[:, None]).mean(0) + penalty * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = ((x - mean) / scale) @ w
    return Ranker(mean, scale, w, float(np.quantile(s, float((label == 0).mean()))))


def held_out(doc_id) -> F.Column:
    """Rows that no fit may learn from: crc32 of the id as text, divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Ranker:
    """Fit on at most ``max_rows`` labelled documents that are not held out; rows without label or id are left out.

    Of rows that repeat an id the one with the smallest features counts, so what
    is collected is bounded by ``max_rows``.
    """
    marked = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded, so it can be broadcast
    chosen = docs.join(F.broadcast(marked), "doc_id").select("doc_id", "text", "_label")
    once = featured(chosen.select("doc_id", "text")).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = once.join(F.broadcast(marked), "doc_id").orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["_label"] for r in rows], int))


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts are scored like any other."""
    python_ready(docs.sparkSession)

    def run(batches):
        for batch in _featured(batches):
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranker.score(flat), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_bytes")).mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
