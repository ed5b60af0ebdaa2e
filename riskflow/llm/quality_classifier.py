"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled diagonal.  The Cholesky factors
are computed once; a document's score is the logistic function of the difference of the two
Mahalanobis log-densities plus the log prior ratio.

Class sums are taken over every labelled training row inside Spark (two rows reach the
driver).  Null and empty texts have all statistics 0 and are scored like any other.  Without
labels of one class the score is the share of label 1 (0.5 without labels).  A document with
several label rows counts once for each in training.  Only ``doc_id`` and ``text`` of the
documents are read; the id serves the join with the labels, never the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.blocks import LOWER, SPACE, Block, Prefix, blocks, stored, words

SHRINK = 0.2
RIDGE = 1e-3
CUT = 0.3
DAMP = 30  # bytes of ordinary text that every text counts as having besides: short texts give no extreme ratios
NAMES = ("log_words", "word_len", "symbols", "marks", "upper", "stutter", "line_words", "stops")

_MARK, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(3))
_MARK[list(b"!?")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_STOP[list(b".,;:")] = True


def statistics(b: Block) -> np.ndarray:
    """One row of transformed statistics for each document of a block."""
    s, e, doc = words(b)
    n, chars = np.bincount(doc, minlength=b.n), b.per_doc(~SPACE[b.data]) + DAMP
    per = lambda mask, by: b.per_doc(mask) / by
    size = (e - s).astype(float)
    mean = (np.bincount(doc, size, b.n) + DAMP) / (n + DAMP / 6)
    h = Prefix(LOWER[b.data]).sub(s, e)
    twice = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=b.n) if len(h) else np.zeros(b.n)
    root = np.sqrt
    return np.stack([
        np.log1p(n), np.log1p(mean), root(per(_SYMBOL[b.data], chars)), root(per(_MARK[b.data], chars)), root(per(_UPPER[b.data], chars)),
        root(twice / (n + DAMP / 6)), np.log1p(n / (b.per_doc(b.data == 10) + 1)), root(per(_STOP[b.data], chars)),
    ], axis=1)


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            x = statistics(b)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.cols["doc_id"].cast(pa.int64()), flat], ["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f array<double>")


class Discriminant:
    """Two Gaussian classes with cached factors; ``share`` stands in when a class is missing."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE):
        total = sum(v[0] for v in sums.values())
        self.share = sums[1][0] / total if total and 1 in sums else 0.0 if total else 0.5
        self.parts = None
        if all(sums.get(k, (0,))[0] >= 2 for k in (0, 1)):
            stats = {k: (n, s / n, q / n - np.outer(s / n, s / n)) for k, (n, s, q) in sums.items()}
            pooled = np.diag(sum(n * np.diag(c) for n, _, c in stats.values()) / total)
            ridge_m = ridge * np.eye(len(pooled))
            self.parts = []
            for k in (1, 0):
                n, mean, cov = stats[k]
                factor = np.linalg.cholesky((1 - shrink) * cov + shrink * pooled + ridge_m)
                self.parts.append((mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        one, zero = (prior - logdet - 0.5 * (((x - mean) @ inv.T) ** 2).sum(1) for mean, inv, logdet, prior in self.parts)
        return 1 / (1 + np.exp(-np.clip(one - zero, -500, 500)))


def fit(feats: DataFrame, labels: DataFrame) -> Discriminant:
    """Class sums over the training rows: labelled and crc32(doc_id as text) mod 5 not 0."""
    k = len(NAMES)
    rows = labels.select("doc_id", F.col("quality").alias("y")).where("doc_id is not null and y in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").join(feats, "doc_id")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.groupBy("y").agg(
        F.count(F.lit(1)), *[F.sum(F.col("f")[i]) for i in range(k)], *[F.sum(F.col("f")[i] * F.col("f")[j]) for i, j in pairs]).collect()
    sums = {}
    for y, n, *v in got:
        q = np.zeros((k, k))
        for (i, j), x in zip(pairs, v[k:], strict=True):
            q[i, j] = q[j, i] = x
        sums[int(y)] = (float(n), np.array(v[:k]), q)
    return Discriminant(sums)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    feats = stored(features(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit(feats, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = feats.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out"), "score", "predicted")
