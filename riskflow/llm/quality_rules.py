"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Byte n-grams of every text are hashed into ``BUCKETS`` bins.  Two smoothed multinomials are
estimated: one over all documents (raw), one over all trusted documents (labels with quality 1).
A document's score is the mean over its n-grams of log p(target) - log p(raw); the same threshold
decides for every document.  Fixed base rules come first.

Nulls and empty texts have no words and fail the base rules.  Without trusted documents every
score is 0 and only the base rules decide.  Repeated rows are judged one by one; input columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.blocks import SPACE, Block, Prefix, between, blocks, mix, repeated, words

BUCKETS = 1 << 16
GRAMS = (3, 4)
THRESHOLD = -0.4
SMOOTH = 1.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


def base_stats(b: Block) -> dict[str, np.ndarray]:
    """Word, symbol, repeated-line and repeated-phrase counts of each document of a block."""
    s, e, doc = words(b)
    pre = Prefix(b.data)
    solid = ~SPACE[b.data]
    h = pre.sub(s, e)
    line_end = np.flatnonzero(b.data == 10)
    full = b.off[1:] > b.off[:-1]
    ls = np.unique(np.concatenate([b.off[:-1][full], line_end + 1]))
    ls = ls[ls < len(b.data)]
    ld = np.searchsorted(b.off, ls, "right") - 1
    nxt = np.searchsorted(line_end, ls)
    le = np.minimum(np.append(line_end, len(b.data))[nxt], b.off[ld + 1]) if len(ls) else ls
    worded = between(solid, ls, le) > 0
    ls, le, ld = ls[worded], le[worded], ld[worded]
    _, late = repeated(mix(pre.sub(ls, le) + mix(ld.astype(np.uint64))) + (le - ls).astype(np.uint64))
    inside = np.zeros(len(h), bool)
    if len(h) > 2:
        whole = doc[2:] == doc[:-2]
        key = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) ^ mix(doc[2:].astype(np.uint64) + _U(1))
        at = np.flatnonzero(whole)
        hot = at[repeated(key[at])[0]]
        for k in range(3):
            inside[hot + k] = True
    count = lambda d, w=None: np.bincount(d, weights=w, minlength=b.n).astype(np.int64)
    return {
        "n_words": count(doc),
        "word_chars": b.per_doc(solid & ((b.data & 0xC0) != 0x80)),
        "n_symbols": b.per_doc(_SYMBOL[b.data]),
        "n_dup_lines": count(ld[late]),
        "n_repeat_words": count(doc[inside]),
    }


def grams(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every byte n-gram; n-grams do not cross documents."""
    out, docs = [], []
    doc = np.repeat(np.arange(b.n, dtype=np.int32), np.diff(b.off))
    x = b.data.astype(np.uint32)
    for n in GRAMS:
        if len(x) < n:
            continue
        key = x[:len(x) - n + 1].copy()
        for k in range(1, n):
            key |= x[k:len(x) - n + 1 + k] << np.uint32(8 * k)
        whole = doc[:len(key)] == doc[n - 1:]
        key = (key + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        key = (key ^ (key >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        out.append((key >> np.uint32(16))[whole])
        docs.append(doc[:len(key)][whole])
    return (np.concatenate(out), np.concatenate(docs)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) of every bucket; one row a bucket reaches the driver."""
    trusted = labels.where(F.col("quality") == 1).select("doc_id").where("doc_id is not null").distinct()
    marked = docs.select("doc_id", "text").join(trusted.withColumn("trusted", F.lit(True)).hint("shuffle_hash"), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in blocks(batches):
            g, doc = grams(b)
            raw += np.bincount(g, minlength=BUCKETS)
            of = np.asarray(b.cols["trusted"].to_numpy(zero_copy_only=False), bool)
            target += np.bincount(g[of[doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    rows = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k, a, t in rows:
        raw[k], target[k] = a, t
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base verdict, likelihood ratio per n-gram and final verdict of every document."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            st = base_stats(b)
            g, doc = grams(b)
            n = np.bincount(doc, minlength=b.n)
            llr = np.bincount(doc, weights=ratio.value[g], minlength=b.n) / np.maximum(n, 1)
            failed = (st["n_words"] < 50) | (100 * st["n_repeat_words"] > 50 * st["n_words"])
            yield pa.RecordBatch.from_arrays(
                [b.cols["doc_id"].cast(pa.int64())] + [pa.array(v) for v in st.values()] + [pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr)],
                ["doc_id", *st, "base_failed", "kept", "llr"])

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)
