"""Benchmark decontamination by spaced-seed hashing.

Texts become tokens (runs of ASCII letters and digits, A-Z lower-cased, and bytes over 127; the
rest separates).  A fixed mask lays over ``SPAN`` tokens and reads only some of them; the hash of
the tokens read is the seed.  With several masks a passage is hit although some of its words were
replaced.  Benchmark seeds are joined with the seeds of the documents: the benchmark is cut into
blocks of at most ``BLOCK_TOKENS`` tokens, each is sent to the tasks as sorted arrays (a proven
size), and every document is probed whole against each block.

A hit fixes a diagonal (position in the document minus position in the item).  It is verified by
comparing tokens: among the windows of ``WINDOW`` tokens (the whole item, if shorter) on that
diagonal that contain the hit, one must agree in at least ``SAME`` of its tokens.

Items of ``MIN_TOKENS`` to ``SHORT`` - 1 tokens are sought with ``SHORT_MASKS`` as well: all masks together meet every
accepted replacement in items of 8 to 13 tokens.  Items of fewer than ``MIN_TOKENS`` tokens are
found where their whole run stands; ``matches`` reports them, while ``keep_clean`` drops documents only for items of
``least`` tokens or more, so that an item of one common word does not empty the corpus.  Null and empty texts have no
tokens and match nothing.  An item with a null item_id is sought like any other and reported as null.  Repeated
documents or items are matched each for itself.  Columns other than the ids and the texts are not read by ``matches``;
``keep_clean`` returns the documents' own columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.blocks import LOWER, Block, Prefix, blocks, flat, mix, words

MASKS = ("1110110111", "1101110111", "11101111", "1011011011101", "11111")
SPAN = max(map(len, MASKS))
WINDOW = 13
SAME = 0.8
MIN_TOKENS = 8
SHORT_MASKS = ("1111", "11011")
SHORT = 12
#: (mask, least and most tokens of the items it is laid over)
LAID = (*((m, MIN_TOKENS, None) for m in MASKS), *((m, MIN_TOKENS, SHORT - 1) for m in SHORT_MASKS), *(("1" * n, n, n) for n in range(1, MIN_TOKENS)))
BLOCK_TOKENS = 1 << 20
HITS = 1 << 18  # hits verified together
LINED_UP = 1 << 14  # hits whose tokens are laid side by side at a time
TEXT_BYTES = (1 << 20) - 2  # of the documents probed together
_U = np.uint64

SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = SEPARATOR[128:] = False


def token_hashes(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of every token; first token of each document (n + 1 entries)."""
    s, e, doc = words(b, SEPARATOR)
    return Prefix(LOWER[b.data]).sub(s, e), doc, np.searchsorted(doc, np.arange(b.n + 1))


def seeds(h: np.ndarray, doc: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed of every position at which the mask fits into the document, and those positions."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.full(n, hash_of(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            key = key * _U(0x9E3779B97F4A7C15) + h[k:k + n]
    at = np.flatnonzero(doc[:n] == doc[len(mask) - 1:])
    return mix(key[at]), at


def hash_of(mask: str) -> np.uint64:
    return _U(int(mask, 2) * 0x2545F4914F6CDD1D & (1 << 64) - 1)


class Items:
    """One block of the benchmark: its tokens, and for each mask the seeds in order with their positions."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        data, off = flat(pa.array(texts, pa.large_string()))
        h, doc, first = token_hashes(Block(data, off, {}))
        self.h, self.ids = h, pa.array(ids, pa.int64())
        size = np.diff(first)
        self.doc, self.first, self.end, self.size = doc, first[:-1], first[1:], size
        self.seeds = []
        for m, least, most in LAID:
            key, at = seeds(h, doc, m)
            fit = size[doc[at]] >= least
            if most:
                fit &= size[doc[at]] <= most
            key, at = key[fit], at[fit]
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << 22, bool)
            maybe[key >> _U(42)] = True
            self.seeds.append((m, key[order], at[order], np.packbits(maybe)))

    def match(self, h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, item rows and agreeing tokens of the verified hits."""
        found = []
        for m, keys, at, bits in self.seeds:
            maybe = np.unpackbits(bits).view(bool)
            key, pos = seeds(h, doc, m)
            some = maybe[key >> _U(42)]
            key, pos = key[some], pos[some]
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            n = hi - lo
            ends = np.cumsum(n)
            at_pos = 0
            while at_pos < len(pos):  # a seed that is frequent on both sides has many hits: they are verified in parts
                done = ends[at_pos - 1] if at_pos else 0
                stop = max(at_pos + 1, int(np.searchsorted(ends, done + HITS, "right")))
                part = slice(at_pos, stop)
                p = np.repeat(pos[part], n[part])
                q = at[np.repeat((lo - ends + n)[part], n[part]) + np.arange(done, done + len(p))]
                found.append(self._best(*self._verify(h, doc, first, p, q)))
                if len(found) > 64:
                    found = [self._joined(found)]
                at_pos = stop
        return self._joined(found)

    @staticmethod
    def _best(d: np.ndarray, i: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One row for each document and item, with the most agreeing tokens."""
        order = np.lexsort((-n, i, d))
        d, i, n = d[order], i[order], n[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
        return d[new], i[new], n[new]

    def _joined(self, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return self._best(*(np.concatenate([none, *x]) for x in zip(*found, strict=True))) if found else (none, none, none)

    def _verify(self, h, doc, first, p, q):
        d, i = doc[p], self.doc[q]
        span = np.minimum(WINDOW, self.end[i] - self.first[i])
        # tokens WINDOW before to WINDOW after the hit, outside the text or the item never equal
        offsets = np.arange(-WINDOW, 2 * WINDOW)
        best = np.zeros(len(p), np.int64)
        for lo in range(0, len(p), LINED_UP):
            part = slice(lo, lo + LINED_UP)
            a, b = p[part, None] + offsets, q[part, None] + offsets
            inside = (a >= first[d[part]][:, None]) & (a < first[d[part] + 1][:, None]) & (b >= self.first[i[part]][:, None]) & (b < self.end[i[part]][:, None])
            same = inside & (h[np.clip(a, 0, len(h) - 1)] == self.h[np.clip(b, 0, len(self.h) - 1)])
            sums = np.concatenate([np.zeros((len(same), 1), np.int64), np.cumsum(same, 1)], 1)
            w = span[part]
            for k in range(2 * WINDOW):
                z = np.minimum(k + w, len(offsets))
                best[part] = np.maximum(best[part], np.take_along_axis(sums, z[:, None], 1)[:, 0] - sums[:, k])
        good = best >= np.ceil(SAME * span - 1e-9)
        return d[good], i[good], best[good]


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, in id order; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(r.text) // 2 + 1  # tokens at most
        if ids and size + n > BLOCK_TOKENS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    if ids:
        yield Items(ids, texts)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_same (most agreeing tokens in a window) and n_item (tokens of the item) of every overlap found, one row a pair."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_same long, n_item long"
    out = spark.createDataFrame([], schema)
    for k, items in enumerate(item_blocks(benchmark)):
        sent = spark.sparkContext.broadcast(items)

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches, limit=TEXT_BYTES):
                d, i, n = sent.value.match(*token_hashes(b))
                ids = b.cols["doc_id"].cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), sent.value.ids.take(pa.array(i)), pa.array(n), pa.array(sent.value.size[i])], ["doc_id", "item_id", "n_same", "n_item"])

        part = docs.select("doc_id", "text").mapInArrow(probe, schema)
        out = out.unionByName(part) if k else part
    return out.groupBy("doc_id", "item_id").agg(F.max("n_same").alias("n_same"), F.max("n_item").alias("n_item"))


def flagged(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """doc_id and n_items of the documents with an item of at least ``least`` tokens."""
    return matches(docs, benchmark).where((F.col("n_item") >= least) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """The documents without any such overlap, all columns; a null doc_id cannot be flagged and stays."""
    return docs.join(flagged(docs, benchmark, least).select("doc_id"), "doc_id", "left_anti").select(docs.columns)
