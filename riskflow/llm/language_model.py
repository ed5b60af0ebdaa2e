"""Language-model scoring with a weighted backoff automaton.

Tokens are words (A-Z lower-cased) and one end token per text.  Training counts come from all
texts but the held-out ones.  The model: every word has its additively smoothed unigram
probability; words seen at least ``FLOOR`` times are states.  Contexts of one and of two state words
have arcs to the state words and the end token that followed them at least ``MIN_COUNT`` times in
training, with absolute discounting; the mass left over goes to a failure arc to the shorter
context.  For any context all probabilities add up to one.  Both limits are absolute counts, so states
and arcs grow with the corpus; ``shares`` (none by default) raise the limit of the states, and of both
words of a two-word context, to a share of the training tokens, for a smaller model.

A block of texts (``BLOCK_TOKENS`` tokens) is encoded once: distinct words and their codes.  For
its words, then for its pairs, then for the triples whose pairs both are kept, a block sends sorted
hashes and counts, cut into ranges of the hash (``BUCKET_TOKENS`` tokens of the corpus a range); a range sums them over all blocks and answers
in the order asked, without the hashes.  The failure weights need all arcs of a context: the first
block that holds an n-gram adds it to its context, and the contexts' sums are asked for in the same
way.  So a block's automaton is bounded by the block and nothing grows in the driver or in a
broadcast.  All texts of a block then run through its automaton together,
from left to right: a state is carried, a missing arc follows failure arcs, and the
log-probabilities are added up.

Null and empty texts consist of the end token.  A null doc_id is not held out.  Without training
tokens every probability is 1 / 1 (score 0).  Repeated rows count and are scored each.  Only
``doc_id`` and ``text`` are read.  Words and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.blocks import LOWER, Prefix, blocks, discard, mix, stored, words

ADD = 0.1
FLOOR = 5  # least count of a state word
WHOLE = (0.0, 0.0)  # least shares of all tokens, for states and for words of two-word contexts: FLOOR alone decides
MIN_COUNT = 2
DISCOUNT = 0.5
BLOCK_TOKENS = 1_500_000
BUCKET_TOKENS = 1_000_000
SEGMENT = 512  # tokens that a text advances as one
_U = np.uint64
END = np.uint64(0x0123456789ABCDEF)


def _pack(x: np.ndarray) -> bytes:
    """Compressed by planes: the first bytes of all numbers, then the second ones."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _steps(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def _encoded(docs: DataFrame) -> DataFrame:
    """One row a block: documents, their token counts, distinct words with training counts and codes, packed."""
    schema = "blk long, doc_id array<long>, held array<boolean>, size array<int>, n_words int, words binary, train binary, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        toks, sizes, ids, helds = [], [], [], []

        def row() -> pa.RecordBatch:
            size, held = np.concatenate(sizes), np.concatenate(helds)
            w, codes = np.unique(np.concatenate(toks), return_inverse=True)
            train = np.bincount(codes[np.repeat(~held, size)], minlength=len(w))
            one = lambda x, t: pa.array([x], pa.list_(t))
            return pa.RecordBatch.from_arrays([
                pa.array([part << 32 | seq]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), one(held, pa.bool_()), one(size.astype(np.int32), pa.int32()),
                pa.array([len(w)], pa.int32()), *(pa.array([_pack(y)], pa.binary()) for y in (_steps(w), train.astype(np.int64), codes.astype(np.int32))),
            ], ["blk", "doc_id", "held", "size", "n_words", "words", "train", "codes"])

        for b in blocks(batches):
            s, e, doc = words(b)
            h = Prefix(LOWER[b.data]).sub(s, e)
            n = np.bincount(doc, minlength=b.n)
            toks.append(np.insert(h, np.cumsum(n), END))
            sizes.append(n + 1)
            ids.append(b.cols["doc_id"].cast(pa.int64()))
            helds.append(np.asarray(b.cols["held"].to_numpy(zero_copy_only=False), bool))
            if sum(map(len, toks)) >= BLOCK_TOKENS:
                yield row()
                seq += 1
                toks, sizes, ids, helds = [], [], [], []
        if toks:
            yield row()

    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 10 = 0, false)").alias("held")
    return docs.select("doc_id", "text", held).mapInArrow(run, schema)


ASKED = "blk long, bucket int, n int, keys binary, sums binary"
ANSWER = "blk long, bucket int, n int, sums binary, first binary, total long, present long"


def _ask(blk: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Requests of a block for the sums over its sorted keys, one for each range of the hash."""
    of = (keys >> _U(32)) * _U(buckets) >> _U(32)
    ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1 if len(of) else []
    lo = 0
    for hi in ends:
        sums = _pack(np.concatenate([c[lo:hi] for c in columns]))
        yield pa.RecordBatch.from_arrays([pa.array([blk]), pa.array([int(of[lo])], pa.int32()), pa.array([int(hi - lo)], pa.int32()), pa.array([_pack(_steps(keys[lo:hi]))], pa.binary()), pa.array([sums], pa.binary())],
                                         ["blk", "bucket", "n", "keys", "sums"])
        lo = hi


def _summed(asked: DataFrame, columns: int, least: int) -> DataFrame:
    """For each request the sums of its keys over all blocks (0 below ``least``), whether the block is the first with
    the key, and over those keys the total of the first sum and how many have one."""

    def run(x: pa.Table) -> pa.Table:
        x = x.sort_by("blk")
        n = x.column("n").to_pylist()
        key = np.concatenate([np.cumsum(_unpack(r.as_py(), np.uint64, k), dtype=np.uint64) for r, k in zip(x.column("keys"), n, strict=True)])
        got = [_unpack(r.as_py(), np.int64, k * columns).reshape(columns, k) for r, k in zip(x.column("sums"), n, strict=True)]
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        starts = np.flatnonzero(new)
        of = np.empty(len(key), np.int64)
        of[order] = np.cumsum(new) - 1
        first = np.zeros(len(key), bool)
        first[order[starts]] = True
        sums = np.stack([np.add.reduceat(np.concatenate([g[k] for g in got])[order], starts) for k in range(columns)])
        sums[:, sums[0] < least] = 0
        got = sums[0, of]
        ends = np.cumsum(n)
        parts = [slice(e - k, e) for e, k in zip(ends, n, strict=True)]
        return pa.table([x.column("blk"), x.column("bucket"), x.column("n"), pa.array([_pack(np.ascontiguousarray(sums[:, of[p]]).reshape(-1)) for p in parts], pa.binary()),
                         pa.array([_pack(first[p]) for p in parts], pa.binary()),
                         pa.array([int(got[p][first[p]].sum()) for p in parts], pa.int64()), pa.array([int((got[p][first[p]] > 0).sum()) for p in parts], pa.int64())],
                        ["blk", "bucket", "n", "sums", "first", "total", "present"])

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def _answer(x: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (a row each column) and first marks of a block, in the order of its keys."""
    x = x.sort_by("bucket")
    n = x.column("n").to_pylist()
    sums = [_unpack(r.as_py(), np.int64, k * columns).reshape(columns, k) for r, k in zip(x.column("sums"), n, strict=True)]
    first = [_unpack(r.as_py(), np.bool_, k) for r, k in zip(x.column("first"), n, strict=True)]
    return np.concatenate([np.zeros((columns, 0), np.int64), *sums], 1), np.concatenate([np.zeros(0, bool), *first])


def _match(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _counted(enc: DataFrame, counts: DataFrame, total: int, distinct: int, least: float) -> DataFrame:
    """Per block: base scores of its documents, and its text over state words only (0 stands for any other word)."""
    schema = "blk long, doc_id array<long>, held array<boolean>, size array<int>, known array<int>, base array<double>, n_states int, states binary, count binary, codes binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = {c: left.column(c)[0] for c in left.schema.names}
        w = np.cumsum(_unpack(x["words"].as_py(), np.uint64, x["n_words"].as_py()), dtype=np.uint64)
        size = np.asarray(x["size"].values).astype(np.int64)
        codes = _unpack(x["codes"].as_py(), np.int32, int(size.sum()))
        c = _answer(right, 1)[0][0]
        logp = np.log10((c + ADD) / (total + ADD * (distinct + 1)))
        doc = np.repeat(np.arange(len(size)), size)
        base = np.bincount(doc, logp[codes], len(size))
        known = np.bincount(doc, (c > 0)[codes], len(size)).astype(np.int32)
        state = np.flatnonzero((c >= least) | (w == END))
        number = np.zeros(len(w), np.int32)
        number[state] = np.arange(1, len(state) + 1)
        one = lambda v, t: pa.array([v], pa.list_(t))
        return pa.table([pa.array([x["blk"].as_py()]), left.column("doc_id").combine_chunks(), left.column("held").combine_chunks(), left.column("size").combine_chunks(),
                         one(known, pa.int32()), one(base, pa.float64()), pa.array([len(state)], pa.int32()), *(pa.array([_pack(y)], pa.binary()) for y in (_steps(w[state]), c[state], number[codes]))],
                        ["blk", "doc_id", "held", "size", "known", "base", "n_states", "states", "count", "codes"])

    left = enc.drop("train")
    return left.groupBy("blk").cogroup(counts.groupBy("blk")).applyInArrow(run, schema)


class _Grams:
    """The n-grams over state words that occur in a block: symbol rows, hashed keys in order and training counts.

    A pair is a * base + v, a triple (row of its leading pair) * base + z; ``lead`` and ``suffix`` are the rows of a
    triple's pairs.  A triple occurs no more often than its pairs, so only kept pairs are put together to triples.
    """

    def __init__(self, hashes: np.ndarray, count: np.ndarray, codes: np.ndarray, size: np.ndarray, held: np.ndarray, wide: float):
        h = np.concatenate([np.zeros(1, np.uint64), hashes])
        base = len(h)
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.trained = ~held[doc]
        word = self.word = np.zeros(base, bool)  # may stand in a context: any state word, the end token not
        word[1:] = hashes != END
        self.often = word.copy()
        self.often[1:] &= count >= wide
        at = np.flatnonzero(word[codes[:-1]] & (codes[1:] > 0) & (doc[1:] == doc[:-1]))
        two, back, t2 = self._distinct(codes[at].astype(np.int64) * base + codes[at + 1], self.trained[at])
        self.row = np.full(len(codes), -1, np.int32)  # pair that begins at a token
        self.row[at] = back
        self.codes, self.base, self.h, self.count = codes, base, h, np.concatenate([np.zeros(1, np.int64), count])
        self.a, self.v = (two // base).astype(np.int32), (two % base).astype(np.int32)
        self.key2 = mix(h[self.a] * _U(3) + h[self.v])
        self.order2 = np.argsort(self.key2)
        self.keys2, self.t2 = self.key2[self.order2], t2[self.order2]

    def triples(self, c2: np.ndarray) -> None:
        row, often = self.row, self.often
        kept = np.append(c2 > 0, False)[row]  # row -1: no pair
        at = np.flatnonzero(kept[:-1] & kept[1:] & often[self.codes[:-1]] & often[self.codes[1:]])
        three, back, t3 = self._distinct(row[at].astype(np.int64) * self.base + self.codes[at + 2], self.trained[at])
        self.suffix = np.zeros(len(three), np.int32)
        self.suffix[back] = row[at + 1]
        self.lead, self.z = (three // self.base).astype(np.int32), (three % self.base).astype(np.int32)
        key3 = mix(self.key2[self.lead] * _U(5) + self.h[self.z])
        self.order3 = np.argsort(key3)
        self.keys3, self.t3 = key3[self.order3], t3[self.order3]
        del self.row, self.trained

    @staticmethod
    def _distinct(key: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got, back = np.unique(key, return_inverse=True)
        return got, back, np.bincount(back[trained], minlength=len(got)).astype(np.int64)

    def contexts(self, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and pairs that a text of the block may stand behind and that may have arcs in the corpus: all state words and all kept pairs of them."""
        return np.flatnonzero(self.word), np.flatnonzero((c2 > 0) & self.often[self.a] & self.often[self.v])


def _block(x: dict, wide: float) -> tuple[_Grams, np.ndarray, np.ndarray]:
    size = np.asarray(x["size"].values).astype(np.int64)
    codes = _unpack(x["codes"].as_py(), np.int32, int(size.sum()))
    held = np.asarray(x["held"].values.to_numpy(zero_copy_only=False), bool)
    n = x["n_states"].as_py()
    count = _unpack(x["count"].as_py(), np.int64, n)
    return _Grams(np.cumsum(_unpack(x["states"].as_py(), np.uint64, n), dtype=np.uint64), count, codes, size, held, wide), codes, size


def _word_requests(enc: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blk, n, w, t in zip(*(batch.column(c).to_pylist() for c in ("blk", "n_words", "words", "train")), strict=True):
                yield from _ask(blk, np.cumsum(_unpack(w, np.uint64, n), dtype=np.uint64), [_unpack(t, np.int64, n)], buckets)

    return enc.select("blk", "n_words", "words", "train").mapInArrow(run, ASKED)


def _pair_requests(counted: DataFrame, buckets: int, wide: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(c)[i] for c in batch.schema.names}
                g, _, _ = _block(x, wide)
                yield from _ask(x["blk"].as_py(), g.keys2, [g.t2], buckets)

    return counted.mapInArrow(run, ASKED)


def _in_order(order: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """An answer in the order of the sorted keys, put back."""
    out = np.empty_like(answer)
    out[order] = answer
    return out


def _table(rows: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(rows) if rows else pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())], ["blk", "bucket", "n", "keys", "sums"])


def _triple_requests(counted: DataFrame, pairs: DataFrame, buckets: int, wide: float) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = {c: left.column(c)[0] for c in left.schema.names}
        g, _, _ = _block(x, wide)
        g.triples(_in_order(g.order2, _answer(right, 1)[0][0]))
        return _table(list(_ask(x["blk"].as_py(), g.keys3, [g.t3], buckets)))

    return counted.groupBy("blk").cogroup(pairs.groupBy("blk")).applyInArrow(run, ASKED)


def _known(g: _Grams, answers: pa.Table) -> tuple[np.ndarray, ...]:
    """Counts of pairs and of triples, and whether the block is the first to hold them."""
    of = lambda k: _answer(answers.filter(pc.equal(answers.column("kind"), k)), 1)
    (c2,), own2 = of(2)
    c2, own2 = _in_order(g.order2, c2), _in_order(g.order2, own2)
    g.triples(c2)
    (c3,), own3 = of(3)
    return c2, own2, _in_order(g.order3, c3), _in_order(g.order3, own3)


def _context_keys(g: _Grams, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    one, two = g.contexts(c2)
    key = np.concatenate([g.h[one], g.key2[two]])
    order = np.argsort(key)
    return one, two, order, key[order]


def _context_requests(counted: DataFrame, grams: DataFrame, buckets: int, wide: float) -> DataFrame:
    """Number of arcs, sum of their counts and sum of the counts one context shorter, of the arcs that a block holds first."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = {c: left.column(c)[0] for c in left.schema.names}
        g, _, _ = _block(x, wide)
        c2, own2, c3, own3 = _known(g, right)
        own2, own3 = own2 & (c2 > 0), own3 & (c3 > 0)
        one, two, order, keys = _context_keys(g, c2)

        def add(of: np.ndarray, own: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
            out = np.zeros(n, np.int64)
            np.add.at(out, of[own], w[own])
            return out

        columns = [np.concatenate([add(g.a, own2, g.base, w2)[one], add(g.lead, own3, len(g.a), w3)[two]])[order]
                   for w2, w3 in ((np.ones_like(c2), np.ones_like(c3)), (c2, c3), (g.count[g.v], c2[g.suffix]))]
        return _table(list(_ask(x["blk"].as_py(), keys, columns, buckets)))

    return counted.groupBy("blk").cogroup(grams.groupBy("blk")).applyInArrow(run, ASKED)


class Automaton:
    """States: 0 the empty context, then the state words, then the two-word contexts with arcs; failure arcs lead to
    the shorter context.  Weights are relative to the unigram log-probability of the token read."""

    def __init__(self, g: _Grams, c2: np.ndarray, c3: np.ndarray, sums: np.ndarray, total: int, distinct: int, discount: float = DISCOUNT):
        base, count, z = g.base, g.count, total + ADD * (distinct + 1)
        unigram = np.log10((count + ADD) / z)
        one, two, order, _ = _context_keys(g, c2)
        n, own, low = np.empty_like(sums)[:3]
        n[order], own[order], low[order] = sums
        arcs = n > 0
        back = np.zeros(len(n))
        size = np.concatenate([count[one], c2[two]])
        short = np.concatenate([(low[:len(one)] + ADD * n[:len(one)]) / z, (low[len(one):] - discount * n[len(one):]) / count[g.v[two]]])
        back[arcs] = np.log10((1 - (own - discount * n)[arcs] / size[arcs]) / (1 - short[arcs]))
        deep = two[arcs[len(one):]]
        place = np.zeros(len(g.a), np.int64)  # of a pair among the two-word contexts with arcs, from 1
        place[deep] = np.arange(1, len(deep) + 1)
        self.base = base
        self.fail = np.zeros(base + len(deep), np.int64)
        self.fail[base:] = g.v[deep]
        self.fail_w = np.zeros(base + len(deep))
        self.fail_w[one] = back[:len(one)]
        self.fail_w[base:] = back[len(one):][arcs[len(one):]]
        to = np.where(place > 0, base + place - 1, g.v)  # the deepest state after a pair
        k2, k3 = np.flatnonzero(c2), np.flatnonzero(c3)
        # arcs by state * base + symbol
        arc = np.concatenate([g.a[k2].astype(np.int64) * base + g.v[k2], (base + place[g.lead[k3]] - 1) * base + g.z[k3]])
        w = np.concatenate([np.log10((c2[k2] - discount) / count[g.a[k2]]) - unigram[g.v[k2]], np.log10((c3[k3] - discount) / c2[g.lead[k3]]) - unigram[g.z[k3]]])
        order = np.argsort(arc)
        self.arc, self.w, self.to = arc[order], w[order], np.concatenate([to[k2], to[g.suffix[k3]]])[order]

    def run(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sum of the weights of each text.  A state is the last two words at most, so texts are cut into segments that
        begin two words early, which find the state and do not count; segments advance together, the longest first."""
        many = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), many)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
        early = np.where(at > 0, 2, 0)
        first, left = (np.cumsum(size) - size)[doc] + at - early, np.minimum(size[doc] - at, SEGMENT) + early
        order = np.argsort(-left, kind="stable")
        first, left, early = first[order], left[order], early[order]
        state, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
        live = len(doc)
        for k in range(int(left[0]) if len(left) else 0):
            while live and left[live - 1] <= k:
                live = int(np.searchsorted(-left, -k, "left"))
            if k == 2:
                total[early == 2] = 0
            x = codes[first[:live] + k].astype(np.int64)
            now = state[:live]
            todo = np.flatnonzero(now)
            now_next = x.copy()  # from the empty context: the state of the word read, or the empty one
            while len(todo):
                at, there = _match(self.arc, now[todo] * self.base + x[todo])
                there &= x[todo] > 0
                hit = todo[there]
                total[hit] += self.w[at[there]]
                now_next[hit] = self.to[at[there]]
                todo = todo[~there]
                total[todo] += self.fail_w[now[todo]]
                now[todo] = self.fail[now[todo]]
                todo = todo[now[todo] > 0]
            state[:live] = now_next
        return np.bincount(doc[order], total, len(size))


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is stored meanwhile go when it is written: the tables stand for them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _gathered(docs: DataFrame, shares) -> tuple[DataFrame, DataFrame, int, int, int, float]:
    """Blocks over state words, answers for their n-grams (kind 2 and 3), training tokens, distinct words, ranges, least count in two-word contexts."""
    enc = stored(_encoded(docs))
    tokens = enc.agg(F.sum(F.expr("aggregate(size, 0L, (a, x) -> a + x)"))).first()[0] or 0
    buckets = tokens // BUCKET_TOKENS + 1
    counts = stored(_summed(_word_requests(enc, buckets), 1, 0))
    n, v = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("present"), F.lit(0))).first()
    least, wide = (max(FLOOR, s * n) for s in shares)
    counted = stored(_counted(enc, counts, n, v, least))
    discard(enc, counts)
    pairs = stored(_summed(_pair_requests(counted, buckets, wide), 1, MIN_COUNT))
    triples = stored(_summed(_triple_requests(counted, pairs, buckets, wide), 1, MIN_COUNT))
    return counted, pairs.withColumn("kind", F.lit(2)).unionByName(triples.withColumn("kind", F.lit(3))), n, v, buckets, wide


def score(docs: DataFrame, shares=WHOLE) -> DataFrame:
    """Base and model log10 probabilities of every document."""
    with _cleaned(docs.sparkSession):
        counted, grams, n, v, buckets, wide = _gathered(docs, shares)
        contexts = stored(_summed(_context_requests(counted, grams, buckets, wide), 3, 0))
    answers = grams.unionByName(contexts.withColumn("kind", F.lit(0)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = {c: left.column(c)[0] for c in left.schema.names}
        g, codes, size = _block(x, wide)
        c2, _, c3, _ = _known(g, right)
        sums, _ = _answer(right.filter(pc.equal(right.column("kind"), 0)), 3)
        del right, g.keys2, g.t2, g.order2, g.keys3, g.t3, g.order3  # their memory is wanted by the automaton
        model = Automaton(g, c2, c3, sums, n, v)
        base = np.asarray(x["base"].values)
        rows = len(size)
        return pa.table([x["doc_id"].values, x["held"].values, pa.array(size), pa.array(np.asarray(x["known"].values).astype(np.int64)), pa.array(np.full(rows, n)), pa.array(base), pa.array(base + model.run(codes, size))],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(run, SCHEMA)
