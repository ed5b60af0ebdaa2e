"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct w-word shingles.  The sketch has ``COORDS`` coordinates: in
round i < COORDS every element goes to one hashed bin with a hashed value, and a bin keeps its
least (round, value); the rounds of a set end as soon as all its bins are filled.  Sets not
full after COORDS rounds go on with rounds that put every element into one fixed bin, so every
coordinate fills.  Coordinates of two sets agree with a probability that is their Jaccard
similarity, with concentration as for independent hash functions, at a cost of the set's size
plus COORDS log COORDS.

Sets that are equal form one class; only a class's representative (least doc_id) is compared.
``BANDS`` bands of ``ROWS`` coordinates make the candidates: a pair at similarity 0.8 shares no band
with probability (1 - 0.8^6)^48 = 5e-7.  Inside a bucket every member is first verified against
the bucket's most connected member.  Where a bucket still holds several components, its members
are joined by an exact prefix filter over their shingles, and what passes is verified.  So no pair
is emitted inside what is already one component, and no candidate that could be a link goes
unverified.  Verification compares the full sets.

Null and empty texts have empty sets and stand alone.  A text with fewer words than a shingle is
one shingle.  Repeated rows fall into one class; rows of one doc_id with different texts are
compared and grouped each by its own text.  A null doc_id stands alone with a null component.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskflow.llm.blocks import LOWER, Block, Prefix, blocks, discard, mix, stored, words
from riskflow.llm.components import components

BANDS, ROWS = 48, 6
COORDS = BANDS * ROWS
WORDS = 4
PERCENT = 80
_U = np.uint64
_EMPTY = _U((1 << 64) - 1)
_BLOCK = (1 << 20) - 2


def shingles(b: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each distinct shingle, documents in order."""
    s, e, doc = words(b)
    h = Prefix(LOWER[b.data]).sub(s, e)
    n = len(h) - width + 1
    key = np.full(max(n, 0), width, np.uint64)
    for k in range(width if n > 0 else 0):
        key = mix(key * _U(3) + h[k:k + n])
    whole = np.flatnonzero(doc[:max(n, 0)] == doc[width - 1:])
    key, of = key[whole], doc[whole]
    size = np.bincount(doc, minlength=b.n)
    short = np.flatnonzero((size > 0) & (size < width))
    if len(short):
        first = np.searchsorted(doc, short)
        one = np.zeros(len(short), np.uint64) + _U(width + 1)
        for k in range(width - 1):
            at = np.minimum(first + k, len(h) - 1)
            one = np.where(k < size[short], mix(one * _U(3) + h[at]), one)
        key, of = np.concatenate([key, one]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        key, of = key[order], of[order]
    own = mix(key + mix(of.astype(np.uint64) + _U(1)))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    first = np.zeros(len(own), bool)
    first[order[new]] = True
    return key[first], of[first]


def sketch(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x COORDS sketches; empty sets keep the empty mark."""
    out = np.full(n * COORDS, _EMPTY, np.uint64)
    size = np.bincount(doc, minlength=n)
    for i in range(2 * COORDS):
        z = mix(key ^ mix(np.full(1, i + 1, np.uint64)))
        value = (z & _U(0xFFFFFFFF)) | _U(i << 32)
        bin_ = ((z >> _U(32)) * _U(COORDS) >> _U(32)).astype(np.int64) if i < COORDS else i - COORDS
        np.minimum.at(out, doc * COORDS + bin_, value)
        if i < COORDS or i == 2 * COORDS - 1:
            lacking = (out.reshape(n, COORDS) == _EMPTY).any(1) & (size > 0)
            go = lacking[doc]
            key, doc = key[go], doc[go]
        if not len(key):
            break
    return out.reshape(n, COORDS)


def bands(sk: np.ndarray) -> np.ndarray:
    rows = sk.reshape(len(sk), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sk), 1))
    for k in range(ROWS):
        h = mix(h * _U(5) + rows[:, :, k])
    return h


def sums(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Order-free hash of each document's set."""
    total = np.zeros(len(key) + 1, np.uint64)
    np.cumsum(mix(key), out=total[1:])
    at = np.searchsorted(doc, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), s1 and s2 (hashes of the set) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=_BLOCK):
            key, doc = shingles(b, width)
            n = np.bincount(doc, minlength=b.n)
            keys = bands(sketch(key, doc, b.n))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([
                b.cols["doc_id"].cast(pa.int64()), b.cols["th"], pa.array(n.astype(np.int64)), pa.array(sums(key, doc, b.n).view(np.int64)),
                pa.array(sums(mix(key + _U(7)), doc, b.n).view(np.int64)), flat], ["doc_id", "th", "n", "s1", "s2", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n long, s1 long, s2 long, bands array<long>")


def _sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """id and set (array of shingle hashes) of each class, from one row with its representative text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=_BLOCK):
            key, doc = shingles(b, width)
            at = np.searchsorted(doc, np.arange(b.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.cols["id"], pa.ListArray.from_arrays(pa.array(at), pa.array(key.view(np.int64)))], ["id", "set"])

    some = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(classes.select(F.col("rep").alias("doc_id"), "th", "id"), ["doc_id", "th"])
    return some.dropDuplicates(["doc_id", "th"]).select("id", "text").mapInArrow(run, "id long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v whose sets are similar enough."""
    a = sets.select(F.col("id").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("set").alias("b"))
    got = pairs.join(a, "u").join(b, "v").where(F.least(F.size("a"), F.size("b")) * 100 >= F.greatest(F.size("a"), F.size("b")) * percent)
    got = got.select("u", "v", F.size(F.array_intersect("a", "b")).cast("long").alias("i"), (F.size("a") + F.size("b")).cast("long").alias("s"))
    return got.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("u", "v")


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs u, v of different components that may be similar enough; none that is gets lost.

    With the shingles of every set in one order, rare ones first, similar sets share one of their first ones;
    the place of the first shared one bounds the overlap.
    """
    size = F.size("set")
    rows = sets.select("id", "component", size.alias("size"), F.explode("set").alias("g"))
    often = rows.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = W.partitionBy("id")
    before = F.col("size") - F.count(F.lit(1)).over(own)  # shingles of no other set come first
    placed = rows.join(often, "g").select("id", "component", "size", "g", (before + F.row_number().over(own.orderBy("df", "g"))).alias("at"))
    placed = stored(placed.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1))
    room = f"(1 + least(x.size - x.at, y.size - y.at)) * {100 + percent} >= {percent} * (x.size + y.size)"
    met = placed.alias("x").join(placed.alias("y"), F.expr(f"x.g = y.g and x.component <> y.component and x.id < y.id and {room}"))
    return met.select(F.col("x.id").alias("u"), F.col("y.id").alias("v")).distinct()


def _linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th, s1, s2, n_shingles, component_id and kept of every row."""
    sk = stored(sketched(docs, width))
    some = sk.where("n > 0 and doc_id is not null")
    reps = some.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "th")).alias("one")).select("s1", "s2", F.col("one.doc_id").alias("rep"), "one.th")
    # a class goes by its least doc_id; further classes with the same one, as rows may have one id and different texts, by a hash
    lead = F.min(F.struct("s1", "s2")).over(W.partitionBy("rep")) == F.struct("s1", "s2")
    reps = stored(reps.withColumn("id", F.when(lead, F.col("rep")).otherwise(F.xxhash64("rep", "s1", "s2"))))  # tables: the joins can then split a hot class or bucket
    one = some.withColumnRenamed("doc_id", "rep").join(reps, ["rep", "th", "s1", "s2"]).dropDuplicates(["rep", "th", "s1", "s2"])
    rows = one.select("id", F.explode("bands").alias("key"))
    shared = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    near = stored(rows.join(shared, "key").select("key", "id", "c"))

    ids = near.groupBy("id").agg(F.sum("c").alias("degree"))
    sets = stored(_sets(docs, reps.join(ids, "id", "left_semi"), width))
    hub = near.join(ids, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("u"))
    star = near.join(hub, "key").where("id <> u").select("u", F.col("id").alias("v")).distinct()
    edges = stored(_verified(star, sets, percent))

    of = stored(components(edges))
    left = near.join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    open_ = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = _prefix_pairs(sets.join(left.join(open_, "key").select("id", "component").distinct(), "id"), percent)
    more = stored(_verified(rest, sets, percent))
    of = components(edges.unionByName(more)) if not more.isEmpty() else of

    least = reps.join(of, "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    of = stored(of.join(stored(least), "component").select("id", "component_id"))
    discard(shared, near, sets, edges, more)
    row = ["doc_id", "th", "s1", "s2", F.col("n").alias("n_shingles")]
    members = some.join(reps.select("s1", "s2", "id", "rep"), ["s1", "s2"])
    found = members.join(of, "id", "left").select(*row, F.coalesce("component_id", "rep").alias("component_id"))
    alone = sk.where("n = 0 or doc_id is null").select(*row, F.col("doc_id").alias("component_id"))
    out = found.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def link(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return _linked(docs, width, percent).drop("th", "s1", "s2")


def keep_first(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group, that with the least doc_id, all columns.

    Rows of one doc_id with unequal shingle sets are documents of their own and stay or go each by its own text; rows of
    one doc_id and set stay one, that with the least hash of its text.  Rows without a doc_id stay.
    """
    th = f"th_{uuid.uuid4().hex}"  # no column of the input
    kept = _linked(docs, width, percent).where("kept and doc_id is not null")
    kept = kept.groupBy("doc_id", "s1", "s2").agg(F.min("th").alias(th)).select("doc_id", th)
    named = docs.where("doc_id is not null").withColumn(th, F.xxhash64("text")).join(kept, ["doc_id", th]).dropDuplicates(["doc_id", th])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
