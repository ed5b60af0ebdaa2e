"""Hard negatives from embeddings by exact integer scores in a residue number system.

A component x becomes floor(``SCALE`` * x); the score of a row and an anchor is their integer inner
product.  Components are taken modulo several small primes, as float32 numbers around zero; a float32
matrix product of at most ``INNER`` components is then exact.  As many primes are taken as the largest
squared norm asks for, and Chinese remaindering (balanced mixed radix digits) gives the signed score
back.  The selection follows in windows over the scores.

Rows lie in blocks of at most ``CELLS`` components, anchors in blocks of ``ANCHORS``.  Every row block
meets every anchor block: anchors are sent once to each group of row blocks and stream past them, so a
task's memory is bounded by a group, and groups grow in number with the table.  A first pass finds the
positives: per block, anchor and label only the best few rows leave a task, and windows over them pick
the best of all blocks.  A second pass finds, for each positive, the best rows of other labels inside its
score window, in the same way.

Rows with a null id or label, a null vector, or a null or non-finite component take no part.  Rows that
agree in id, label and all integer components are one row; other rows with an anchor's id are other rows.
Ties go to the smaller id.  Vectors of unequal length are extended by zeros.  An empty table gives an
empty result.  A squared norm over 2^62, of which scores would not fit a long, is an error.  Only
``vec_id``, ``label`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.blocks import mix, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
WINDOW = (30, 90, 100)  # per cent of the positive's score: from, to
ANCHOR_STEP = 100
CELLS = 1 << 19  # components in a row block
ANCHORS = 512  # in an anchor block
GROUP = 64  # row blocks that one copy of the anchors meets
INNER = 1024  # components in one float32 product: 1024 * 125^2 < 2^24
PRIMES = [p for p in range(251, 2, -2) if all(p % d for d in range(3, 16, 2))]
_U = np.uint64


def residues(c: np.ndarray, p: int) -> np.ndarray:
    """Components modulo a prime, around zero, as float32."""
    half = p // 2
    return ((c + half) % p - half).astype(np.float32)


def primes_for(bound: int) -> list[int]:
    """So many primes that every score up to the bound, of either sign, has its own residues."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound + 1:
            return out
        out.append(p)
        product *= p
    raise ValueError("too few primes")


def scores(a: np.ndarray, r: np.ndarray, bound: int) -> np.ndarray:
    """Exact inner products (anchors x rows, int64) of integer matrices whose products are at most ``bound``."""
    dim = min(a.shape[1], r.shape[1])
    a, r = a[:, :dim], r[:, :dim]
    primes = primes_for(bound)
    digits: list[np.ndarray] = []
    total, weight = np.zeros((len(a), len(r)), np.int64), 1
    for p in primes:
        x, y = residues(a, p), residues(r, p)
        s = np.zeros((len(a), len(r)), np.int32)
        for k in range(0, dim, INNER):
            s += np.remainder((x[:, k:k + INNER] @ y[:, k:k + INNER].T).astype(np.int32), p)
        w = 1
        for q, d in zip(primes, digits, strict=False):  # less what the digits so far stand for
            s -= d * np.int32(w)
            w = w * q % p
        digit = np.remainder(np.remainder(s, p) * np.int32(pow(w, -1, p)) + p // 2, p) - p // 2
        digits.append(digit.astype(np.int32))
        total += digits[-1] * np.int64(weight if weight < 1 << 63 else weight - (1 << 64))  # modulo 2^64 the sum is the score
        weight = weight * p & (1 << 64) - 1
    return total


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def _vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Integer components, a row each, and which rows have finite components only."""
    ok = np.asarray(pc.is_valid(col).to_numpy(zero_copy_only=False), bool)
    size = np.where(ok, pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    value = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    row = np.repeat(np.arange(len(col)), size)
    ok &= np.bincount(row, ~np.isfinite(value), len(col)) == 0
    out = np.zeros((len(col), int(size.max(initial=0))), np.float64)
    out[row, np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)] = np.where(ok[row], value, 0)
    out = np.floor(out * SCALE)
    if np.abs(out).max(initial=0) >= 1 << 31:
        raise ValueError("a component is too large for scores of 64 bits")
    return out.astype(np.int32), ok


def _marks(label: np.ndarray, c: np.ndarray) -> np.ndarray:
    """64-bit marks of rows; zeros at the end do not count."""
    h = mix(label.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15))
    for k in range(c.shape[1]):
        h = h + mix(c[:, k].astype(np.int64).view(_U) * _U(2 * k + 1)) * _U(0xBF58476D1CE4E5B9 + 2 * k)
    return mix(h).view(np.int64)


ROWS = "blk long, n int, dim int, norm double, ids binary, labels binary, marks binary, c binary"


def row_blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of the rows that take part, in order of id, without repeats inside a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, cells = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            dim = max(x[2].shape[1] for x in held)
            ids, label = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            c = np.concatenate([np.pad(x[2], ((0, 0), (0, dim - x[2].shape[1]))) for x in held])
            mark = _marks(label, c)
            order = np.lexsort((mark, ids))
            ids, label, mark, c = ids[order], label[order], mark[order], c[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1])
            ids, label, mark, c = ids[new], label[new], mark[new], c[new]
            norm = float((c.astype(np.float64) ** 2).sum(1).max(initial=0))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), pa.array([norm]), *map(_bytes, (ids, label, mark, c))],
                                              [f.split()[0] for f in ROWS.split(", ")])

        for batch in batches:
            c, ok = _vectors(batch.column("embedding"))
            ids, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("vec_id", "label"))
            step = max(1, CELLS // max(1, c.shape[1]))
            for lo in range(0, len(ok), step):
                keep = lo + np.flatnonzero(ok[lo:lo + step])
                if not len(keep):
                    continue
                if held and cells + len(keep) * max(1, c.shape[1]) > CELLS:
                    yield out()
                    seq, held, cells = seq + 1, [], 0
                held.append((ids[keep].astype(np.int64), label[keep].astype(np.int64), c[keep]))
                cells += len(keep) * max(1, c.shape[1])
        if held:
            yield out()

    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").cast("long").alias("label")
    return vectors.where("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), label, "embedding").mapInArrow(run, ROWS)


def _rows(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, label, mark = (np.frombuffer(x[k], np.int64) for k in ("ids", "labels", "marks"))
    return ids, label, mark, np.frombuffer(x["c"], np.int32).reshape(x["n"], x["dim"])


def _anchors(rows: DataFrame) -> DataFrame:
    """One row an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids, label, mark, c = _rows(x)
                at = np.flatnonzero(ids % ANCHOR_STEP == 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(mark[at]), pa.array(label[at]), pa.array([c[i].tobytes() for i in at], pa.binary())], ["anchor_id", "anchor_mark", "label", "c"])

    return rows.select("n", "dim", "ids", "labels", "marks", "c").mapInArrow(run, "anchor_id long, anchor_mark long, label long, c binary").dropDuplicates(["anchor_id", "anchor_mark"])


PACKED = "a_n int, a_dim int, a_ids binary, a_marks binary, a_labels binary, a_c binary, a_tops binary"


def _packed(anchors: DataFrame) -> DataFrame:
    """Anchors in blocks; ``positives`` (their scores, best first) beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ANCHORS):
                x = batch.slice(lo, ANCHORS).to_pylist()
                c = [np.frombuffer(r["c"], np.int32) for r in x]
                dim = max(map(len, c))
                tops = np.full((len(x), POSITIVES), -1, np.int64)
                for row, r in zip(tops, x, strict=True):
                    row[:len(r["positives"])] = r["positives"]
                whole = [np.array([r[k] for r in x], np.int64) for k in ("anchor_id", "anchor_mark", "label")]
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([dim], pa.int32()), *map(_bytes, whole), _bytes(np.array([np.pad(r, (0, dim - len(r))) for r in c])), _bytes(tops)],
                                                 [f.split()[0] for f in PACKED.split(", ")])

    return anchors.select("anchor_id", "anchor_mark", "label", "c", "positives").mapInArrow(run, PACKED)


def _met(anchors: DataFrame, rows: DataFrame, groups: int) -> DataFrame:
    """Every anchor block beside every row block: the stated query set, in blocks, against all rows."""
    left = _packed(anchors).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g")
    right = rows.withColumn("g", F.expr(f"cast(pmod(xxhash64(blk), {groups}) as int)")).repartition(groups, "g")
    return left.join(right.hint("merge"), "g")


def _first(s: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best scores of each line, best first, ties by place (all places for k below 0)."""
    n = s.shape[1]
    if bound < (1 << 61) // max(n, 1):  # score and place in one number: the same order, sorted faster
        key = np.arange(n) - s * n
        if 0 <= k < n:
            key = np.partition(key, k, axis=1)[:, :k]
        key.sort(axis=1)
        place = key % n if n else key
    else:
        place = np.argsort(-s, axis=1, kind="stable")[:, :k if k >= 0 else n]
    return place, np.take_along_axis(s, place, 1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    for x in batch.to_pylist():
        a = [np.frombuffer(x[k], np.int64) for k in ("a_ids", "a_marks", "a_labels")]
        yield (*a, np.frombuffer(x["a_c"], np.int32).reshape(x["a_n"], x["a_dim"]), np.frombuffer(x["a_tops"], np.int64).reshape(x["a_n"], POSITIVES), *_rows(x))


def _candidates(met: DataFrame, bound: int) -> DataFrame:
    """The best rows of an anchor's label in each row block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for aid, amark, alabel, ac, _, ids, label, mark, c in _blocks(batch):
                for one in np.unique(alabel):
                    i, j = np.flatnonzero(alabel == one), np.flatnonzero(label == one)
                    if not len(j):
                        continue
                    place, got = _first(scores(ac[i], c[j], bound), POSITIVES + 1, bound)
                    i, j = np.repeat(i, place.shape[1]), j[place.ravel()]
                    other = (ids[j] != aid[i]) | (mark[j] != amark[i])
                    i, j, got = i[other], j[other], got.ravel()[other]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (aid[i], amark[i], got, ids[j], mark[j])], ["anchor_id", "anchor_mark", "score", "vec_id", "mark"])

    return met.mapInArrow(run, "anchor_id long, anchor_mark long, score long, vec_id long, mark long")


def _windowed(met: DataFrame, bound: int) -> DataFrame:
    """The best rows of other labels inside the score window of each positive, in each row block."""
    low, high, whole = WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for aid, amark, alabel, ac, tops, ids, label, mark, c in _blocks(batch):
                for one in np.unique(alabel):
                    i, j = np.flatnonzero(alabel == one), np.flatnonzero(label != one)
                    if not len(j):
                        continue
                    place, got = _first(scores(ac[i], c[j], bound), -1, bound)
                    found = []
                    for line, a in enumerate(i):
                        falling = -got[line]
                        for k, top in enumerate(tops[a].tolist()):
                            if top < 0:  # none left, or a negative score, whose window is empty
                                continue
                            lo = int(np.searchsorted(falling, -(high * top // whole), "left"))
                            hi = int(np.searchsorted(falling, -(-(-low * top // whole)), "right"))
                            hi = min(hi, lo + NEGATIVES)
                            if lo < hi:
                                found.append((np.full(hi - lo, a), np.full(hi - lo, k), got[line, lo:hi], j[place[line, lo:hi]]))
                    if found:
                        a, k, got, at = (np.concatenate(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (aid[a], amark[a], k, got, ids[at], mark[at])], ["anchor_id", "anchor_mark", "k", "score", "vec_id", "mark"])

    return met.mapInArrow(run, "anchor_id long, anchor_mark long, k long, score long, vec_id long, mark long")


def _best(candidates: DataFrame, key: list[str], n: int) -> DataFrame:
    """The n best of each key with their rank; a row that several blocks hold counts once."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id", "mark")
    return candidates.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= n).dropDuplicates([*key, "rank"])


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = stored(row_blocks(vectors))
    n, norm = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    norm = norm or 0.0
    if norm > 1 << 62:
        raise ValueError("scores would not fit 64 bits")
    bound = int(norm * (1 + 1e-9)) + 1
    groups = max(1, -(-n // GROUP), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    anchors = stored(_anchors(rows))
    key = ["anchor_id", "anchor_mark"]
    none = F.array().cast("array<long>")
    tops = stored(_best(_candidates(_met(anchors.withColumn("positives", none), rows, groups), bound), key, POSITIVES))
    lists = tops.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("positives"))  # POSITIVES at most
    ranked = anchors.join(lists.withColumn("positives", F.col("positives.score")), key)
    found = _best(_windowed(_met(ranked, rows, groups), bound), [*key, "k"], NEGATIVES)
    named = tops.select(*key, (F.col("rank") - 1).cast("long").alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, [*key, "k"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle() -> str:
    low, high, whole = WINDOW
    return f"""
with v as (
  select vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as c
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, list_inner_product(a.c, b.c)::bigint as score
  from v a join v b on a.vec_id % {ANCHOR_STEP} = 0 and a.vec_id <> b.vec_id),
positives as (
  select * from (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as k
                 from scored where label = anchor_label) where k <= {POSITIVES}),
ranked as (
  select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
  where {low} * p.positive_score <= {whole} * s.score and {whole} * s.score <= {high} * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= {NEGATIVES}"""
