"""Ordering primitives without a single-partition window (K1, K5, W1 helper).

* :func:`grouped_row_number` - ``row_number() over (partition by keys order by id)``
  that splits hot groups into id buckets, so no group lands whole in one task.
* :func:`global_row_index` - a 0-based position in a total order: range
  partitioning + in-partition position + broadcast per-partition offsets (the
  offsets table has one row per partition, a proven size bound).
* :func:`running_sums` - prefix sums in a total order, same scheme.
* :func:`exact_quantiles` - linear-interpolated quantiles (NumPy ``linear``)
  by selection: a sketch brackets the rank, a histogram narrows it, and only the
  values of one bucket are put in order.
* :func:`bottom_cut` - the n-th smallest (hash, id) from counts of the hash's bits.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.session import cut_lineage, target_partitions

BUCKET_ROWS = 1 << 20


def grouped_row_number(df: DataFrame, keys: list[str], order_col: str, name: str = "rn",
                       bucket_rows: int = BUCKET_ROWS, start: DataFrame | None = None) -> DataFrame:
    """1-based row number per group in ``order_col`` order (an integer id, unique per group).

    Rows are split into (group, id // bucket_rows) pieces: a piece holds at
    most ``bucket_rows`` rows however hot its group.  Piece sizes are
    pre-aggregated (partial aggregation), their prefix offsets come from a
    window over the small piece table, and the numbering window runs per piece.
    ``start`` (keys, ``n``; one row a group, no null keys) goes on from ``n`` rows
    numbered before: it meets the piece table, not the rows.
    """
    d = df.withColumn("_piece", F.floor(F.col(order_col) / F.lit(bucket_rows)))
    pieces = d.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if start is not None:
        offsets = offsets.join(start.select(*keys, F.col("n").alias("_start")), keys, "left").select(
            *keys, "_piece", (F.col("_off") + F.coalesce("_start", F.lit(0))).alias("_off"))
    w = Window.partitionBy(*keys, "_piece").orderBy(order_col)
    # null keys form a group like any other: null-safe equality, which is still an equi-join
    sides = [*keys, "_piece"]
    offsets = offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(sides)], "_off")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(sides)])
    return (
        d.join(offsets, same).drop(*[f"_o{i}" for i in range(len(sides))])
        .withColumn(name, (F.row_number().over(w) + F.col("_off")).cast("int"))
        .drop("_piece", "_off")
    )


def _ranged(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    n = num_partitions or target_partitions(df)
    # The range partitioner samples its input in a separate pass before the
    # shuffle; keeping the input for the duration of the cut means an expensive
    # upstream (parsing, model UDFs) is evaluated once, not twice.
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranged = (
            df.repartitionByRange(n, *order)
            .sortWithinPartitions(*order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id())
        )
        # Fix range boundaries and in-partition order once (reliable checkpoint
        # in the shared checkpoint folder), so recomputation cannot move rows.
        return cut_lineage(ranged)
    finally:
        df.unpersist()


def _offsets(ranged: DataFrame, value_cols: list[str]) -> DataFrame:
    totals = ranged.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_cnt"), *[F.sum(c).alias(f"_tot_{c}") for c in value_cols]
    )
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in value_cols],
    )


def global_row_index(df: DataFrame, order: list[Column | str], name: str = "row_index",
                     num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (make the order total, e.g. end with an id)."""
    order_c = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = _ranged(df, order_c, num_partitions)
    offsets = _offsets(ranged, [])  # one row per partition
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + pos)
        .drop("_pid", "_mid", "_off")
    )


def running_sums(df: DataFrame, order: list[Column | str], value_cols: list[str], prefix: str = "cum_",
                 num_partitions: int | None = None) -> DataFrame:
    """Inclusive prefix sums of ``value_cols`` along a total order."""
    order_c = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = _ranged(df, order_c, num_partitions)
    offsets = _offsets(ranged, value_cols)
    w = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_pid")
    for c in value_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_off_{c}") + F.sum(c).over(w))
    return out.drop("_pid", "_mid", "_off", *[f"_off_{c}" for c in value_cols])


def previous_value(df: DataFrame, order: list[Column | str], col: str, name: str = "prev",
                   num_partitions: int | None = None) -> DataFrame:
    """``col`` of the row before in a total order (NULL for the first row).

    ``lag`` inside each range; a range's first row takes the last value of the
    range before it (one row per range).
    """
    ranged = _ranged(df, [F.col(o) if isinstance(o, str) else o for o in order], num_partitions)
    last = ranged.groupBy("_pid").agg(F.max_by(F.struct(col), "_mid").alias("_last"))
    ends = last.select("_pid", F.lag("_last").over(Window.orderBy("_pid")).alias("_end"))
    row = F.lag(F.struct(col)).over(Window.partitionBy("_pid").orderBy("_mid"))
    return (
        ranged.join(F.broadcast(ends), "_pid")
        .withColumn(name, F.coalesce(row, F.col("_end"))[col])
        .drop("_pid", "_mid", "_end")
    )


def bottom_cut(df: DataFrame, id_col: str, h: Column, n: int) -> tuple[int, tuple | None, int]:
    """Rows available, the n-th smallest (hash, id), and how many rows equal to it belong to the first n.

    Two passes count the hash's upper 16 bits and the next 16 inside the bucket that n falls into; what is left,
    about a 2^32-th of the distinct ids, is counted by (hash, id).  The cut is None if all rows belong.
    """
    d = df.select(F.col(id_col).alias("_id"), h.alias("_h"))

    def step(rows: DataFrame, bits: Column, room: int) -> tuple[int, int, int]:
        counts = sorted((r["b"], r["c"]) for r in rows.groupBy(bits.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect())  # 2^16 rows at most
        total = sum(c for _, c in counts)
        for b, c in counts:
            if room <= c:
                return total, b, room
            room -= c
        return total, 0, 0

    total, top, room = step(d, F.shiftright("_h", 48), n)
    if n >= total or n <= 0:
        return total, None, 0
    some = d.where(F.shiftright("_h", 48) == top)
    low = F.shiftright("_h", 32).bitwiseAND(F.lit(0xFFFF))
    _, second, room = step(some, low, room)
    last = some.where(low == second).groupBy("_h", "_id").agg(F.count(F.lit(1)).alias("c")).orderBy("_h", "_id").limit(room).collect()
    for r in last:
        if room <= r["c"]:
            return total, (r["_h"], r["_id"]), room
        room -= r["c"]
    raise RuntimeError("the input changed between passes")


def exact_quantiles(df: DataFrame, value_col: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group: columns ``by + [q_<i>] + [n]``.

    Without ``by`` there is one row even for no values (n = 0, NULL quantiles).
    pos = q * (n - 1); value = v[floor] + (v[ceil] - v[floor]) * (pos - floor).
    The two ranks are selected, not sorted for: a sketch brackets each quantile
    (``MARGIN`` to both sides, checked by exact counts), the bracket is cut into
    ``CELLS`` buckets and counted, and only the values of the bucket that holds
    the rank are put in order.  The value column is written once and scanned
    three times; no exchange moves it.
    """
    by = by or []
    x = F.col("_x")
    d = cut_lineage(df.select(*by, F.col(value_col).cast("double").alias("_x")).where(x.isNotNull() & ~F.isnan("_x")))
    ends = [e for q in qs for e in (max(0.0, q - MARGIN / ACCURACY), min(1.0, q + MARGIN / ACCURACY))]
    sketch = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
                                F.percentile_approx("_x", ends, ACCURACY).alias("_ends"))
    few = F.col("n") <= FEW

    def bracket(i: int, q: float) -> Column:
        a = F.col("_min") if ends[2 * i] <= 0 else F.when(few, F.col("_min")).otherwise(F.get("_ends", F.lit(2 * i)))
        b = F.col("_max") if ends[2 * i + 1] >= 1 else F.when(few, F.col("_max")).otherwise(F.get("_ends", F.lit(2 * i + 1)))
        pos = F.lit(float(q)) * (F.col("n") - 1)
        return F.struct(F.lit(i).alias("i"), a.alias("a"), b.alias("b"), F.floor(pos).alias("lo"), F.ceil(pos).alias("hi"), (pos - F.floor(pos)).alias("t"))

    targets = cut_lineage(sketch.select(*by, "n", "_min", "_max", F.array(*[bracket(i, q) for i, q in enumerate(qs)]).alias("_targets")))
    found, whole = _selected(d, targets, by, len(qs))
    if not whole:  # a bracket missed its rank: the whole range holds it
        wide = F.transform("_targets", lambda t: t.withField("a", F.col("_min")).withField("b", F.col("_max")))
        found, _ = _selected(d, targets.withColumn("_targets", wide), by, len(qs))
    picked = found.groupBy(*by, "i").agg(F.max(F.when(F.col("side") == "lo", x)).alias("_a"), F.max(F.when(F.col("side") == "hi", x)).alias("_b"), F.max("t").alias("t"))
    one = picked.select(*by, "i", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("t")).alias("_v"))
    wide = one.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("_v"))).alias(f"q_{i}") for i in range(len(qs))])
    cols = ["n", *[f"q_{i}" for i in range(len(qs))]]
    if not by:  # one row each
        return wide.withColumn("n", F.lit(targets.first()["n"])).select(*cols)
    return _beside(targets.select(*by, "n"), wide, by).select(*by, *cols)


ACCURACY, MARGIN = 10_000, 5  # of the sketch, whose ranks are off by n / ACCURACY at most
FEW = 4096  # values that need no sketch
CELLS = 1024


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner equi-join on group keys, null keys included."""
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[c for c in right.columns if c not in by])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)])
    return left.join(named, same).drop(*[f"_k{i}" for i in range(len(by))])


def _selected(d: DataFrame, targets: DataFrame, by: list[str], n_targets: int) -> tuple[DataFrame, bool]:
    """(by, i, side, t, _x) of the ranks ``lo`` and ``hi`` of every target, and whether all brackets hold their ranks."""
    x = F.col("_x")
    if by:
        marked = _beside(d, targets.select(*by, "_targets"), by)
    else:  # one row of bounds
        row = targets.first()
        at = F.array(*[F.struct(*[F.lit(v).cast("double" if k in "abt" else "long").alias(k) for k, v in (r.asDict() if r else {}).items()]) for r in row["_targets"]])
        marked = d.withColumn("_targets", at)
    inside = marked.select(*by, "_x", F.explode(F.filter("_targets", lambda t: (F.col("_x") >= t["a"]) & (F.col("_x") <= t["b"]))).alias("_t"))
    width = F.col("_t.b") - F.col("_t.a")
    cell = F.when(width > 0, F.least(F.floor((x - F.col("_t.a")) / width * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0)).cast("int")
    inside = inside.select(*by, F.col("_t.i").cast("int").alias("i"), cell.alias("cell"), "_x")
    below = marked.groupBy(*by).agg(*[F.count_if(x < F.col("_targets")[i]["a"]).alias(f"_below{i}") for i in range(n_targets)])
    below = below.select(*by, F.posexplode(F.array(*[f"_below{i}" for i in range(n_targets)])).alias("i", "_below"))
    cells = inside.groupBy(*by, "i", "cell").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*by, "i").orderBy("cell")  # CELLS rows at most
    cells = cells.withColumn("_to", F.sum("c").over(run))
    ranks = targets.where("n > 0").select(*by, F.explode("_targets").alias("_t")).select(
        *by, F.col("_t.i").cast("int").alias("i"), F.col("_t.t").alias("t"),
        F.explode(F.array(F.struct(F.lit("lo").alias("side"), F.col("_t.lo").alias("r")), F.struct(F.lit("hi").alias("side"), F.col("_t.hi").alias("r")))).alias("_r"))
    ranks = ranks.select(*by, "i", "t", "_r.side", "_r.r")
    inner = F.col("r") - F.col("_below")
    chosen = _beside(_beside(ranks, below, [*by, "i"]), cells, [*by, "i"]).where((inner >= F.col("_to") - F.col("c")) & (inner < F.col("_to")))
    chosen = cut_lineage(chosen.select(*by, "i", "t", "side", "cell", (inner - (F.col("_to") - F.col("c"))).alias("r")))
    values = _beside(inside, chosen, [*by, "i", "cell"]).groupBy(*by, "i", "side", "t", "r", "_x").agg(F.count(F.lit(1)).alias("c"))
    values = values.withColumn("_to", F.sum("c").over(Window.partitionBy(*by, "i", "side").orderBy("_x")))
    found = values.where((F.col("r") >= F.col("_to") - F.col("c")) & (F.col("r") < F.col("_to")))
    return found.select(*by, "i", "side", "t", "_x"), chosen.count() == ranks.count()
