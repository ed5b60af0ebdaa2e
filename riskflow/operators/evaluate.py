"""Evaluation operators: holdout metrics (A6, M9), average precision (A7), promotion
check (M10), class weights (A12), min-max scaling (A10), alert budget (K2),
adaptive threshold (A5), positional split (K4), seeded sample (K3).

Ranking work uses the range-partitioned helpers in ordering.py: no global
window and no top-k collected into one task, whatever the budget size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.contract import ADAPTIVE_DEFAULTS, FEATURES_V1, TRAIN_FRACTION
from riskflow.operators.ordering import bottom_cut, exact_quantiles, global_row_index, running_sums


def _hit(score: Column, threshold: float) -> Column:
    """``score >= threshold``; false for a missing score and for NaN (which Spark orders last)."""
    return F.coalesce((score >= F.lit(threshold)) & ~F.isnan(score.cast("double")), F.lit(False))


def confusion_at(df: DataFrame, score_col: str, label_col: str, threshold: float = 0.5) -> DataFrame:
    """Precision and recall of ``score >= threshold`` (zero division -> 0)."""
    pred = _hit(F.col(score_col), threshold)
    y = F.col(label_col) == 1
    a = df.agg(
        F.count(F.lit(1)).alias("rows_holdout"),
        F.count_if(pred & y).alias("tp"),
        F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"),
    )
    return a.select(
        "rows_holdout", "tp", "fp", "fn",
        F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0).alias("precision_at_0_5"),
        F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0).alias("recall_at_0_5"),
    )


def average_precision(df: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """AP = sum over distinct thresholds of (R_k - R_{k-1}) * P_k (step sum).

    Rows are first reduced to one row per distinct score (partial
    aggregation), then cumulative positives/negatives in descending score
    order come from :func:`running_sums`.  No positives -> 0.0.
    """
    per_score = df.groupBy(F.col(score_col).alias("_s")).agg(
        F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label_col) == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )
    cum = running_sums(per_score, [F.col("_s").desc()], ["pos", "neg"])
    a = cum.agg(
        F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("_num"),
        F.sum("pos").alias("n_pos"),
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
    )
    return a.select(
        F.when(F.col("n_pos") > 0, F.col("_num") / F.col("n_pos")).otherwise(F.lit(0.0)).alias("pr_auc"),
        F.coalesce(F.col("n_pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
    )


def holdout_evaluation(df: DataFrame, score_col: str, label_col: str, threshold: float = 0.5) -> DataFrame:
    """M9: one row with rows_holdout, tp, fp, fn, precision/recall at ``threshold`` and pr_auc.

    Everything derives from the per-distinct-score table: one reduction of
    the rows, one prefix-sum pass, one final aggregation.
    """
    per_score = df.groupBy(F.col(score_col).alias("_s")).agg(
        F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label_col) == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )
    cum = running_sums(per_score, [F.col("_s").desc()], ["pos", "neg"])
    hit = _hit(F.col("_s"), threshold)
    a = cum.agg(
        F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("_num"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("rows_holdout"),
        F.coalesce(F.sum(F.when(hit, F.col("pos")).otherwise(0)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg")).otherwise(0)), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~hit, F.col("pos")).otherwise(0)), F.lit(0)).alias("fn"),
    )
    return a.select(
        "rows_holdout", "tp", "fp", "fn", "n_pos",
        F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0).alias("precision_at_0_5"),
        F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0).alias("recall_at_0_5"),
        F.when(F.col("n_pos") > 0, F.col("_num") / F.col("n_pos")).otherwise(F.lit(0.0)).alias("pr_auc"),
    )


def promotion_check(metrics: DataFrame, min_precision: float, min_recall: float, min_pr_auc: float) -> DataFrame:
    """Strict ``<`` against each minimum; reasons with 6-decimal text."""
    def reason(col: str, label: str, lo: float) -> Column:
        return F.when(
            F.col(col) < F.lit(lo),
            F.concat(F.lit(f"{col}="), F.format_string("%.6f", F.col(col)), F.lit(f" below {label}={lo:.6f}")),
        )

    reasons = F.array_compact(F.array(
        reason("precision_at_0_5", "min_precision", min_precision),
        reason("recall_at_0_5", "min_recall", min_recall),
        reason("pr_auc", "min_pr_auc", min_pr_auc),
    ))
    return metrics.select("*", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, "; ").alias("reasons"))


def balanced_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Per class n_c and weight n / (2 * n_c).  Class count is tiny: broadcast join."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the per-class rows only (2 rows)
    return counts.select(label_col, "n", (total / (F.lit(2.0) * F.col("n"))).alias("weight"))


def minmax_fit(df: DataFrame, cols: list[str] = FEATURES_V1) -> tuple[list[float], list[float]]:
    """A10 fit: one aggregation; 2 x len(cols) scalars reach the driver (model parameters)."""
    row = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols], *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    return [float(row[f"mn_{c}"]) for c in cols], [float(row[f"mx_{c}"]) for c in cols]


def minmax_transform(df: DataFrame, mins: list[float], maxs: list[float], cols: list[str] = FEATURES_V1,
                     suffix: str = "") -> DataFrame:
    """A10 transform: (x - min) / (max - min); a zero range divides by 1."""
    out = []
    for c, lo, hi in zip(cols, mins, maxs):
        scale = hi - lo if hi - lo != 0.0 else 1.0
        out.append(((F.col(c).cast("double") - F.lit(lo)) / F.lit(scale)).alias(f"{c}{suffix}"))
    keep = [c for c in df.columns if suffix or c not in cols]
    return df.select(*keep, *out)


def positional_split(df: DataFrame, order: list, fraction: float = TRAIN_FRACTION) -> DataFrame:
    """K4: row_index in ``order`` and split = train for index < floor(fraction * n).

    Either side empty is an error, as in the trainers.
    """
    idx = global_row_index(df, order, "row_index")
    n = idx.count()
    cut = int(fraction * n)
    if cut <= 0 or cut >= n:
        raise ValueError("Dataset is too small for train/validation split.")
    return idx.withColumn("split", F.when(F.col("row_index") < cut, F.lit("train")).otherwise(F.lit("validation")))


def budget_size(n: int, ratio: float) -> int:
    """max(1, round(n * ratio)) with round-half-even (Python ``round``)."""
    return max(1, int(round(n * ratio)))


def alert_budget(df: DataFrame, score_col: str, id_col: str, ratio: float) -> DataFrame:
    """K2: the top max(1, round(n * ratio)) rows by score, ties in arrival (id) order.

    The cut score comes from the counts of the distinct scores; only the rows
    at or above it are ranked (range-partitioned: the budget can be a large
    fraction of the input, so it is not a top-k gathered in one task).  NaN
    ranks first and a missing score last.
    """
    cut = _budget_cut(_score_counts(df, score_col, F.lit(False)), ratio)
    s = F.col(score_col)
    if cut is None:
        some = df.where(F.lit(False))
    elif cut["_s"] is None:  # the budget reaches into the rows without a score
        some = df
    else:
        some = df.where(s >= F.lit(cut["_s"]))
    ranked = global_row_index(some, [s.desc(), F.col(id_col).asc()], "_rank")
    k = cut["k"] if cut else 0
    return ranked.where(F.col("_rank") < k).withColumn("alert_rank", F.col("_rank") + 1).drop("_rank")


def _score_counts(df: DataFrame, score_col: str, positive: Column) -> DataFrame:
    """One row per distinct score with n, pos and their sums down to it, best score first."""
    per = df.groupBy(F.col(score_col).alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("pos"))
    return running_sums(per, [F.col("_s").desc()], ["n", "pos"])


def _budget_cut(counts: DataFrame, ratio: float) -> dict | None:
    """The score at which the budget k ends, its sums, k and the totals (scalars); None for no rows."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    if not total["n"]:
        return None
    k = budget_size(total["n"], ratio)
    at = counts.where((F.col("cum_n") >= k) & (F.col("cum_n") - F.col("n") < k)).first()
    return {**at.asDict(), "k": k, "positives": total["pos"]}


def quality_at_budget(scored: DataFrame, score_col: str, id_col: str, label_col: str, ratio: float) -> DataFrame:
    """K2 quality: precision and recall inside the budget.

    Scores above the cut count whole; of the rows that share the cut score the
    first ones in id order count, and only those rows are ranked.
    """
    y = F.col(label_col) == 1
    cut = _budget_cut(_score_counts(scored, score_col, y), ratio)
    k, above, room, positives = (0, 0, 0, 0) if cut is None else (
        cut["k"], cut["cum_pos"] - cut["pos"], cut["k"] - (cut["cum_n"] - cut["n"]), cut["positives"])
    same = F.col(score_col).eqNullSafe(F.lit(None if cut is None else cut["_s"]))
    ties = scored.where(same & F.lit(cut is not None)).select(F.col(id_col).alias("_id"), y.alias("_y"))
    a = global_row_index(ties, ["_id"], "_rank").agg((F.count_if((F.col("_rank") < room) & F.col("_y")) + F.lit(above)).alias("tp"))
    a = a.select(F.lit(k).cast("long").alias("alerts_sent"), "tp", F.lit(positives).cast("long").alias("positives"))
    return a.select(
        "alerts_sent", "tp", "positives",
        F.when(F.col("alerts_sent") > 0, F.col("tp") / F.col("alerts_sent")).otherwise(0.0).alias("precision"),
        F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0).alias("recall"),
    )


def adaptive_threshold(df: DataFrame, score_col: str, by: list[str] | None = None,
                       current_threshold: float = ADAPTIVE_DEFAULTS["current_threshold"],
                       quantile: float = ADAPTIVE_DEFAULTS["quantile"],
                       min_samples: int = ADAPTIVE_DEFAULTS["min_samples"],
                       floor: float = ADAPTIVE_DEFAULTS["floor"],
                       ceiling: float = ADAPTIVE_DEFAULTS["ceiling"]) -> DataFrame:
    """A5: too few samples (none included) keep the current threshold, else clip(quantile, floor, ceiling)."""
    q = exact_quantiles(df, score_col, [quantile], by)
    return q.select(
        *(by or []),
        F.col("n"),
        F.col("q_0").alias("quantile_value"),
        F.when(F.col("n") < min_samples, F.lit(float(current_threshold)))
        .otherwise(F.least(F.greatest(F.col("q_0"), F.lit(floor)), F.lit(ceiling))).alias("threshold"),
    )


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int, min_rows: int = 1) -> DataFrame:
    """K3: exactly min(n, available) rows, repeatable for a seed, without replacement.

    The rows with the n smallest (seeded hash of the id, id): the cut between them and the rest comes from counts
    (``bottom_cut``, which reads the id column only), so the sample is a filter of the input.
    """
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    available, cut, equal = bottom_cut(df, id_col, h, n)
    if min(n, available) < min_rows:
        raise ValueError("No rows available for training." if min_rows <= 1 else "Not enough rows for training.")
    if n <= 0:
        return df.limit(0)
    if cut is None:
        return df
    same = (h == F.lit(cut[0])) & F.col(id_col).eqNullSafe(F.lit(cut[1]))
    before = (h < F.lit(cut[0])) | ((h == F.lit(cut[0])) & (F.lit(False) if cut[1] is None else F.coalesce(F.col(id_col) < F.lit(cut[1]), F.lit(True))))
    at = df.where(same)
    return df.where(before).unionByName(at if at.select(id_col).limit(equal + 1).count() == equal else at.limit(equal))


def evaluate_model_on_holdout(spark, model, holdout_path: str, threshold: float = 0.5,
                              label_col: str = "isFraud") -> DataFrame:
    """M9: score a holdout table with a model (SQL builder or Column builder) and evaluate it.

    The required columns are checked on the driver from the table schema,
    before any job runs.
    """
    from riskflow.models.base import feature_refs

    df = spark.read.parquet(holdout_path)
    missing = [c for c in FEATURES_V1 if c not in df.columns]
    if missing:
        raise ValueError(f"Holdout data is missing required feature columns: {missing}")
    if label_col not in df.columns:
        raise ValueError(f"Holdout data must include `{label_col}` target column.")
    x = feature_refs()
    score_col = model.column(x) if hasattr(model, "column") else F.expr(model.sql(x))
    return holdout_evaluation(df.withColumn("_score", score_col), "_score", label_col, threshold)
