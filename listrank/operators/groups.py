"""Item groups and the cross-fitted user and group control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listrank.functions.keys import add_key, unsigned_order

from .prep import dense_ids


def item_groups(items: DataFrame, groups: Sequence[Column], least_support: int) -> DataFrame:
    """item_idx, group, for the distinct non-null groups of each item that least_support items have."""
    rows = items.select("item_idx", F.explode(F.array_distinct(F.array_compact(F.array(*groups)))).alias("group"))
    return rows.join(group_support(rows).where(F.col("support") >= least_support).select("group"), "group", "left_semi").select("item_idx", "group")


def group_support(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group").agg(F.count(F.lit(1)).alias("support"))


def group_ids(groups: DataFrame) -> DataFrame:
    return dense_ids(groups, "group", "group_idx")


def prefixed(prefix: str, value: Column) -> Column:
    """A group's name, or null without a value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix + "::"), value))


def assign_folds(train: DataFrame, folds: int, seed: int, row_key: str = "row_key") -> DataFrame:
    """Adds fold: rows of a user take turns by the hash of their key."""
    keyed = add_key(train, "_k", F.col("user_idx"), F.col(row_key), seed).withColumn("_k", unsigned_order(F.col("_k")))
    place = F.row_number().over(Window.partitionBy("user_idx").orderBy("_k", row_key)) - 1
    return keyed.withColumn("fold", (place % folds).cast("int")).drop("_k")


def user_bias(train: DataFrame, smoothing: float) -> DataFrame:
    """user_idx, bias = (sum y + smoothing * mean y) / (n + smoothing)."""
    mean = train.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    return train.groupBy("user_idx").agg(((F.sum(F.col("y").cast("double")) + F.lit(smoothing * mean)) / (F.count(F.lit(1)) + F.lit(smoothing))).alias("bias"))


def user_group_coefficients(train: DataFrame, bias: DataFrame, groups: DataFrame, smoothing: float, least_count: int) -> DataFrame:
    """user_idx, group, coef = sum of (y - bias) / (n + smoothing), where n is least_count or more."""
    rows = train.join(bias, "user_idx").join(groups, "item_idx").select("user_idx", "group", (F.col("y").cast("double") - F.col("bias")).alias("_d"))
    summed = rows.groupBy("user_idx", "group").agg(F.sum("_d").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return summed.where(F.col("_n") >= least_count).select("user_idx", "group", (F.col("_s") / (F.col("_n") + F.lit(smoothing))).alias("coef"))


def cross_fitted_control(train: DataFrame, groups: DataFrame, folds: int, smoothing: float, least_count: int) -> DataFrame:
    """train(row_key, user_idx, item_idx, y, fold) with user_oof and group_oof, each predicted from the other folds.

    No fold is a pass of its own: totals per (user, fold) and (user, group, fold) are summed once, and what a fold
    learns from is the total without its own part. A user whose rows all lie in the fold has the others' mean y smoothed
    alone; group coefficients use the fold's own biases, as sum y - n * bias over the user's rows in the group."""
    y = F.col("y").cast("double")
    by_fold = {r["fold"]: (r["s"], r["n"]) for r in train.groupBy("fold").agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    total = [sum(v[k] for v in by_fold.values()) for k in (0, 1)]
    means = [(f, (total[0] - s) / (total[1] - n) if total[1] > n else 0.0) for f, (s, n) in by_fold.items()]
    mean = F.coalesce(*[F.when(F.col("fold") == f, F.lit(float(m))) for f, m in means]) if means else F.lit(0.0)

    def without_own(rows: DataFrame, keys: list[str], sum_name: str, count_name: str) -> DataFrame:
        per = rows.groupBy(*keys, "fold").agg(F.sum("_y").alias("_s"), F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*keys)
        return per.select(*keys, "fold", (F.sum("_s").over(w) - F.col("_s")).alias(sum_name), (F.sum("_n").over(w) - F.col("_n")).alias(count_name))

    rows = train.withColumn("_y", y)
    users = without_own(rows, ["user_idx"], "u_s", "u_n")
    base = rows.join(users, ["user_idx", "fold"]).withColumn("user_oof", (F.col("u_s") + F.lit(smoothing) * mean) / (F.col("u_n") + F.lit(smoothing)))
    wide = base.join(groups, "item_idx")
    pairs = without_own(wide, ["user_idx", "group"], "g_s", "g_n")
    wide = wide.join(pairs, ["user_idx", "group", "fold"])
    coef = F.when(F.col("g_n") >= least_count, (F.col("g_s") - F.col("g_n") * F.col("user_oof")) / (F.col("g_n") + F.lit(smoothing))).otherwise(0.0)
    per_row = wide.groupBy("row_key").agg(F.sum(coef).alias("_g"))
    own = [c for c in train.columns]
    return base.join(per_row, "row_key", "left").select(*own, "user_oof", F.coalesce("_g", F.lit(0.0)).alias("group_oof"))


def binary_report(scored: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """One row: log_loss (p kept 1e-6 off 0 and 1), brier, auroc (rank statistic; ties count half). Ranks come from the
    counts per distinct score, in ranges of scores."""
    from .prep import positions

    y, q = F.col(label).cast("double"), F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    base = scored.agg(F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier")).first()
    placed = positions(scored.select(p, label, F.monotonically_increasing_id().alias("_id")), F.col(p), F.col("_id"))
    per = placed.groupBy(p).agg(F.avg(F.col("position") + 1.0).alias("r"), F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    s = per.agg(F.sum(F.col("r") * F.col("pos")).alias("rs"), F.sum("pos").alias("pos"), F.sum("n").alias("n")).first()
    neg = (s["n"] or 0) - (s["pos"] or 0)
    auc = (s["rs"] - s["pos"] * (s["pos"] + 1) / 2) / (s["pos"] * neg) if s["pos"] and neg else None
    return scored.sparkSession.createDataFrame([(base["log_loss"], base["brier"], auc)], "log_loss double, brier double, auroc double")
