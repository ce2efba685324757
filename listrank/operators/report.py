"""Replay, tolerance checks and tables for reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("hit_at_k", "ndcg_at_k", "mrr")


def compare(recorded: DataFrame, replayed: DataFrame, keys: Sequence[str], values: Sequence[str] = METRICS, tolerance: float = 1e-12) -> DataFrame:
    """keys, max_abs_diff, status (pass, fail or missing) for each recorded row."""
    other = replayed.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(v).alias(f"_{v}") for v in values])
    both = recorded.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    diff = F.greatest(*[F.abs(F.col(v) - F.col(f"_{v}")) for v in values], F.lit(0.0))
    gone = F.greatest(*[F.col(f"_{v}").isNull() for v in values], F.lit(False))
    return both.select(*keys, F.when(~gone, diff).alias("max_abs_diff"), F.when(gone, "missing").when(diff <= tolerance, "pass").otherwise("fail").alias("status"))


def policy_pivot(metrics: DataFrame, policies: Sequence[str], value: str = "ndcg_at_k") -> DataFrame:
    """One row per score, one column per policy."""
    return metrics.groupBy("score").pivot("policy", list(policies)).agg(F.first(value))


def mean_and_sd(summary: DataFrame) -> DataFrame:
    return summary.withColumn("shown", F.format_string("%.6f ± %.6f", "mean", "sd"))


def policy_report(metrics: DataFrame, summary: DataFrame, policies: Sequence[str], value: str = "ndcg_at_k") -> DataFrame:
    """One row per score: a column per policy, randomized_mean, randomized_sd, and both as text."""
    pivot, seeds = policy_pivot(metrics, policies, value), mean_and_sd(summary.where(F.col("metric") == value))
    seeds = seeds.select(F.col("score").alias("_score"), F.col("mean").alias("randomized_mean"), F.col("sd").alias("randomized_sd"), F.col("shown").alias("randomized"))
    return pivot.join(seeds, F.col("score") == F.col("_score"), "left").drop("_score")


def cross_domain(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = ("dataset", "score", "metric")) -> DataFrame:
    """keys, stable, keyed, change, source: of several tables (name, keys with stable and keyed), the first that has a
    key; change is keyed - stable."""
    named = [t.select(*keys, "stable", "keyed", F.lit(name).alias("source")) for name, t in sources]
    return prefer(named, keys).withColumn("change", F.col("keyed") - F.col("stable"))


def prefer(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of several tables of one schema; for a key, those of the first table that has it."""
    ranked = [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t)
    rest = [c for c in tables[0].columns if c not in keys]
    return out.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_rank").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def change_table(metrics: DataFrame, stable: str, keyed: str, keys: Sequence[str] = ("score",), value: str = "ndcg_at_k") -> DataFrame:
    """keys, stable, keyed, change = keyed - stable."""
    picked = [F.max(F.when(F.col("policy") == p, F.col(value))).alias(n) for p, n in ((stable, "stable"), (keyed, "keyed"))]
    return metrics.groupBy(*keys).agg(*picked).withColumn("change", F.col("keyed") - F.col("stable"))


def wrong_changes(table: DataFrame, tolerance: float = 5e-5) -> DataFrame:
    """Rows of a table of rounded figures (stable, keyed, change) whose change is not keyed - stable."""
    return table.where(~F.coalesce(F.abs(F.col("keyed") - F.col("stable") - F.col("change")) <= tolerance, F.lit(False)))


def within(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """keys, expected, actual, abs_diff, status of figures (keys, value)."""
    other = actual.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("actual"))
    both = expected.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(*keys, F.col("value").alias("expected"), "actual")
    diff = F.abs(F.col("expected") - F.col("actual"))
    return both.withColumn("abs_diff", diff).withColumn("status", F.when(diff.isNull(), "missing").when(diff <= tolerance, "pass").otherwise("fail"))


def relabelled(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """Rows whose value has a label, in the labels' order, with the label in its place."""
    place = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(column))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col(column))
    return df.where(place > 0).orderBy(place).withColumn(column, named)
