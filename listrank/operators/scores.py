"""User profiles over item attributes, and scores of candidates.

Attributes are columns, few and known. Sums run in double and are cast to float once, so equal items always tie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute_means(items: DataFrame, attrs: Sequence[str]) -> dict[str, float]:
    row = items.agg(*[F.avg(F.coalesce(F.col(a), F.lit(0)).cast("double")).alias(a) for a in attrs]).first()
    return {a: float(row[a] or 0.0) for a in attrs}


def centered(items: DataFrame, attrs: Sequence[str]) -> DataFrame:
    means = attribute_means(items, attrs)
    return items.withColumns({a: F.coalesce(F.col(a), F.lit(0)).cast("double") - F.lit(means[a]) for a in attrs})


def residuals(items: DataFrame, attrs: Sequence[str], propensity: str = "p_{}", trim_above: float = 0.95) -> DataFrame:
    """attribute - propensity; 0 where the propensity is over trim_above; an unknown propensity is the mean."""
    means = attribute_means(items, attrs)

    def one(a: str) -> Column:
        p = F.nanvl(F.coalesce(F.col(propensity.format(a)).cast("double"), F.lit(means[a])), F.lit(means[a]))
        return F.when(p > trim_above, 0.0).otherwise(F.coalesce(F.col(a), F.lit(0)).cast("double") - p)

    return items.withColumns({a: one(a) for a in attrs})


def user_profiles(train: DataFrame, items: DataFrame, attrs: Sequence[str], weight: Column | None = None) -> DataFrame:
    """user_idx and, for each attribute, the float sum of weight * attribute over the user's rows."""
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    rows = train.join(items.select("item_idx", *attrs), "item_idx")
    return rows.groupBy("user_idx").agg(*[F.sum(weight * F.col(a)).cast("float").alias(a) for a in attrs])


def centered_profiles(train: DataFrame, items: DataFrame, attrs: Sequence[str], weight: Column | None = None) -> DataFrame:
    """As user_profiles over centered items, from two sums that are exact for dyadic weights: sum(w * a) - mean * sum(w).
    So the result does not depend on the order of rows."""
    means, weight = attribute_means(items, attrs), F.lit(1.0) if weight is None else weight.cast("double")
    rows = train.join(items.select("item_idx", *attrs), "item_idx")
    return rows.groupBy("user_idx").agg(*[(F.sum(weight * F.col(a)) - F.lit(means[a]) * F.sum(weight)).cast("float").alias(a) for a in attrs])


def popularity(train: DataFrame, items: DataFrame) -> DataFrame:
    """item_idx, popularity (float) of every item."""
    counts = train.groupBy("item_idx").agg(F.count(F.lit(1)).alias("_n"))
    return items.select("item_idx").join(counts, "item_idx", "left").select("item_idx", F.coalesce("_n", F.lit(0)).cast("float").alias("popularity"))


def score_by_profile(candidates: DataFrame, users: DataFrame, items: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """candidates with score: the dot product of user and item, in double and attribute order, as float. Only candidate
    pairs are scored; a user without a profile scores 0."""
    u = users.select(F.col("user_idx").alias("_u"), *[F.col(a).alias(f"_u_{a}") for a in attrs])
    i = items.select(F.col("item_idx").alias("_i"), *[F.col(a).alias(f"_i_{a}") for a in attrs])
    both = candidates.join(u, F.col("user_idx") == F.col("_u"), "left").join(i, F.col("item_idx") == F.col("_i"))
    dot = F.lit(0.0)
    for a in attrs:
        dot = dot + F.coalesce(F.col(f"_u_{a}"), F.lit(0)).cast("double") * F.col(f"_i_{a}").cast("double")
    return both.select(*[candidates[c] for c in candidates.columns if c != "score"], dot.cast("float").alias("score"))


def score_by_item(candidates: DataFrame, items: DataFrame, value: str) -> DataFrame:
    i = items.select(F.col("item_idx").alias("_i"), F.col(value).cast("float").alias("_v"))
    return candidates.drop("score").join(i, F.col("item_idx") == F.col("_i")).select(*[c for c in candidates.columns if c != "score"], F.col("_v").alias("score"))
