"""From raw interactions to indexed, filtered and split ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listrank.sources.tables import checkpointed


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one last in order. An aggregate, so partial maxima go before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.first(F.lit(1))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def k_core(df: DataFrame, k_user: int, k_item: int, user: str = "user_id", item: str = "item_id", most_rounds: int = 25) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Drops users, then items, with too few rows until nothing changes; also (round, rows before, rows after). Each round
    is checkpointed; the driver sees counts only. Null ids are dropped."""
    now = checkpointed(df.where(F.col(user).isNotNull() & F.col(item).isNotNull()))
    before, history = now.count(), []
    for turn in range(1, most_rounds + 1):
        step = now
        for column, least in ((user, k_user), (item, k_item)):
            enough = step.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(column)
            step = step.join(enough, column, "left_semi")
        now = checkpointed(step)
        after = now.count()
        history.append((turn, before, after))
        if after == before:
            break
        before = after
    return now.select(*df.columns), history


def positions(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Adds each row's place (from 0) in a total order, without a single-partition window: rows are dealt to ranges,
    numbered within their range, and shifted by the sizes of the ranges before. The driver sees one count per range."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    shift, total = [], 0
    for p in sorted(sizes):
        shift.append((p, total))
        total += sizes[p]
    shifts = spark.createDataFrame(shift, "_p int, _shift long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", within).join(F.broadcast(shifts), F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct values numbered from 0 in order."""
    return positions(df.select(column).where(F.col(column).isNotNull()).distinct(), F.col(column), name=name)


def first_appearance_ids(df: DataFrame, column: str, order: Sequence[Column], name: str) -> DataFrame:
    """(column, name): the distinct values numbered from 0 by their first row in order."""
    firsts = df.groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    return positions(firsts, F.col("_first"), name=name).select(column, name)


def leave_last_two(df: DataFrame, user: str, order: Sequence[str], test: int = 1, validation: int = 1) -> DataFrame:
    """Adds within_user_rank, within_user_count and split: a user's last `test` rows, the `validation` before, the
    rest."""
    w = Window.partitionBy(user)
    df = df.withColumn("within_user_rank", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("within_user_count", F.count(F.lit(1)).over(w))
    left = F.col("within_user_count") - F.col("within_user_rank")
    return df.withColumn("split", F.when(left < test, "test").when(left < test + validation, "validation").otherwise("train"))


def global_time_split(df: DataFrame, *order: Column, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Adds position and split: the first share of all rows in order, the next, the rest; bounds are cut to integers."""
    placed = positions(df, *order)
    n = df.count()
    return placed.withColumn("split", F.when(F.col("position") < int(n * train), "train").when(F.col("position") < int(n * (train + validation)), "validation").otherwise("test"))


def first_targets(test: DataFrame, most_users: int, user: str = "user_idx", item: str = "item_idx", position: str = "position") -> DataFrame:
    """user, item, position of the first row of each user, for the first most_users users by that position."""
    first = test.groupBy(user).agg(F.min_by(F.struct(item, position), position).alias("_first"))
    return first.orderBy(f"_first.{position}").limit(most_users).select(user, f"_first.{item}", f"_first.{position}")


def item_statistics(df: DataFrame, item: str = "item_id", user: str = "user_id", rating: str = "rating", ts: str = "ts") -> DataFrame:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("interaction_count"), F.countDistinct(user).alias("user_count"), F.avg(rating).alias("mean_review_rating"), F.max(ts).alias("latest_timestamp"))


def known_items(df: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """Rows whose item has metadata."""
    return df.join(items.select(item).distinct(), item, "left_semi")
