"""The engine's roles played by a star schema: users are customers, items are parts, events are shipped line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listrank.functions.text import scaled_rating
from listrank.operators import prep, sampling, scores
from listrank.sources.tables import checkpointed

ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
NEGATIVES, SAMPLE_SEED = 30, 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rating = 1.0 + F.floor((F.col("l_quantity") - 1) / 10)
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long").alias("ts"), rating.cast("double").alias("rating"), *ORDER)


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.last_wins(interactions(spark, sf_dir), ("user_id", "item_id", "ts"), ORDER).select("user_id", "item_id", "ts", "rating")


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(deduplicated(spark, sf_dir))
    users, items = prep.dense_ids(rows, "user_id", "user_idx"), prep.dense_ids(rows, "item_id", "item_idx")
    return rows.join(users, "user_id").join(items, "item_id").withColumn("y", scaled_rating(F.col("rating")))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(prep.leave_last_two(mapped(spark, sf_dir), "user_idx", ("ts", "item_idx")))


#: Types that become columns; more raise.
MOST_TYPES = 100


def items_with_types(rows: DataFrame, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """item_idx, brand, type, size, price and a 0/1 column per type; types are a handful."""
    parts = table(spark, sf_dir, "part")
    types = [r[0] for r in parts.select("p_type").distinct().orderBy("p_type").limit(MOST_TYPES + 1).collect()]
    if len(types) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} part types")
    known = rows.select("item_id", "item_idx").distinct()
    flags = {f"a{i}": (F.col("p_type") == t).cast("int") for i, t in enumerate(types)}
    items = known.join(parts, F.col("item_id") == F.col("p_partkey")).withColumns(flags)
    return items.select("item_id", "item_idx", "p_brand", "p_type", "p_size", "p_retailprice", *flags), list(flags)


def candidates(rows: DataFrame, unique: bool = False) -> DataFrame:
    """A list for each user's test item; history is all earlier rows."""
    targets = rows.where("split = 'test'").select(F.col("user_idx").alias("row_id"), "user_idx", "item_idx")
    n_items = rows.agg(F.max("item_idx") + 1).first()[0] or 1
    return sampling.sample_candidates(targets, sampling.history(rows.where("split <> 'test'")), n_items, NEGATIVES, SAMPLE_SEED, unique)


def scored(spark: SparkSession, sf_dir: str, family: str = "popularity") -> DataFrame:
    """Candidates with the scores of a family: popularity, raw_count or centered_count."""
    rows = split(spark, sf_dir)
    train, lists = rows.where("split = 'train'"), candidates(rows)
    items, attrs = items_with_types(rows, spark, sf_dir)
    if family == "popularity":
        return checkpointed(scores.score_by_item(lists, scores.popularity(train, items), "popularity"))
    if family == "raw_count":
        return checkpointed(scores.score_by_profile(lists, scores.user_profiles(train, items, attrs, F.col("y")), items, attrs))
    users = scores.centered_profiles(train, items, attrs, F.col("y"))
    return checkpointed(scores.score_by_profile(lists, users, scores.centered(items, attrs), attrs))
