"""Ranking of candidate lists under tie policies.

Candidates are long: row_id, user_idx, slot, item_idx, is_positive, score (float). A candidate is known by (row_id,
slot): items may repeat among the negatives."""

from __future__ import annotations

from collections.abc import Sequence
from enum import StrEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listrank.functions.keys import add_key, float32_key, unsigned_order

KEY_SEED = 20_260_316


class TiePolicy(StrEnum):
    """Orders among equal scores: by slot; by float key, then slot; by unsigned key, then item; the same by another
    seed."""

    STABLE = "stable_positive_first"
    FLOAT32 = "archived_float32"
    HARDENED = "hardened_uint64"
    RANDOMIZED = "randomized"


KEYED = (TiePolicy.STABLE, TiePolicy.FLOAT32, TiePolicy.HARDENED)


def with_keys(candidates: DataFrame, seed: Column | int = KEY_SEED, random_seed: Column | int | None = None) -> DataFrame:
    """Adds key (bit pattern), sort_key (sorts as the unsigned key), key32, and random_key if a random seed is given."""
    df = add_key(candidates, "key", F.col("user_idx"), F.col("item_idx"), seed)
    df = df.withColumn("sort_key", unsigned_order(F.col("key"))).withColumn("key32", float32_key(F.col("key")))
    if random_seed is not None:
        df = add_key(df, "random_key", F.col("user_idx"), F.col("item_idx"), random_seed)
        df = df.withColumn("random_key", unsigned_order(F.col("random_key")))
    return df


def tie_columns(policy: TiePolicy) -> tuple[str, ...]:
    return {
        TiePolicy.STABLE: ("slot",), TiePolicy.FLOAT32: ("key32", "slot"),
        TiePolicy.HARDENED: ("sort_key", "item_idx"), TiePolicy.RANDOMIZED: ("random_key", "item_idx"),
    }[TiePolicy(policy)]


def rank_all(keyed: DataFrame, policy: TiePolicy) -> DataFrame:
    """Adds rank (from 1) of every candidate of with_keys() in its list."""
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), *tie_columns(policy), "slot")
    return keyed.withColumn("rank", F.row_number().over(order))


def lists(keyed: DataFrame) -> DataFrame:
    """One row per list: row_id, user_idx, cands (structs), positive (the struct), n_positive. One shuffle; the input's
    size bounds a list, so no list is cut. Nothing is checked here: see checked_lists."""
    own = [c for c in ("slot", "item_idx", "score", "sort_key", "key32", "random_key", "is_positive") if c in keyed.columns]
    grouped = keyed.groupBy("row_id").agg(F.min("user_idx").alias("user_idx"), F.collect_list(F.struct(*own)).alias("cands"))
    positives = F.filter("cands", lambda x: x["is_positive"])
    return grouped.select("row_id", "user_idx", "cands", F.get(positives, F.lit(0)).alias("positive"), F.size(positives).alias("n_positive"))


def bad_score(score: Column) -> Column:
    """Scores that have no place in an order: null, NaN and infinite ones."""
    return score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))


def checked_lists(keyed: DataFrame, k: int | None = None, spare: int = 0) -> DataFrame:
    """lists(), where a list that can't be evaluated raises as soon as its positive is used: one without exactly one
    positive, one in which the positive's item or its slot repeats, one with a bad score, one narrower than k + spare."""
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    named = F.concat(F.lit("list "), F.coalesce(F.col("row_id").cast("string"), F.lit("null")), F.lit(": "))
    fault = F.when(F.col("n_positive") != 1, F.concat(named, F.col("n_positive").cast("string"), F.lit(" positives")))
    fault = fault.when(F.size(F.filter("cands", lambda x: x["item_idx"] == F.col("positive.item_idx"))) != 1, F.concat(named, F.lit("the positive item is not there exactly once")))
    fault = fault.when(F.exists("cands", lambda x: bad_score(x["score"])), F.concat(named, F.lit("a score is null, NaN or infinite")))
    if k is not None:
        fault = fault.when(F.size("cands") < k + spare, F.concat(named, F.lit(f"k = {k} does not fit "), F.size("cands").cast("string"), F.lit(" candidates")))
    checked = lists(keyed).withColumn("_fault", fault)
    return checked.withColumn("positive", F.when(F.col("_fault").isNull(), F.col("positive")).otherwise(F.raise_error(F.col("_fault")))).drop("_fault")


def counted(n: Column) -> Column:
    """A number of lists; none at all raises."""
    return F.when(n > 0, n).otherwise(F.raise_error(F.lit("at least one list is required")))


def _beats(policy: TiePolicy, x: Column, p: Column) -> Column:
    tie = F.lit(False)
    for name in reversed(tie_columns(policy)):
        tie = (x[name] < p[name]) | ((x[name] == p[name]) & tie)
    return (x["score"] > p["score"]) | ((x["score"] == p["score"]) & tie)


def rank_by_counting(policy: TiePolicy) -> Column:
    """The positive's rank in a row of lists(): one more than the candidates that beat it. No sort, no shuffle."""
    return (1 + F.size(F.filter("cands", lambda x: _beats(policy, x, F.col("positive"))))).cast("int")


def positive_ranks(candidates: DataFrame, policies: Sequence[TiePolicy] = KEYED, seed: Column | int = KEY_SEED, random_seed: int | None = None, k: int | None = None) -> DataFrame:
    """row_id and one rank column per policy, named as the policy: all ranks in one projection. Lists that can't be
    evaluated (at k, if given) raise."""
    random_seed = seed if random_seed is None and TiePolicy.RANDOMIZED in policies else random_seed
    return checked_lists(with_keys(candidates, seed, random_seed), k).select("row_id", *[rank_by_counting(p).alias(str(TiePolicy(p))) for p in policies])


def in_order(policy: TiePolicy, reverse_slots: bool = False) -> Column:
    """The items of a row of lists() in ranked order. Slots turned around turn around every pair that slots decide."""
    ties = [c for c in tie_columns(policy) if c != "slot"]

    def place(x: Column) -> Column:
        slot = -x["slot"] if reverse_slots else x["slot"]
        return F.struct((-x["score"]).alias("score"), *[x[c].alias(f"tie_{c}") for c in ties], slot.alias("slot"), x["item_idx"].alias("item_idx"))

    return F.transform(F.sort_array(F.transform("cands", place)), lambda x: x["item_idx"])


def ranked_items(keyed: DataFrame, policy: TiePolicy) -> DataFrame:
    """row_id, items: the items of each list in ranked order."""
    return lists(keyed).select("row_id", in_order(policy).alias("items"))
