"""How much of a result depends on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import KEY_SEED, TiePolicy, checked_lists, counted, in_order, lists, rank_by_counting, with_keys


def _rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def _mean_where(value: Column, condition: Column) -> Column:
    """0 where nothing meets the condition."""
    return F.coalesce(F.avg(F.when(condition, value.cast("double"))), F.lit(0.0))


def row_diagnostics(candidates: DataFrame, k: int = 10) -> DataFrame:
    """row_id, any_tie, boundary_tie (a tie across rank k), positive_tied, max_block, tie_size of each list. Lists that
    can't be evaluated, or have no candidate beyond the first k, raise."""
    scores = F.transform("cands", lambda x: x["score"])
    df = checked_lists(candidates, k, spare=1).withColumn("_s", F.sort_array(scores, asc=False)).withColumn("_d", F.array_distinct("_s"))
    edge = F.get("_s", F.lit(k - 1))
    blocks = F.transform("_d", lambda d: F.size(F.filter("_s", lambda s: s == d)))
    return df.select(
        "row_id", (F.size("_d") < F.size("_s")).alias("any_tie"),
        ((F.size(F.filter("_s", lambda s: s > edge)) < k) & (F.size(F.filter("_s", lambda s: s >= edge)) > k)).alias("boundary_tie"),
        F.array_max(blocks).alias("max_block"), F.size(F.filter("_s", lambda s: s == F.col("positive.score"))).alias("tie_size"),
    ).withColumn("positive_tied", F.col("tie_size") > 1)


def tie_diagnostics(candidates: DataFrame, k: int = 10) -> DataFrame:
    """One row. The median comes from the counts of block sizes, of which there are no more than a list is wide."""
    rows = row_diagnostics(candidates, k)
    return rows.agg(
        counted(F.count(F.lit(1))).alias("n_rows"), _rate(F.col("any_tie")).alias("any_tie_rate"), _rate(F.col("boundary_tie")).alias("boundary_tie_rate"),
        _rate(F.col("positive_tied")).alias("positive_in_tie_rate"), F.avg("max_block").alias("average_max_tie_block"), F.median("max_block").alias("median_max_tie_block"),
        _mean_where(F.col("tie_size"), F.col("positive_tied")).alias("average_positive_tie_size"),
    )


def _top(order: Column, k: int) -> Column:
    return F.sort_array(F.array_distinct(F.slice(order, 1, k)))


def top_sets(candidates: DataFrame, policy: TiePolicy, k: int = 10, seed: int = KEY_SEED) -> DataFrame:
    """row_id, top: the distinct items of the first k, sorted."""
    return lists(with_keys(candidates, seed)).select("row_id", _top(in_order(policy), k).alias("top"))


def policy_difference(candidates: DataFrame, left: TiePolicy, right: TiePolicy, k: int = 10, seed: int = KEY_SEED) -> DataFrame:
    """One row: how often the top-k item set and the positive's rank change from one policy to the other. A list is
    sorted under both policies within its own row: one shuffle. Lists that can't be evaluated raise."""
    listed = checked_lists(with_keys(candidates, seed), k, spare=1)
    rows = listed.select(rank_by_counting(left).alias("l"), rank_by_counting(right).alias("r"), (_top(in_order(left), k) != _top(in_order(right), k)).alias("other_top"))
    moved = F.col("l") != F.col("r")
    return rows.agg(counted(F.count(F.lit(1))).alias("n_rows"), _rate(F.col("other_top")).alias("topk_item_set_change_rate"), _rate(moved).alias("positive_rank_change_rate"), _mean_where(F.abs(F.col("l") - F.col("r")), moved).alias("mean_absolute_positive_rank_change"))


def collision_audit(candidates: DataFrame, seed: int = KEY_SEED) -> DataFrame:
    """One row: lists with equal float keys of different items, and lists in which an item repeats."""
    keyed = with_keys(candidates, seed)
    per_key = keyed.groupBy("row_id", "key32").agg(F.countDistinct("item_idx").alias("items"), F.count(F.lit(1)).alias("n"))
    rows = per_key.groupBy("row_id").agg(F.max(F.col("items") > 1).alias("collides"), F.sum("items").alias("items"), F.sum("n").alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("collides").alias("collision_rows"), F.count_if(F.col("items") < F.col("n")).alias("duplicate_identity_rows"))


def permutation_changes(candidates: DataFrame, policies: tuple[TiePolicy, ...], seed: int = KEY_SEED) -> DataFrame:
    """policy, n_rows, changed_rows: lists whose item order changes when their slots are turned around. That permutation
    turns around each pair that slots decide, so a list that it leaves as it is depends on slots under no other."""
    listed = lists(with_keys(candidates, seed))
    cells = [F.struct(F.lit(str(TiePolicy(p))).alias("policy"), F.count(F.lit(1)).alias("n_rows"), F.count_if(in_order(p) != in_order(p, reverse_slots=True)).alias("changed_rows")) for p in policies]
    return listed.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _neighbours(sorted_structs: Column, same: tuple[str, ...]) -> Column:
    """How many neighbours of a sorted array agree in `same` and are different items."""
    def meets(x: Column, i: Column) -> Column:
        before = F.get(sorted_structs, i - 1)
        out = before["item_idx"] != x["item_idx"]
        for name in same:
            out = out & (before[name] == x[name])
        return F.coalesce(out, F.lit(False))

    return F.size(F.filter(sorted_structs, meets))


def contract_audit(candidates: DataFrame, k: int = 10, seed: int = KEY_SEED) -> DataFrame:
    """One row of counts over lists, from one projection of each: ties (any, across rank k, of the positive), sizes of
    the positive's tie block (mean over all lists and over tied ones, largest), equal float keys of different items
    (anywhere, and within a block of equal scores: lists and adjacent pairs), lists in which an item repeats, lists
    whose order depends on slots under the float and the unsigned key, and lists that differ between both keys in item
    order, top-k set and the positive's rank. Lists that can't be evaluated raise."""
    archived, hardened = TiePolicy.FLOAT32, TiePolicy.HARDENED
    listed = checked_lists(with_keys(candidates, seed), k, spare=1)
    by_key = F.sort_array(F.transform("cands", lambda x: F.struct(x["key32"].alias("key32"), x["item_idx"].alias("item_idx"))))
    by_score = F.sort_array(F.transform("cands", lambda x: F.struct(x["score"].alias("score"), x["key32"].alias("key32"), x["item_idx"].alias("item_idx"))))
    listed = listed.withColumns({"_k": by_key, "_b": by_score, "_s": F.sort_array(F.transform("cands", lambda x: x["score"]), asc=False), "_o": in_order(archived), "_h": in_order(hardened)})
    edge = F.get("_s", F.lit(k - 1))
    rows = listed.select(
        (F.size(F.array_distinct("_s")) < F.size("_s")).alias("tie"), ((F.size(F.filter("_s", lambda s: s > edge)) < k) & (F.size(F.filter("_s", lambda s: s >= edge)) > k)).alias("edge"),
        F.size(F.filter("_s", lambda s: s == F.col("positive.score"))).alias("block"), _neighbours(F.col("_k"), ("key32",)).alias("equal"), _neighbours(F.col("_b"), ("score", "key32")).alias("inside"),
        (F.size(F.array_distinct(F.transform("cands", lambda x: x["item_idx"]))) < F.size("cands")).alias("repeats"),
        (F.col("_o") != in_order(archived, reverse_slots=True)).alias("archived_moves"), (F.col("_h") != in_order(hardened, reverse_slots=True)).alias("hardened_moves"),
        (F.col("_o") != F.col("_h")).alias("order"), (_top(F.col("_o"), k) != _top(F.col("_h"), k)).alias("top"), (rank_by_counting(archived) != rank_by_counting(hardened)).alias("rank"),
    )
    n = F.count(F.lit(1))
    return rows.agg(
        counted(n).alias("n_rows"), F.count_if("repeats").alias("duplicate_identity_rows"), F.count_if(F.col("equal") > 0).alias("float_key_rows"), F.sum("equal").alias("float_key_pairs"),
        F.count_if("tie").alias("any_tie_rows"), F.count_if("edge").alias("boundary_tie_rows"), F.count_if(F.col("block") > 1).alias("positive_in_tie_rows"),
        F.avg("block").alias("mean_block_all_rows"), _mean_where(F.col("block"), F.col("block") > 1).alias("mean_block_tied_rows"), F.max("block").cast("long").alias("max_block"),
        F.count_if(F.col("inside") > 0).alias("float_key_in_tie_rows"), F.sum("inside").alias("float_key_in_tie_pairs"),
        F.count_if("archived_moves").alias("archived_order_dependent_rows"), F.count_if("hardened_moves").alias("hardened_order_dependent_rows"),
        F.count_if("order").alias("order_difference_rows"), F.count_if("top").alias("topk_difference_rows"), F.count_if("rank").alias("positive_rank_difference_rows"),
    )
