"""Hit@k, NDCG@k and MRR of lists with one positive, with exact expectations over tie orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listrank.functions.keys import add_key, unsigned_order

from .ranking import KEY_SEED, KEYED, TiePolicy, checked_lists, counted, positive_ranks


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def ndcg(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0 / F.log2(rank + 1)).otherwise(0.0)


def aggregates(rank: Column, k: int) -> list[Column]:
    """n_rows, hit_at_k, ndcg_at_k and mrr (not cut at k): sums with map-side partial sums."""
    return [F.count(rank).alias("n_rows"), F.avg(hit(rank, k)).alias("hit_at_k"), F.avg(ndcg(rank, k)).alias("ndcg_at_k"), F.avg(1.0 / rank).alias("mrr")]


def long_ranks(ranks: DataFrame) -> DataFrame:
    """(row_id, policy, rank) of a table with one rank column per policy."""
    names = [c for c in ranks.columns if c != "row_id"]
    return ranks.select("row_id", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n).alias("rank")) for n in names])).alias("r")).select("row_id", "r.*")


def evaluate(candidates: DataFrame, policies: Sequence[TiePolicy] = KEYED, seed: int = KEY_SEED, ks: Sequence[int] = (10,), random_seed: int | None = None) -> DataFrame:
    """policy, k, n_rows, hit_at_k, ndcg_at_k, mrr for every policy and cut-off, from one pass over the lists: all are
    sums of one aggregate, so a list adds one row to it whatever the number of policies. Lists that can't be evaluated,
    and none at all, raise."""
    if not ks or min(ks) < 1:
        raise ValueError("k must be positive")
    ranks = positive_ranks(candidates, policies, seed, random_seed, max(ks))
    cells = []
    for p in policies:
        r = F.col(str(TiePolicy(p)))
        for k in ks:
            n, *rest = aggregates(r, k)
            cells.append(F.struct(F.lit(str(TiePolicy(p))).alias("policy"), F.lit(k).alias("k"), counted(n).alias("n_rows"), *rest))
    return ranks.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def tie_counts(listed: DataFrame) -> DataFrame:
    """row_id, above (scores over the positive's), tied (equal ones, its own included), width."""
    p = F.col("positive")
    return listed.select("row_id", F.size(F.filter("cands", lambda x: x["score"] > p["score"])).alias("above"), F.size(F.filter("cands", lambda x: x["score"] == p["score"])).alias("tied"), F.size("cands").alias("width"))


def expected_metrics(candidates: DataFrame, k: int = 10) -> DataFrame:
    """One row: the metrics' exact expectation when each tie order is equally likely. The positive's rank is uniform on
    above + 1 to above + tied. Lists that can't be evaluated, and none at all, raise."""
    counts = tie_counts(checked_lists(candidates, k))
    ranks = F.sequence(F.col("above") + 1, F.col("above") + F.col("tied"))

    def mean(value) -> Column:
        return F.aggregate(F.transform(ranks, lambda r: value(r)), F.lit(0.0), lambda a, x: a + x) / F.col("tied")

    hits = F.greatest(F.lit(0), F.least(F.lit(k) - F.col("above"), F.col("tied"))) / F.col("tied")
    return counts.agg(counted(F.count(F.lit(1))).alias("n_rows"), F.avg(hits).alias("hit_at_k"), F.avg(mean(lambda r: ndcg(r, k))).alias("ndcg_at_k"), F.avg(mean(lambda r: 1.0 / r)).alias("mrr"))


def repeated_metrics(candidates: DataFrame, repetitions: int, seed_start: int, k: int = 10) -> DataFrame:
    """seed, n_rows, hit_at_k, ndcg_at_k, mrr of the randomized policy for each of the seeds, in one job. Only
    candidates that tie with their positive depend on the seed, so only they are keyed once per seed; keys are compared
    as rows. The rows of a list stay in the partition that the list's own shuffle put it in, so the counts per (list,
    seed) need no second one; sums per seed are partial before theirs. Lists that can't be evaluated raise."""
    p = F.col("positive")
    base = checked_lists(candidates, k).select("row_id", "user_idx", (1 + F.size(F.filter("cands", lambda x: x["score"] > p["score"]))).alias("base"), p["item_idx"].alias("mine"), F.filter("cands", lambda x: (x["score"] == p["score"]) & ~x["is_positive"]).alias("ties"))
    seeds = F.explode(F.sequence(F.lit(seed_start).cast("long"), F.lit(seed_start + repetitions - 1).cast("long"))).alias("seed")
    rows = base.select("row_id", "user_idx", "base", "mine", F.transform("ties", lambda x: x["item_idx"]).alias("items"), seeds)
    flat = with_pair_keys(rows.select("row_id", "seed", "base", "user_idx", "mine", F.explode_outer("items").alias("other")))
    beaten = F.when(F.col("other").isNotNull() & ((F.col("other_key") < F.col("mine_key")) | ((F.col("other_key") == F.col("mine_key")) & (F.col("other") < F.col("mine")))), 1).otherwise(0)
    ranks = flat.groupBy("row_id", "seed").agg((F.max("base") + F.sum(beaten)).alias("rank"))
    return ranks.groupBy("seed").agg(*aggregates(F.col("rank"), k))


def with_pair_keys(flat: DataFrame) -> DataFrame:
    for name in ("mine", "other"):
        flat = add_key(flat, f"{name}_key", F.col("user_idx"), F.col(name), F.col("seed")).withColumn(f"{name}_key", unsigned_order(F.col(f"{name}_key")))
    return flat


def summarize(per_seed: DataFrame, metrics: Sequence[str] = ("hit_at_k", "ndcg_at_k", "mrr")) -> DataFrame:
    """metric, mean, sd (n - 1 below; 0 for one seed), se, min, max over seeds."""
    long = per_seed.select("seed", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")).select("m.*")
    sd = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count("value"))).alias("se"), F.min("value").alias("min"), F.max("value").alias("max"))
