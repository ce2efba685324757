"""Metrics over lists that keep arriving: the sums of hits, gains and reciprocal ranks add up across batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listrank.operators.metrics import hit, long_ranks, ndcg
from listrank.operators.ranking import KEYED, KEY_SEED, TiePolicy, positive_ranks


def state(candidates: DataFrame, policies: Sequence[TiePolicy] = KEYED, seed: int = KEY_SEED, k: int = 10) -> DataFrame:
    """policy, n, hits, gains, reciprocal: what a batch adds. Lists that can't be evaluated raise; no list adds nothing."""
    r = F.col("rank")
    return long_ranks(positive_ranks(candidates, policies, seed, k=k)).groupBy("policy").agg(F.count(r).alias("n"), F.sum(hit(r, k)).alias("hits"), F.sum(ndcg(r, k)).alias("gains"), F.sum(1.0 / r).alias("reciprocal"))


def merge(states: DataFrame) -> DataFrame:
    """policy, n_rows, hit_at_k, ndcg_at_k, mrr of any number of states."""
    n = F.sum("n")
    return states.groupBy("policy").agg(n.alias("n_rows"), (F.sum("hits") / n).alias("hit_at_k"), (F.sum("gains") / n).alias("ndcg_at_k"), (F.sum("reciprocal") / n).alias("mrr"))


def evaluate_stream(candidates: DataFrame, path: str, checkpoint: str, k: int = 10) -> StreamingQuery:
    """Writes each batch's state below path, under its number, so that a batch that runs again replaces itself. The
    lists of a batch must be whole."""

    def add(batch: DataFrame, number: int) -> None:
        state(batch, k=k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return candidates.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
