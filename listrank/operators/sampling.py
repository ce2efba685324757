"""Candidate lists: a held-out positive and negatives that its user has no history with."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listrank.functions.keys import add_key, unsigned_order
from listrank.sources.tables import checkpointed


def history(*tables: DataFrame) -> DataFrame:
    """Distinct (user_idx, item_idx) of one or more splits."""
    out = tables[0].select("user_idx", "item_idx")
    for t in tables[1:]:
        out = out.unionByName(t.select("user_idx", "item_idx"))
    return out.distinct()


#: Draws a row, in three rounds, before what is left is chosen among the row's eligible items.
ROUNDS = (60, 120, 240)


def _by_sorting(df: DataFrame) -> DataFrame:
    """To be joined by sorting. Spark takes an exploded sequence for one row, and so would send tables of any size to all
    executors, through the driver."""
    return df.hint("merge")


def _place(item: Column) -> tuple[Column, Column]:
    """An item's block of 64 and its bit in it."""
    return F.shiftright(item.cast("long"), 6), item.cast("long").bitwiseAND(F.lit(63).cast("long")).cast("int")


def _masks(seen: DataFrame, n_items: int) -> DataFrame:
    """user_idx, _block, _mask: a user's items of the catalogue, 64 to a row, never more rows than seen has."""
    block, bit = _place(F.col("item_idx"))
    inside = seen.where((F.col("item_idx") >= 0) & (F.col("item_idx") < n_items))
    return inside.select("user_idx", block.alias("_block"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("user_idx", "_block").agg(F.bit_or("_bit").alias("_mask"))


#: Items of a catalogue up to which a user's history lies beside each of the user's rows, 16 bytes for a block that holds
#: any of it, so 16 KB at most. With more items, each draw meets its block of the history by a join.
PACKED = 1 << 16


def _met(df: DataFrame, known: DataFrame | None) -> DataFrame:
    """Adds _mask, what the user knows of _block: from the row's own _known, or else from known."""
    if known is None:
        return df.withColumn("_mask", F.col("_known")[F.col("_block")])
    return df.join(_by_sorting(known), ["user_idx", "_block"], "left")


def _drawn(rows: DataFrame, known: DataFrame | None, n_items: int, seed: int, unique: bool) -> DataFrame:
    """row_id, user_idx, item_idx, draw: those of a row's first _draws draws that count."""
    draws = rows.withColumnRenamed("item_idx", "_positive").withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("_draws") - 1)))
    draws = add_key(draws, "_key", F.col("row_id"), F.col("draw"), seed)
    # beside a row number, filters and joins stay above the key: pushed below, they would repeat its whole expression
    draws = draws.withColumn("item_idx", F.shiftrightunsigned("_key", 1) % F.lit(n_items)).withColumn("_at", F.monotonically_increasing_id())
    block, bit = _place(F.col("item_idx"))
    draws = draws.where("item_idx <> _positive AND _at >= 0").withColumn("_block", block).drop("_key", "_at", "_positive", "_draws")
    fresh = _met(draws, known).where(F.col("_mask").isNull() | (F.getbit("_mask", bit) == 0)).select("row_id", "user_idx", "item_idx", F.col("draw").cast("long").alias("draw"))
    return fresh.groupBy("row_id", "user_idx", "item_idx").agg(F.min("draw").alias("draw")) if unique else fresh


def sample_candidates(targets: DataFrame, seen: DataFrame, n_items: int, negatives: int = 30, seed: int = 42, unique: bool = False, rounds: Sequence[int] = ROUNDS) -> DataFrame:
    """targets(row_id, user_idx, item_idx): row_id, user_idx, slot, item_idx, is_positive; the positive has slot 0.

    A row's draws are hashes of (row, draw number) modulo the items: no state, the same on any partitioning. A draw
    counts unless it is the positive or in the user's history (held as bits); with `unique`, unless it came before. The
    first `negatives` draws that count are taken. Rounds only count how many do: rows that are still short draw more in
    the next round, and the lists are drawn at the end, by as many draws as each row turned out to need. So no draws are
    stored, and in catalogues of PACKED items none are shuffled.

    Rows that all rounds leave short are those of users who know nearly all items, or nearly all but `negatives`. They
    are filled exactly: the catalogue's blocks of 64 items are listed for these rows alone, and of these the items outside
    the history and not the positive. With `unique`, the eligible items not yet taken follow in hash order; else draws go
    on among the eligible items, each as likely as any. So a row is filled whenever it can be: one with fewer than
    `negatives` eligible items (none at all without `unique`) raises, and lists are never padded."""
    rows, known = targets.select("row_id", "user_idx", "item_idx"), _masks(seen, n_items)
    if n_items <= PACKED:
        own = known.groupBy("user_idx").agg(F.map_from_entries(F.collect_list(F.struct("_block", "_mask"))).alias("_known"))
        rows, known = rows.join(_by_sorting(own), "user_idx", "left"), None
    else:
        known = checkpointed(known)
    rows = checkpointed(rows)
    need, steps, filled = rows.repartition("row_id"), None, None
    for upto in accumulate(rounds):
        held = _drawn(need.withColumn("_draws", F.lit(upto)), known, n_items, seed, unique).groupBy("row_id").agg(F.count(F.lit(1)).alias("held"))
        held = need.select("row_id").join(_by_sorting(held), "row_id", "left")
        held = checkpointed(held.select("row_id", F.coalesce("held", F.lit(0)).alias("held"), F.lit(upto).alias("_draws")))
        short = held.where(F.col("held") < negatives)
        steps = held if steps is None else steps.where(F.col("held") >= negatives).unionByName(held)
        if short.isEmpty():
            break
        need = rows.join(_by_sorting(short.select("row_id")), "row_id", "left_semi")
    else:
        filled = _filled(rows.join(_by_sorting(short), "row_id"), known, n_items, negatives, seed, unique, sum(rounds))
    drawn = _drawn(rows.join(_by_sorting(steps.select("row_id", "_draws")), "row_id"), known, n_items, seed, unique)
    taken = drawn.withColumn("slot", F.row_number().over(Window.partitionBy("row_id").orderBy("draw"))).where(F.col("slot") <= negatives).select("row_id", "user_idx", "slot", "item_idx")
    negative = (taken if filled is None else taken.unionByName(filled)).withColumn("is_positive", F.lit(False))
    return rows.select("row_id", "user_idx", F.lit(0).alias("slot"), "item_idx", F.lit(True).alias("is_positive")).unionByName(negative)


def _eligible(need: DataFrame, known: DataFrame | None, n_items: int) -> DataFrame:
    """Instead of the positive, item_idx: the items of the catalogue without the user's history and the positive."""
    last, _ = _place(F.lit(n_items - 1))
    blocks = need.withColumnRenamed("item_idx", "_positive").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = _met(blocks, known).where("_mask IS NULL OR _mask <> -1")
    items = blocks.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where("_mask IS NULL OR getbit(_mask, _bit) = 0").withColumn("item_idx", F.shiftleft("_block", 6) + F.col("_bit"))
    return items.where((F.col("item_idx") < n_items) & (F.col("item_idx") != F.col("_positive"))).drop("_positive", "_block", "_mask", "_bit", "_known", "_draws")


def _filled(need: DataFrame, known: DataFrame | None, n_items: int, negatives: int, seed: int, unique: bool, first: int) -> DataFrame:
    """row_id, user_idx, slot, item_idx: what the rows of need lack after `first` draws, of which `held` counted, chosen
    among their eligible items."""
    lacks = F.lit(negatives) - F.col("held")
    if unique:
        taken = _drawn(need.drop("held"), known, n_items, seed, unique).groupBy("row_id").agg(F.collect_list("item_idx").alias("_taken"))
        free = _eligible(need.join(_by_sorting(taken), "row_id", "left"), known, n_items)
        free = free.where(F.col("_taken").isNull() | ~F.array_contains("_taken", F.col("item_idx"))).drop("_taken")
        free = add_key(free, "_key", F.col("row_id"), F.col("item_idx"), ~seed)
        nth = F.row_number().over(Window.partitionBy("row_id").orderBy(unsigned_order(F.col("_key")), "item_idx"))
        chosen = free.withColumn("nth", nth).where(F.col("nth") <= lacks)
    else:
        eligible = _eligible(need, known, n_items).select("row_id", "item_idx")
        numbered = eligible.withColumn("at", F.row_number().over(Window.partitionBy("row_id").orderBy("item_idx")).cast("long") - 1)
        sizes = eligible.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_eligible"))
        more = need.select("row_id", "user_idx", "held").join(_by_sorting(sizes), "row_id").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), lacks)))
        more = add_key(more, "_key", F.col("row_id"), F.col("nth") + F.lit(first - 1), ~seed).withColumn("at", F.shiftrightunsigned("_key", 1) % F.col("n_eligible")).drop("_key", "n_eligible")
        more = checkpointed(more)  # else the join's filter on at would repeat the whole key
        chosen = more.join(_by_sorting(numbered), ["row_id", "at"])
    chosen = checkpointed(chosen.select("row_id", "user_idx", (F.col("held") + F.col("nth")).cast("int").alias("slot"), "item_idx"))
    got = chosen.groupBy("row_id").agg(F.count(F.lit(1)).alias("got"))
    bad = need.select("row_id", "held").join(_by_sorting(got), "row_id", "left").where(F.coalesce("got", F.lit(0)) < lacks)
    if n_bad := bad.count():
        raise ValueError(f"{n_bad} rows have too few eligible items for {negatives} negatives")
    return chosen


def incomplete_rows(candidates: DataFrame, width: int) -> DataFrame:
    """row_id, n of the lists that are not `width` long."""
    return candidates.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != width)
