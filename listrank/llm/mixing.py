"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join, uniform, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: The mix has this share of all words, and no source more than this many times its own.
SHARE, CEILING = 1.5, 2.0
#: Documents that meet in one node of the reduction tree, on average.
FAN_IN = 256
#: Sources up to which their table of targets is broadcast; beyond, rows of a source meet copies of its target.
BROADCAST_SOURCES = 50_000
SEED = 20_240_601


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """One row per source of sizes(source, size): source_size, n (rows), target. Weights repeat over the sources by code
    point, null last. What a source can't take beyond its ceiling is shared again by weight, until none is above: rounds
    of one aggregate each, few since the level rises as in Newton's method on a concave sum. If all reach their ceiling,
    the rest is shared with none.

    Sources are numbered by ranges and the ranges' sizes, so that no task holds all of them; the driver sees a count a
    range and a sum a weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = F.col("source").asc_nulls_last()
    dealt = cut(per.repartitionByRange(by_name).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    before = list(accumulate((counts.get(p, 0) for p in range(max(counts, default=0))), initial=0))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1 + F.get(F.lit(before), F.col("part"))
    per = dealt.withColumn("turn", nth % len(weights))
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("turn"))).withColumn("most", F.col("source_size") * F.lit(float(ceiling)))
    per = cut(per.drop("part"))
    level, full, known = 0.0, F.lit(False), None
    while True:
        sums = per.groupBy("turn", full.alias("full")).agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("size")).collect()
        n_full = sum(r["n"] for r in sums if r["full"])
        open_weight = sum(weights[r["turn"]] * r["n"] for r in sorted(sums) if not r["full"])
        if n_full == known or open_weight <= 0:
            break
        known = n_full
        level = (share * sum(r["size"] for r in sums) - ceiling * sum(r["size"] for r in sums if r["full"])) / open_weight
        full = F.col("most") <= F.lit(level) * F.col("weight")
    return per.select("source", "source_size", "n", F.when(full, F.col("most")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _pivot(items: Column) -> Column:
    """Runs the pivotal method along an array of struct(d, p, u): struct(cur: what is still fractional, out: what became
    integral). Of each pair, one document becomes 0 or 1 and the other keeps the rest of the pair's mass."""

    def step(acc: Column, x: Column) -> Column:
        mass = acc["cur"]["p"] + x["p"]
        low = mass < 1
        x_goes_on = x["u"] < F.when(low, x["p"] / F.greatest(mass, F.lit(1e-300))).otherwise((1 - x["p"]) / F.greatest(2 - mass, F.lit(1e-300)))
        done = F.struct(F.when(x_goes_on, acc["cur"]["d"]).otherwise(x["d"]).alias("d"), F.when(low, 0).otherwise(1).alias("take"))
        rest = F.struct(F.when(x_goes_on, x["d"]).otherwise(acc["cur"]["d"]).alias("d"), F.when(low, mass).otherwise(mass - 1).alias("p"))
        return F.struct(rest.alias("cur"), F.concat(acc["out"], F.array(done)).alias("out"))

    first = F.element_at(items, 1)
    none = F.filter(F.array(F.struct(first["d"].alias("d"), F.lit(0).alias("take"))), lambda _: F.lit(False))
    start = F.struct(F.struct(first["d"].alias("d"), first["p"].alias("p")).alias("cur"), none.alias("out"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1))), start, step)


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, fan_in: int = FAN_IN, seed: int = SEED, id_column: str = "doc_id") -> DataFrame:
    """How often the mix takes each distinct (source, id, size): source, id, size, m (rows that are alike), copies (of
    all m together), source_size, target.

    A row's expected copies are target / source_size. The whole part is granted; the fractions are rounded by the
    pivotal method, neighbours in size paired. The rounding is a reduction tree: rows are dealt by hash to nodes of
    about fan_in rows of a source, each node leaves one fractional row, and these are dealt to nodes again until one is
    left per source, which a draw decides. So a source of any size is spread over many tasks, its copies are within one
    of their expectation, and its words near the target. Draws are hashes of the ids, so reruns agree whatever the
    partitioning. Rows that are alike are counted, never compared. Null text has size 0; a null source or id is a value
    like any other; an empty table gives an empty plan."""
    sizes = docs.select("source", F.col(id_column).alias("id"), word_count(F.col("text")).alias("size"))
    alike = cut(sizes.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("m")))
    targets = cut(source_targets(alike.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, ceiling))
    largest = targets.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).otherwise(F.lit(0.0))
    named = targets.withColumnRenamed("source", "_source")
    rows = spread_join(alike, named, [("source", "_source")], "inner", BROADCAST_SOURCES).withColumn("mass", F.col("m") * rate)
    rows = rows.withColumn("sure", F.floor(F.col("mass") + 1e-9)).withColumn("p", F.greatest(F.col("mass") - F.col("sure"), F.lit(0.0)))
    rows = rows.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    payload = F.struct("source", "id", "size", "m", "sure", "source_size", "target")
    rows = rows.select(payload.alias("d"), "p", "n")
    decided = [rows.where("p = 0").select("d", F.lit(0).alias("take"))]
    open_rows, span, level = rows.where("p > 0"), fan_in, 0
    while True:
        chunks = F.ceil(F.col("n") / F.lit(span))
        draw = F.xxhash64(F.lit(seed + level), F.col("d.id"), F.col("d.size"))
        item = F.struct(F.col("d.size").alias("size"), draw.alias("tie"), F.col("d.id").alias("id"), F.col("d").alias("d"), F.col("p").alias("p"), uniform(F.lit(~seed - level), F.col("d.id"), F.col("d.size")).alias("u"))
        dealt = open_rows.select(F.col("d.source").alias("source"), F.pmod(draw, chunks).alias("chunk"), item.alias("item"), "n")
        nodes = dealt.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("item")).alias("items"), F.max("n").alias("n"))
        nodes = cut(nodes.select("n", _pivot(F.col("items")).alias("acc")))
        decided.append(nodes.select(F.inline("acc.out")))
        if span >= largest:
            final = uniform(F.lit(seed), F.lit("last"), F.col("acc.cur.d.id"), F.col("acc.cur.d.size")) < F.col("acc.cur.p")
            decided.append(nodes.select("acc.cur.d", final.cast("int").alias("take")))
            break
        open_rows, span, level = nodes.select("acc.cur.d", "acc.cur.p", "n"), span * fan_in, level + 1
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select(F.col("d.source"), F.col("d.id"), F.col("d.size"), F.col("d.m"), (F.col("d.sure") + F.col("take")).alias("copies"), F.col("d.source_size"), F.col("d.target"))


def row_copies(copies: Column, m: Column, nth: Column) -> Column:
    """The share of the nth (from 0) of m rows that are alike."""
    return F.floor(copies / m) + F.when(nth < copies % m, 1).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: each row of docs as often as the plan takes it, in docs' own columns."""
    plan = plan_mix(docs, **options).select(F.col("source").alias("_s"), F.col("id").alias("_i"), F.col("size").alias("_z"), F.col("m").alias("_m"), F.col("copies").alias("_c")).where("_c > 0")
    # the rows travel as structs, so that no column of docs can clash with the join's own
    key = options.get("id_column", "doc_id")
    sized = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
    both = sized.join(plan, F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    # rows of one id, source and size take turns by a hash of all they hold, so that reruns agree on which one is taken
    alike = Window.partitionBy("_i", "_s", "_z").orderBy(F.when(F.col("_m") > 1, F.xxhash64(F.to_json("row"))))
    nth = F.when(F.col("_m") > 1, F.row_number().over(alike) - 1).otherwise(0)
    times = row_copies(F.col("_c"), F.col("_m"), nth).cast("int")
    return both.withColumn("times", times).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
