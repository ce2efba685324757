"""Ranking, metrics and diagnostics against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from listrank.functions.keys import FIRST, GOLDEN, SECOND, add_key, float32_key, unsigned_order
from listrank.operators import diagnostics, metrics, ranking, validate
from listrank.operators.ranking import TiePolicy
from listrank.streaming import metrics as running

SCHEMA = "row_id long, user_idx long, slot int, item_idx long, is_positive boolean, score float"
M = (1 << 64) - 1


def mix(user, item, seed):
    z = seed ^ (user * GOLDEN & M) ^ (item * (GOLDEN >> 1) & M)
    for f in (FIRST, SECOND):
        z = (z ^ z >> 33) * f & M
    return z ^ z >> 33


def table(spark, lists):
    """lists: (user, [(item, score)], positive slot)."""
    return spark.createDataFrame([(r, u, s, i, s == p, float(x)) for r, (u, cs, p) in enumerate(lists) for s, (i, x) in enumerate(cs)], SCHEMA)


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(20)
    return [(1_000 + r, [(i, rng.randint(0, 3)) for i in rng.sample(range(90), 11)], rng.randrange(11)) for r in range(40)]


def test_keys(spark):
    pairs = [(7, 0), (7, 1), (2_073_944, 389_477), (0, 0), (2**40, 2**33)]
    df = add_key(spark.createDataFrame(pairs, "u long, i long"), "k", F.col("u"), F.col("i"), 20_260_316)
    got = {(r["u"], r["i"]): (r["k"] & M, r["f"]) for r in df.withColumn("f", float32_key(F.col("k"))).collect()}
    assert got[7, 0][0] == 10769127858242193862 and got[7, 1][0] == 5477898430460481713 and got[2_073_944, 389_477][0] == 10555714267532676885
    assert all(got[p][0] == mix(*p, 20_260_316) and got[p][1] == pytest.approx(got[p][0] / 2**64, rel=1e-6) for p in pairs)
    ordered = df.orderBy(unsigned_order(F.col("k"))).collect()
    assert [r["k"] & M for r in ordered] == sorted(r["k"] & M for r in ordered) and any(r["k"] < 0 for r in ordered)


def expected_rank(user, cs, p, policy, seed=ranking.KEY_SEED):
    def tie(s, i):
        return {"stable_positive_first": (s,), "hardened_uint64": (mix(user, i, seed), i), "randomized": (mix(user, i, 77), i)}[policy]

    order = sorted(range(len(cs)), key=lambda s: (-cs[s][1], tie(s, cs[s][0])))
    return order.index(p) + 1


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_by_counting_and_by_window(spark, lists, parts):
    df = table(spark, lists).repartition(parts)
    policies = (TiePolicy.STABLE, TiePolicy.FLOAT32, TiePolicy.HARDENED, TiePolicy.RANDOMIZED)
    got = {r["row_id"]: r for r in ranking.positive_ranks(df, policies, random_seed=77).collect()}
    keyed = ranking.with_keys(df, random_seed=77)
    for policy in policies:
        window = {r["row_id"]: r["rank"] for r in ranking.rank_all(keyed, policy).where("is_positive").collect()}
        for r, (u, cs, p) in enumerate(lists):
            assert got[r][str(policy)] == window[r]
            if policy != TiePolicy.FLOAT32:
                assert window[r] == expected_rank(u, cs, p, str(policy))


def test_all_tied_list(spark):
    df = table(spark, [(7, [(i, 0) for i in range(31)], 0)])
    stable = metrics.evaluate(df).where("policy = 'stable_positive_first'").first()
    assert (stable["hit_at_k"], stable["ndcg_at_k"], stable["mrr"]) == (1.0, 1.0, 1.0)
    mean = metrics.expected_metrics(df, 10).first()
    assert mean["hit_at_k"] == pytest.approx(0.3225806452) and mean["ndcg_at_k"] == pytest.approx(0.1465664303)


def test_expectation_by_enumeration(spark):
    scores, k = [1, 3, 2, 1, 1], 4
    got = metrics.expected_metrics(table(spark, [(0, list(enumerate(scores)), 0)]), k).first()
    ranks = [sorted(range(5), key=lambda s: (-scores[s], tie[s])).index(0) + 1 for tie in itertools.permutations(range(5))]
    assert got["ndcg_at_k"] == pytest.approx(sum(1 / math.log2(r + 1) for r in ranks if r <= k) / len(ranks), abs=1e-12)
    assert got["hit_at_k"] == pytest.approx(sum(r <= k for r in ranks) / len(ranks)) and got["mrr"] == pytest.approx(sum(1 / r for r in ranks) / len(ranks))


def test_without_ties_policies_agree(spark):
    df = table(spark, [(u, [(i, i) for i in random.Random(u).sample(range(50), 9)], 2) for u in range(25)])
    rows = metrics.evaluate(df, ks=(3,)).select("hit_at_k", "ndcg_at_k", "mrr").distinct().collect()
    assert len(rows) == 1
    d = diagnostics.tie_diagnostics(df, 3).first()
    assert (d["any_tie_rate"], d["boundary_tie_rate"], d["positive_in_tie_rate"], d["average_max_tie_block"], d["average_positive_tie_size"]) == (0, 0, 0, 1, 0)


def test_permutation(spark, lists):
    out = {r["policy"]: r["changed_rows"] for r in diagnostics.permutation_changes(table(spark, lists), (TiePolicy.STABLE, TiePolicy.HARDENED)).collect()}
    assert out["hardened_uint64"] == 0 and out["stable_positive_first"] > 20


def test_repeated_seeds_and_states(spark, lists):
    df = table(spark, lists)
    per = {r["seed"]: r for r in metrics.repeated_metrics(df, 3, 75, 5).collect()}
    want = [expected_rank(u, cs, p, "randomized") for u, cs, p in lists]
    assert per[77]["mrr"] == pytest.approx(sum(1 / r for r in want) / len(want)) and per[77]["hit_at_k"] == pytest.approx(sum(r <= 5 for r in want) / len(want))
    summary = {r["metric"]: r for r in metrics.summarize(metrics.repeated_metrics(df, 1, 77, 5)).collect()}
    assert summary["mrr"]["sd"] == 0 and summary["mrr"]["min"] == summary["mrr"]["max"]
    parts = running.state(df.where("row_id < 9")).unionByName(running.state(df.where("row_id >= 9")))
    merged, whole = ({r["policy"]: r["ndcg_at_k"] for r in x.collect()} for x in (running.merge(parts), metrics.evaluate(df)))
    assert merged == pytest.approx(whole)


def test_stream(spark, lists, tmp_path):
    df = table(spark, lists)
    df.where("row_id < 20").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.where("row_id >= 20").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    running.evaluate_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r["policy"]: r["mrr"] for r in running.merge(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == pytest.approx({r["policy"]: r["mrr"] for r in metrics.evaluate(df).collect()})


def test_diagnostics_of_duplicates(spark):
    df = table(spark, [(8, [(0, 0), (4, 0), (4, 0), (2, 0), (3, 0)], 0)])
    d = diagnostics.tie_diagnostics(df, 3).first()
    assert (d["any_tie_rate"], d["boundary_tie_rate"], d["median_max_tie_block"], d["average_positive_tie_size"]) == (1, 1, 5, 5)
    assert diagnostics.collision_audit(df).first()["duplicate_identity_rows"] == 1
    diff = diagnostics.policy_difference(df, TiePolicy.HARDENED, TiePolicy.HARDENED, 3).first()
    assert diff["topk_item_set_change_rate"] == 0 and diff["mean_absolute_positive_rank_change"] == 0


def test_validation(spark):
    good = table(spark, [(1, [(1, 1), (2, 2), (2, 2)], 0)])
    validate.require(good, 3)
    with pytest.raises(ValueError):
        validate.require(good, 3, diagnostics=True)
    for bad in (table(spark, [(1, [(1, 1), (1, 2), (2, 3)], 0)]), table(spark, [(1, [(1, float("nan")), (2, 2)], 0)]), table(spark, [(1, [(1, 1), (2, 2)], 5)]), table(spark, [(1, [(1, 1)], 0), (2, [(1, 1), (2, 1)], 0)])):
        with pytest.raises(ValueError):
            validate.require(bad, 1)


def test_violations_do_not_depend_on_row_order(spark):
    """Of two positives, 5 and 9, the larger is the one that may not repeat; 5 repeats in list 0, 9 in list 1."""
    rows = [(r, 0, s, i, s < 2, 1.0) for r, other in enumerate((5, 9)) for s, i in enumerate((5, 9, other, 7))]
    for arrived in (rows, rows[::-1]):
        v = validate.violations(spark.createDataFrame(arrived, SCHEMA).coalesce(1)).first()
        assert (v["not_one_positive"], v["positive_repeats"]) == (2, 1)
    first = [x for x in rows if x[0] == 0]
    assert {validate.violations(spark.createDataFrame(x, SCHEMA).coalesce(1)).first()["positive_repeats"] for x in (first, first[::-1])} == {0}


BROKEN = {
    "no positive": [(0, [(1, 1), (2, 2), (3, 0)], 9)], "none at all": [], "positive twice": [(0, [(1, 1), (1, 2), (2, 3)], 0)],
    "nan": [(0, [(1, 1), (2, float("nan")), (3, 0)], 0)], "infinite": [(0, [(1, 1), (2, float("inf")), (3, 0)], 0)], "too narrow": [(0, [(1, 1)], 0)],
}
EVALUATORS = {
    "evaluate": lambda df: metrics.evaluate(df, ks=(2,)), "expected": lambda df: metrics.expected_metrics(df, 2), "repeated": lambda df: metrics.repeated_metrics(df, 2, 1, 2),
    "ties": lambda df: diagnostics.tie_diagnostics(df, 2), "difference": lambda df: diagnostics.policy_difference(df, TiePolicy.STABLE, TiePolicy.HARDENED, 2),
    "audit": lambda df: diagnostics.contract_audit(df, 2), "state": lambda df: running.state(df, k=2),
}


@pytest.mark.parametrize("name", EVALUATORS)
def test_evaluators_refuse_what_they_cannot_evaluate(spark, lists, name):
    """A good list stands beside each broken one."""
    good, run = [(5, [(7, 1), (8, 2), (9, 3)], 0)], EVALUATORS[name]
    assert run(table(spark, good)).collect()
    for fault, broken in BROKEN.items():
        if fault == "none at all":
            continue
        with pytest.raises(Exception, match="list 1"):
            run(table(spark, good + broken)).collect()
    two = table(spark, good + [(0, [(1, 1), (2, 2), (3, 0)], 0)]).withColumn("is_positive", F.col("is_positive") | ((F.col("row_id") == 1) & (F.col("slot") == 2)))
    with pytest.raises(Exception, match="2 positives"):
        run(two).collect()
    null = table(spark, good + [(0, [(1, 1), (2, 2), (3, 0)], 0)]).withColumn("score", F.when((F.col("row_id") == 0) | (F.col("slot") < 2), F.col("score")))
    with pytest.raises(Exception, match="null, NaN or infinite"):
        run(null).collect()
    if name not in ("repeated", "state"):
        with pytest.raises(Exception, match="at least one list"):
            run(table(spark, good).where("false")).collect()


def test_bad_cutoffs_raise(spark):
    df = table(spark, [(5, [(7, 1), (8, 2), (9, 3)], 0)])
    for ks in ((), (0,), (2, -1)):
        with pytest.raises(ValueError):
            metrics.evaluate(df, ks=ks)
    for run in (metrics.expected_metrics, diagnostics.tie_diagnostics, diagnostics.contract_audit):
        with pytest.raises(ValueError):
            run(df, 0)
    with pytest.raises(Exception, match="k = 4"):
        metrics.evaluate(df, ks=(1, 4)).collect()


def test_contract_audit_by_brute_force(spark):
    """Few distinct scores, and float keys forced to be equal, so that both kinds of key differ."""
    rng = random.Random(31)
    lists = [(1_000 + r, [(rng.randrange(40), rng.randint(0, 2)) for _ in range(11)], 0) for r in range(60)]
    lists = [(u, [(100, cs[0][1]), *cs[1:]], 0) for u, cs, _ in lists]
    keyed = {(u, i): mix(u, i, ranking.KEY_SEED) for u, cs, _ in lists for i, _ in cs}
    got = diagnostics.contract_audit(table(spark, lists), 4).first()
    blocks = [sum(s == cs[0][1] for _, s in cs) for _, cs, _ in lists]
    orders = [[sorted(range(11), key=lambda s: (-cs[s][1], keyed[u, cs[s][0]], cs[s][0], s * way)) for way in (1, -1)] for u, cs, _ in lists]
    assert all([cs[s][0] for s in a] == [cs[s][0] for s in b] for (a, b), (_, cs, _) in zip(orders, lists, strict=True)) and got["hardened_order_dependent_rows"] == 0
    assert got["n_rows"] == 60 and got["max_block"] == max(blocks) and got["mean_block_all_rows"] == pytest.approx(sum(blocks) / 60)
    assert got["duplicate_identity_rows"] == sum(len({i for i, _ in cs}) < 11 for _, cs, _ in lists) and got["positive_in_tie_rows"] == sum(b > 1 for b in blocks)
    sorted_scores = [sorted((s for _, s in cs), reverse=True) for _, cs, _ in lists]
    assert got["boundary_tie_rows"] == sum(s[3] == s[4] for s in sorted_scores)
    assert got["float_key_rows"] == got["archived_order_dependent_rows"] == got["order_difference_rows"] == 0
