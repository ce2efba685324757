"""Registered queries of the engine, each with DuckDB SQL for an independent answer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listrank.functions import text
from listrank.functions.keys import GOLDEN, FIRST, SECOND
from listrank.operators import diagnostics, groups, metrics, prep, propensity, ranking, report, sampling, scores, search, validate
from listrank.operators.ranking import KEY_SEED, TiePolicy
from listrank.sources import tables
from listrank.streaming import metrics as running

from . import experiments
from . import testdata as td

SEEDS, SEED_START, K, SMOOTHING, FOLDS = 20, 20_270_000, 10, 5.0, 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_TWO64 = "18446744073709551616"
_ROUNDS = sampling.ROUNDS


def _mul(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT * {b}::UHUGEINT) % {_TWO64}::UHUGEINT)::UBIGINT"


def _keys(name: str, source: str, user: str, item: str, seed: str) -> str:
    """CTEs that add the unsigned key z to a source."""
    return f"""{name}0 AS (SELECT *, xor(xor(({seed})::UBIGINT, {_mul(f"({user})::UBIGINT", GOLDEN)}), {_mul(f"({item})::UBIGINT", GOLDEN >> 1)}) AS z FROM {source}),
{name}1 AS (SELECT * REPLACE ({_mul("xor(z, z >> 33)", FIRST)} AS z) FROM {name}0),
{name}2 AS (SELECT * REPLACE ({_mul("xor(z, z >> 33)", SECOND)} AS z) FROM {name}1),
{name} AS (SELECT * REPLACE (xor(z, z >> 33) AS z) FROM {name}2)"""


_LAST = ", ".join(f"{c} DESC" for c in td.ORDER)
_CANDS = """{0} AS (SELECT user_idx AS row_id, user_idx, 0 AS slot, item_idx, true AS is_positive FROM test
  UNION ALL SELECT row_id, row_id, slot::INTEGER, item, false FROM (SELECT row_id, item, row_number() OVER (PARTITION BY row_id ORDER BY d) AS slot FROM {1}) WHERE slot <= 30)"""
_TYPES = 6
_BASE = f"""WITH inter AS (SELECT o_custkey AS user_id, l_partkey AS item_id, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS ts, (1 + floor((l_quantity - 1) / 10))::DOUBLE AS rating, {", ".join(td.ORDER)}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
dedup AS (SELECT user_id, item_id, ts, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, ts ORDER BY {_LAST}) AS rn FROM inter) WHERE rn = 1),
users AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM dedup)),
items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM dedup)),
mapped AS (SELECT user_idx, item_idx, user_id, item_id, ts, rating, greatest(0, least(1, (rating - 1) / 4))::FLOAT AS y FROM dedup JOIN users USING (user_id) JOIN items USING (item_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY ts, item_idx) AS within_user_rank, count(*) OVER (PARTITION BY user_idx) AS within_user_count FROM mapped),
split AS (SELECT *, CASE within_user_count - within_user_rank WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM placed),
train AS (SELECT * FROM split WHERE split = 'train'), test AS (SELECT * FROM split WHERE split = 'test'),
hist AS (SELECT DISTINCT user_idx, item_idx FROM split WHERE split <> 'test'),
parts AS (SELECT item_idx, p_brand, p_type, p_size, p_retailprice, dense_rank() OVER (ORDER BY p_type) - 1 AS t FROM items JOIN part ON p_partkey = item_id),
vecs AS (SELECT item_idx, {", ".join(f"(t = {i})::INTEGER AS a{i}" for i in range(_TYPES))} FROM parts),
means AS (SELECT {", ".join(f"avg(a{i}) AS m{i}" for i in range(_TYPES))} FROM vecs),
raws AS (SELECT user_idx, {", ".join(f"sum(y * a{i}) AS w{i}" for i in range(_TYPES))}, sum(y) AS w FROM train JOIN vecs USING (item_idx) GROUP BY user_idx),
pop AS (SELECT item_idx, coalesce(n, 0)::FLOAT AS popularity FROM items LEFT JOIN (SELECT item_idx, count(*) AS n FROM train GROUP BY item_idx) USING (item_idx)),
draws AS (SELECT user_idx AS row_id, item_idx AS pos, unnest(range(0, 200)) AS d FROM test),
{_keys("dk", "draws", "row_id", "d", str(td.SAMPLE_SEED))},
drawn AS (SELECT row_id, d, item FROM (SELECT row_id, pos, d, ((z >> 1) % (SELECT count(*) FROM items))::BIGINT AS item FROM dk) x WHERE item <> pos AND NOT EXISTS (SELECT 1 FROM hist WHERE hist.user_idx = x.row_id AND hist.item_idx = x.item)),
drawn1 AS (SELECT row_id, item, min(d) AS d FROM drawn GROUP BY row_id, item),
{_CANDS.format("cands", "drawn")}, {_CANDS.format("cands1", "drawn1")},
popular AS (SELECT cands.*, popularity AS score FROM cands JOIN pop USING (item_idx)),
rawcount AS (SELECT cands.*, ({" + ".join(f"coalesce(w{i}::FLOAT::DOUBLE, 0) * a{i}" for i in range(_TYPES))})::FLOAT AS score FROM cands JOIN vecs USING (item_idx) LEFT JOIN raws USING (user_idx)),
{_keys("scored", "popular", "user_idx", "item_idx", str(KEY_SEED))}, {_keys("rawkeyed", "rawcount", "user_idx", "item_idx", str(KEY_SEED))}"""

_ORDERS = {
    "stable_positive_first": "slot", "archived_float32": f"(z::DOUBLE / {_TWO64}.0)::FLOAT, slot", "hardened_uint64": "z, item_idx, slot",
}


def _ranked(source: str) -> str:
    return f"ranked_{source} AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY row_id ORDER BY score DESC, {o}) AS {p}" for p, o in _ORDERS.items()) + f" FROM {source})"


def _metric_columns(rank: str, k: int | str = K) -> str:
    return f"count(*) AS n_rows, round(avg(CASE WHEN {rank} <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_k, round(avg(CASE WHEN {rank} <= {k} THEN 1.0::DOUBLE / log2({rank} + 1) ELSE 0 END), 6) AS ndcg_at_k, round(avg(1.0::DOUBLE / {rank}), 6) AS mrr"


def _by_policy(source: str, k: int | str = K) -> str:
    return " UNION ALL ".join(f"SELECT '{p}' AS policy, {k}::INTEGER AS k, {_metric_columns(p, k)} FROM ranked_{source} WHERE is_positive" for p in _ORDERS)


def query(sql: str | None = None, base: bool = True, extra: str = ""):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{_BASE}{', ' + extra if extra else ''} {sql}" if base else sql
        return f

    return register


def _rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """nudge moves values off decimal ties, which the order of a sum would else decide."""
    return df.select(*[F.round(F.col(c).cast("double") + nudge, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


# preparation


@query("SELECT user_id, item_id, ts, rating FROM dedup")
def dedupe_last_wins(spark, sf):
    return td.deduplicated(spark, sf)


def _core_rounds(n: int) -> str:
    out, now = [], "dedup"
    for i in range(1, n + 1):
        out.append(f"u{i} AS (SELECT * FROM {now} WHERE user_id IN (SELECT user_id FROM {now} GROUP BY user_id HAVING count(*) >= 20)), c{i} AS (SELECT * FROM u{i} WHERE item_id IN (SELECT item_id FROM u{i} GROUP BY item_id HAVING count(*) >= 20))")
        now = f"c{i}"
    return ", ".join(out)


@query("SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS items, sum(rating)::DOUBLE AS rating FROM c5 GROUP BY user_id", extra=_core_rounds(5))
def kcore_20(spark, sf):
    core, _ = prep.k_core(td.deduplicated(spark, sf), 20, 20)
    return core.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.sum("rating").alias("rating"))


@query(
    "SELECT turn, rows_before, rows_after FROM (SELECT *, min(CASE WHEN rows_before = rows_after THEN turn END) OVER () AS last FROM ("
    + " UNION ALL ".join(f"SELECT {i}::INTEGER AS turn, (SELECT count(*) FROM {'dedup' if i == 1 else f'c{i - 1}'}) AS rows_before, (SELECT count(*) FROM c{i}) AS rows_after" for i in range(1, 6))
    + ")) WHERE turn <= coalesce(last, 5)",
    extra=_core_rounds(5),
)
def kcore_history(spark, sf):
    _, history = prep.k_core(td.deduplicated(spark, sf), 20, 20)
    return spark.createDataFrame(history, "turn int, rows_before long, rows_after long")


@query("SELECT user_id, user_idx FROM users")
def dense_user_ids(spark, sf):
    return prep.dense_ids(td.interactions(spark, sf), "user_id", "user_idx")


@query("SELECT item_id, row_number() OVER (ORDER BY f) - 1 AS item_idx FROM (SELECT item_id, min((ts, user_id)) AS f FROM dedup GROUP BY item_id)".replace("ORDER BY f)", "ORDER BY f, item_id)"))
def first_appearance_ids(spark, sf):
    return prep.first_appearance_ids(td.deduplicated(spark, sf), "item_id", [F.col("ts"), F.col("user_id"), F.col("item_id")], "item_idx")


@query("SELECT user_idx, item_idx, ts, within_user_rank, within_user_count, split FROM split")
def leave_last_two_split(spark, sf):
    return td.split(spark, sf).select("user_idx", "item_idx", "ts", "within_user_rank", "within_user_count", "split")


@query(
    "SELECT event_id, position, CASE WHEN position < floor(n * 0.8) THEN 'train' WHEN position < floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, count(*) OVER () AS n FROM events)",
    base=False,
)
def global_time_split(spark, sf):
    rows = td.table(spark, sf, "events").select("event_id", "ts")
    return prep.global_time_split(rows, F.col("ts"), F.col("event_id")).select("event_id", "position", "split")


@query("SELECT split, count(*) AS n, count(DISTINCT user_idx) AS users, count(DISTINCT item_idx) AS items FROM split GROUP BY split")
def split_counts(spark, sf):
    return td.split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_idx").alias("users"), F.countDistinct("item_idx").alias("items"))


@query("SELECT item_id, count(*) AS interaction_count, count(DISTINCT user_id) AS user_count, round(avg(rating), 6) AS mean_review_rating, max(ts) AS latest_timestamp FROM dedup GROUP BY item_id")
def item_stats(spark, sf):
    return _rounded(prep.item_statistics(td.deduplicated(spark, sf)))


@query("SELECT i.item_id, item_idx, p_brand, interaction_count, price_bucket FROM items i JOIN (SELECT item_id, count(*) AS interaction_count FROM dedup GROUP BY item_id) USING (item_id) JOIN (SELECT p_partkey, p_brand, CASE " + " ".join(f"WHEN p_size * 2.5 <= {b} THEN 'price::<={b}'" for b in text.PRICE_BOUNDS) + " ELSE 'price::>100' END AS price_bucket FROM part) ON p_partkey = i.item_id")
def item_export(spark, sf):
    rows = tables.checkpointed(td.deduplicated(spark, sf))
    stats = prep.item_statistics(rows).select("item_id", "interaction_count")
    parts = td.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_brand", text.price_bucket(F.col("p_size") * 2.5).alias("price_bucket"))
    return prep.dense_ids(rows, "item_id", "item_idx").join(stats, "item_id").join(parts, "item_id")


@query("SELECT rating, y::DOUBLE AS y, count(*) AS n FROM mapped GROUP BY rating, y")
def scaled_rating(spark, sf):
    return td.deduplicated(spark, sf).withColumn("y", text.scaled_rating(F.col("rating")).cast("double")).groupBy("rating", "y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE rating >= 4) AS positive FROM dedup WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def known_items_filter(spark, sf):
    small = td.table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("item_id"))
    return prep.known_items(td.deduplicated(spark, sf), small).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating") >= 4).alias("positive"))


# scores


@query("SELECT item_idx, popularity::DOUBLE AS popularity FROM pop")
def popularity(spark, sf):
    rows = td.split(spark, sf)
    return _rounded(scores.popularity(rows.where("split = 'train'"), rows.select("item_idx").distinct()))


def _profile(spark, sf, centered: bool):
    rows = td.split(spark, sf)
    items, attrs = td.items_with_types(rows, spark, sf)
    make = scores.centered_profiles if centered else scores.user_profiles
    return _rounded(make(rows.where("split = 'train'"), items, attrs, F.col("y")), 4)


@query(f"SELECT user_idx, {', '.join(f'round(w{i}::FLOAT::DOUBLE, 4) AS a{i}' for i in range(_TYPES))} FROM raws")
def user_raw_profile(spark, sf):
    return _profile(spark, sf, False)


@query(f"SELECT user_idx, {', '.join(f'round((w{i} - m{i} * w)::FLOAT::DOUBLE, 4) AS a{i}' for i in range(_TYPES))} FROM raws, means")
def user_centered_profile(spark, sf):
    return _profile(spark, sf, True)


@query(f"SELECT {', '.join(f'round(m{i}, 6) AS a{i}' for i in range(_TYPES))} FROM means")
def attr_means(spark, sf):
    rows = td.mapped(spark, sf)
    items, attrs = td.items_with_types(rows, spark, sf)
    means = scores.attribute_means(items, attrs)
    return _rounded(spark.createDataFrame([tuple(means.values())], ", ".join(f"{a} double" for a in attrs)))


@query("SELECT row_id, slot, item_idx, score::DOUBLE AS score FROM rawcount")
def candidate_scores(spark, sf):
    return _rounded(td.scored(spark, sf, "raw_count").select("row_id", "slot", "item_idx", "score"))


# keys and candidates


@query("SELECT l_orderkey, l_partkey, CASE WHEN z > 9223372036854775807 THEN (z::HUGEINT - 18446744073709551616)::BIGINT ELSE z::BIGINT END AS key FROM k", base=False)
def u64_keys(spark, sf):
    from listrank.functions.keys import add_key

    pairs = td.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return add_key(pairs, "key", F.col("l_orderkey"), F.col("l_partkey"), KEY_SEED)


_PAIRS = f"WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), {_keys('k', 'p', 'l_orderkey', 'l_partkey', str(KEY_SEED))} "
SQL["u64_keys"] = _PAIRS + SQL["u64_keys"]


@query(f"SELECT l_orderkey, l_partkey, (z::DOUBLE / {_TWO64}.0)::FLOAT::DOUBLE AS key32 FROM k", base=False)
def f32_keys(spark, sf):
    from listrank.functions.keys import float32_key

    return u64_keys(spark, sf).select("l_orderkey", "l_partkey", float32_key(F.col("key")).cast("double").alias("key32"))


SQL["f32_keys"] = _PAIRS + SQL["f32_keys"]


@query("SELECT row_id, slot, item_idx, is_positive FROM cands")
def candidates_rejection(spark, sf):
    return td.candidates(td.split(spark, sf)).select("row_id", "slot", "item_idx", "is_positive")


@query("SELECT row_id, slot, item_idx, is_positive FROM cands1")
def candidates_unique(spark, sf):
    return td.candidates(td.split(spark, sf), unique=True).select("row_id", "slot", "item_idx", "is_positive")


def _violations(source: str) -> str:
    return f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE pos <> 1) AS not_one_positive, count(*) FILTER (WHERE twice > 0) AS positive_repeats, max(width) - min(width) AS width_spread, min(width) AS width, sum(bad)::BIGINT AS bad_scores
FROM (SELECT row_id, count(*) FILTER (WHERE is_positive) AS pos, count(*) AS width, count(*) FILTER (WHERE score IS NULL OR isnan(score) OR isinf(score)) AS bad, count(*) FILTER (WHERE NOT is_positive AND item_idx = p) AS twice
  FROM (SELECT *, max(CASE WHEN is_positive THEN item_idx END) OVER (PARTITION BY row_id) AS p FROM {source}) GROUP BY row_id)"""


@query(_violations("popular"))
def validate_lists(spark, sf):
    return validate.violations(td.scored(spark, sf))


_BROKEN = """broken AS (SELECT row_id, slot, CASE WHEN row_id % 7 = 3 AND slot = 2 THEN max(CASE WHEN is_positive THEN item_idx END) OVER (PARTITION BY row_id) ELSE item_idx END AS item_idx,
  CASE WHEN row_id % 7 = 1 THEN false WHEN row_id % 7 = 2 AND slot = 1 THEN true ELSE is_positive END AS is_positive,
  CASE WHEN row_id % 7 = 4 AND slot = 3 THEN 'nan'::FLOAT WHEN row_id % 7 = 4 AND slot = 5 THEN 'infinity'::FLOAT WHEN row_id % 7 = 6 AND slot = 4 THEN NULL ELSE score END AS score
  FROM popular WHERE NOT (row_id % 7 = 5 AND slot = 30))"""


@query(_violations("broken"), extra=_BROKEN)
def invalid_lists(spark, sf):
    """Lists broken on purpose: without and with two positives, the positive's item repeated, bad scores, one too short."""
    lists = td.scored(spark, sf)
    kind, slot = F.col("row_id") % 7, F.col("slot")
    positive = lists.where("is_positive").select(F.col("row_id").alias("_r"), F.col("item_idx").alias("_p"))
    lists = lists.join(positive, F.col("row_id") == F.col("_r")).where(~((kind == 5) & (slot == 30)))
    score = F.when((kind == 4) & (slot == 3), float("nan")).when((kind == 4) & (slot == 5), float("inf")).when((kind == 6) & (slot == 4), None).otherwise(F.col("score"))
    mark = F.when(kind == 1, False).when((kind == 2) & (slot == 1), True).otherwise(F.col("is_positive"))
    lists = lists.select("row_id", "user_idx", "slot", F.when((kind == 3) & (slot == 2), F.col("_p")).otherwise(F.col("item_idx")).alias("item_idx"), mark.alias("is_positive"), score.cast("float").alias("score"))
    return validate.violations(lists)


#: A catalogue of 400 items of which a user has not seen 40, so that draws alone leave most rows short.
_NARROW, _OPEN = 400, 10


def _narrow(unique: bool) -> str:
    keep = "SELECT row_id, item, min(d) AS d FROM nfound GROUP BY row_id, item" if unique else "SELECT row_id, item, d FROM nfound"
    fill = (
        f"""nfree AS (SELECT row_id, item FROM nopen ANTI JOIN nfirst USING (row_id, item)), {_keys("nk", "nfree", "row_id", "item", str((~td.SAMPLE_SEED) % (1 << 64)))},
nmore AS (SELECT row_id, item, {sum(_ROUNDS)} - 1 + row_number() OVER (PARTITION BY row_id ORDER BY z, item) AS d FROM nk)"""
        if unique
        else f"""nlack AS (SELECT row_id, 30 - coalesce(n, 0) AS lacks FROM nt LEFT JOIN (SELECT row_id, count(*) AS n FROM nfirst GROUP BY row_id) USING (row_id)),
ndraw AS (SELECT row_id, unnest(range({sum(_ROUNDS)}, {sum(_ROUNDS)} + lacks)) AS d FROM nlack WHERE lacks > 0), {_keys("nk", "ndraw", "row_id", "d", str((~td.SAMPLE_SEED) % (1 << 64)))},
nsize AS (SELECT row_id, count(*) AS n FROM nopen GROUP BY row_id), nnum AS (SELECT row_id, item, row_number() OVER (PARTITION BY row_id ORDER BY item) - 1 AS nth FROM nopen),
nmore AS (SELECT k.row_id, item, d FROM (SELECT row_id, d, ((z >> 1) % n)::BIGINT AS nth FROM nk JOIN nsize USING (row_id)) k JOIN nnum ON nnum.row_id = k.row_id AND nnum.nth = k.nth)"""
    )
    return f"""WITH nt AS (SELECT c_custkey AS row_id, c_custkey % {_NARROW} AS pos FROM customer),
nopen AS (SELECT row_id, item FROM (SELECT row_id, pos, unnest(range({_NARROW})) AS item FROM nt) WHERE (item + row_id) % {_OPEN} = 0 AND item <> pos),
nd AS (SELECT row_id, pos, unnest(range({sum(_ROUNDS)})) AS d FROM nt), {_keys("nz", "nd", "row_id", "d", str(td.SAMPLE_SEED))},
nfound AS (SELECT x.row_id, x.item, x.d FROM (SELECT row_id, d, ((z >> 1) % {_NARROW})::BIGINT AS item FROM nz) x JOIN nopen o ON o.row_id = x.row_id AND o.item = x.item),
nall AS ({keep}), nfirst AS (SELECT row_id, item, d FROM nall QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d) <= 30),
{fill}, nboth AS (SELECT * FROM nfirst UNION ALL SELECT row_id, item, d FROM nmore)
SELECT row_id, 0 AS slot, pos AS item_idx FROM nt UNION ALL SELECT row_id, slot::INTEGER, item FROM (SELECT row_id, item, row_number() OVER (PARTITION BY row_id ORDER BY d) AS slot FROM nboth) WHERE slot <= 30"""


def _narrow_candidates(spark, sf, unique: bool):
    users = td.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("user_idx"), (F.col("c_custkey") % _NARROW).alias("item_idx"))
    seen = users.select("user_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_NARROW - 1).cast("long"))).alias("item_idx")).where((F.col("item_idx") + F.col("user_idx")) % _OPEN != 0)
    return sampling.sample_candidates(users, seen, _NARROW, td.NEGATIVES, td.SAMPLE_SEED, unique).select("row_id", "slot", "item_idx")


@query(_narrow(False), base=False)
def candidates_nearly_full_history(spark, sf):
    return _narrow_candidates(spark, sf, False)


@query(_narrow(True), base=False)
def candidates_unique_nearly_full_history(spark, sf):
    return _narrow_candidates(spark, sf, True)


# ranking


def _rank(policy: TiePolicy):
    def run(spark, sf):
        keyed = ranking.with_keys(td.scored(spark, sf), KEY_SEED)
        return ranking.rank_all(keyed, policy).select("row_id", "slot", "item_idx", F.col("rank").cast("long").alias("rank"))

    return run


for _name, _policy in (("rank_stable", TiePolicy.STABLE), ("rank_float32", TiePolicy.FLOAT32), ("rank_hardened", TiePolicy.HARDENED)):
    QUERIES[_name] = _rank(_policy)
    SQL[_name] = f"{_BASE}, {_ranked('scored')} SELECT row_id, slot, item_idx, {_policy} AS rank FROM ranked_scored"


@query("SELECT row_id, rank FROM (SELECT row_id, is_positive, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, z, item_idx, slot) AS rank FROM r) WHERE is_positive", extra=_keys("r", "popular", "user_idx", "item_idx", str(SEED_START)))
def rank_randomized_seed(spark, sf):
    ranks = ranking.positive_ranks(td.scored(spark, sf), (TiePolicy.RANDOMIZED,), KEY_SEED, SEED_START)
    return ranks.select("row_id", F.col("randomized").cast("long").alias("rank"))


# metrics


@query(_by_policy("scored"), extra=_ranked("scored"))
def metrics_by_policy(spark, sf):
    return _rounded(metrics.evaluate(td.scored(spark, sf)))


@query(_by_policy("rawkeyed"), extra=_ranked("rawkeyed"))
def metrics_raw_profile(spark, sf):
    return _rounded(metrics.evaluate(td.scored(spark, sf, "raw_count")))


@query(" UNION ALL ".join(_by_policy("scored", k) for k in (1, 5, 10, 20)), extra=_ranked("scored"))
def metrics_multi_k(spark, sf):
    return _rounded(metrics.evaluate(td.scored(spark, sf), ks=(1, 5, 10, 20)))


_TIED = "tied AS (SELECT p.row_id, count(*) FILTER (WHERE c.score > p.score) AS a, count(*) FILTER (WHERE c.score = p.score) AS t FROM scored p JOIN scored c USING (row_id) WHERE p.is_positive GROUP BY p.row_id)"


@query(
    f"SELECT count(*) AS n_rows, round(avg(h), 6) AS hit_at_k, round(avg(g), 6) AS ndcg_at_k, round(avg(m), 6) AS mrr FROM (SELECT row_id, avg(CASE WHEN r <= {K} THEN 1.0::DOUBLE ELSE 0 END) AS h, avg(CASE WHEN r <= {K} THEN 1.0::DOUBLE / log2(r + 1) ELSE 0 END) AS g, avg(1.0::DOUBLE / r) AS m FROM (SELECT row_id, unnest(range(a + 1, a + t + 1)) AS r FROM tied) GROUP BY row_id)",
    extra=_TIED,
)
def analytic_expectation(spark, sf):
    return _rounded(metrics.expected_metrics(td.scored(spark, sf), K))


_SEEDED = (
    f"seeds AS (SELECT popular.*, unnest(range({SEED_START}, {SEED_START + SEEDS})) AS seed FROM popular), {_keys('sk', 'seeds', 'user_idx', 'item_idx', 'seed')}, "
    f"sr AS (SELECT seed, is_positive, row_number() OVER (PARTITION BY seed, row_id ORDER BY score DESC, z, item_idx) AS r FROM sk), per AS (SELECT seed, avg(CASE WHEN r <= {K} THEN 1.0::DOUBLE ELSE 0 END) AS h, avg(CASE WHEN r <= {K} THEN 1.0::DOUBLE / log2(r + 1) ELSE 0 END) AS g, avg(1.0::DOUBLE / r) AS m FROM sr WHERE is_positive GROUP BY seed)"
)


@query(
    "SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(*)), 6) AS se, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (SELECT seed, unnest(['hit_at_k', 'ndcg_at_k', 'mrr']) AS metric, unnest([h, g, m]) AS v FROM per) GROUP BY metric",
    extra=_SEEDED,
)
def randomized_summary(spark, sf):
    return _rounded(metrics.summarize(metrics.repeated_metrics(td.scored(spark, sf), SEEDS, SEED_START, K)))


@query(_by_policy("scored").replace(f"{K}::INTEGER AS k, ", ""), extra=_ranked("scored"))
def metrics_from_states(spark, sf):
    """Lists arrive in three parts; their states add up."""
    lists = td.scored(spark, sf)
    parts = [running.state(lists.where(F.pmod("row_id", F.lit(3)) == i)) for i in range(3)]
    return _rounded(running.merge(parts[0].unionByName(parts[1]).unionByName(parts[2])))


# diagnostics

_BLOCKS = f"""blocks AS (SELECT row_id, max(n) AS block, count(*) AS kinds, sum(n) AS width FROM (SELECT row_id, score, count(*) AS n FROM scored GROUP BY row_id, score) GROUP BY row_id),
edge AS (SELECT row_id, score AS b FROM (SELECT row_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, slot) AS r FROM scored) WHERE r = {K}),
bound AS (SELECT row_id, count(*) FILTER (WHERE score > b) < {K} AND count(*) FILTER (WHERE score >= b) > {K} AS x FROM scored JOIN edge USING (row_id) GROUP BY row_id), {_TIED}"""


@query(
    "SELECT count(*) AS n_rows, round(avg((kinds < width)::INTEGER), 6) AS any_tie_rate, round(avg(x::INTEGER), 6) AS boundary_tie_rate, round(avg((t > 1)::INTEGER), 6) AS positive_in_tie_rate, round(avg(block), 6) AS average_max_tie_block, round(median(block), 6) AS median_max_tie_block, round(coalesce(avg(t) FILTER (WHERE t > 1), 0), 6) AS average_positive_tie_size FROM blocks JOIN bound USING (row_id) JOIN tied USING (row_id)",
    extra=_BLOCKS,
)
def tie_diagnostics(spark, sf):
    return _rounded(diagnostics.tie_diagnostics(td.scored(spark, sf), K))


@query("SELECT row_id, x AS boundary_tie, block AS max_block, t AS tie_size FROM blocks JOIN bound USING (row_id) JOIN tied USING (row_id)", extra=_BLOCKS)
def boundary_ties(spark, sf):
    return diagnostics.row_diagnostics(td.scored(spark, sf), K).select("row_id", "boundary_tie", F.col("max_block").cast("long").alias("max_block"), F.col("tie_size").cast("long").alias("tie_size"))


_TOPS = ", ".join(f"top_{p} AS (SELECT row_id, list_sort(list(DISTINCT item_idx)) AS s, max(CASE WHEN is_positive THEN 0 END) AS hit FROM ranked_scored WHERE {p} <= {K} GROUP BY row_id)" for p in ("stable_positive_first", "hardened_uint64"))


@query(
    "SELECT count(*) AS n_rows, round(avg((a.s <> b.s)::INTEGER), 6) AS topk_item_set_change_rate, round(avg((l <> r)::INTEGER), 6) AS positive_rank_change_rate, round(coalesce(avg(abs(l - r)) FILTER (WHERE l <> r), 0), 6) AS mean_absolute_positive_rank_change FROM top_stable_positive_first a JOIN top_hardened_uint64 b USING (row_id) JOIN (SELECT row_id, stable_positive_first AS l, hardened_uint64 AS r FROM ranked_scored WHERE is_positive) USING (row_id)",
    extra=f"{_ranked('scored')}, {_TOPS}",
)
def policy_difference(spark, sf):
    return _rounded(diagnostics.policy_difference(td.scored(spark, sf), TiePolicy.STABLE, TiePolicy.HARDENED, K))


@query("SELECT row_id, array_to_string(s, ',') AS top FROM top_hardened_uint64", extra=f"{_ranked('scored')}, {_TOPS}")
def topk_sets(spark, sf):
    return diagnostics.top_sets(td.scored(spark, sf), TiePolicy.HARDENED, K).select("row_id", F.array_join("top", ",").alias("top"))


@query(
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE k) AS collision_rows, count(*) FILTER (WHERE d < n) AS duplicate_identity_rows FROM (SELECT row_id, bool_or(i > 1) AS k, sum(i) AS d, sum(n) AS n FROM (SELECT row_id, (z::DOUBLE / 18446744073709551616.0)::FLOAT AS f, count(DISTINCT item_idx) AS i, count(*) AS n FROM scored GROUP BY ALL) GROUP BY row_id)"
)
def f32_collision_audit(spark, sf):
    return diagnostics.collision_audit(td.scored(spark, sf))


@query("SELECT row_id, count(*) - count(DISTINCT item_idx) AS repeats FROM cands GROUP BY row_id HAVING count(*) > count(DISTINCT item_idx)")
def duplicate_identity_rows(spark, sf):
    rows = td.candidates(td.split(spark, sf)).groupBy("row_id").agg((F.count(F.lit(1)) - F.countDistinct("item_idx")).alias("repeats"))
    return rows.where("repeats > 0")


_TURNED = "turned AS (SELECT row_id, " + ", ".join(f"list(item_idx ORDER BY score DESC, {o}) <> list(item_idx ORDER BY score DESC, {o.replace('slot', 'slot DESC')}) AS moved_{p}" for p, o in _ORDERS.items()) + " FROM scored GROUP BY row_id)"


@query(" UNION ALL ".join(f"SELECT '{p}' AS policy, count(*) AS n_rows, count(*) FILTER (WHERE moved_{p}) AS changed_rows FROM turned" for p in _ORDERS), extra=_TURNED)
def permutation_invariance(spark, sf):
    return diagnostics.permutation_changes(td.scored(spark, sf), ranking.KEYED)


@query(
    f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE kinds_i < width) AS duplicate_identity_rows, count(*) FILTER (WHERE eq > 0) AS float_key_rows, sum(eq)::BIGINT AS float_key_pairs,
count(*) FILTER (WHERE kinds < width) AS any_tie_rows, count(*) FILTER (WHERE x) AS boundary_tie_rows, count(*) FILTER (WHERE t > 1) AS positive_in_tie_rows, round(avg(t), 6) AS mean_block_all_rows,
round(coalesce(avg(t) FILTER (WHERE t > 1), 0), 6) AS mean_block_tied_rows, max(t) AS max_block, count(*) FILTER (WHERE ins > 0) AS float_key_in_tie_rows, sum(ins)::BIGINT AS float_key_in_tie_pairs,
count(*) FILTER (WHERE moved_archived_float32) AS archived_order_dependent_rows, count(*) FILTER (WHERE moved_hardened_uint64) AS hardened_order_dependent_rows, count(*) FILTER (WHERE other) AS order_difference_rows,
count(*) FILTER (WHERE top) AS topk_difference_rows, count(*) FILTER (WHERE rk) AS positive_rank_difference_rows
FROM blocks JOIN bound USING (row_id) JOIN tied USING (row_id) JOIN turned USING (row_id) JOIN pairs USING (row_id) JOIN both_orders USING (row_id)""",
    extra=_BLOCKS + ", " + _TURNED + f""", {_ranked('scored')},
n32 AS (SELECT *, (z::DOUBLE / {_TWO64}.0)::FLOAT AS k32 FROM scored),
pairs AS (SELECT row_id, sum(e) AS eq, sum(i) AS ins, count(DISTINCT item_idx) AS kinds_i FROM (SELECT row_id, item_idx,
  coalesce((lag(k32) OVER a = k32 AND lag(item_idx) OVER a <> item_idx)::INTEGER, 0) AS e, coalesce((lag(score) OVER b = score AND lag(k32) OVER b = k32 AND lag(item_idx) OVER b <> item_idx)::INTEGER, 0) AS i
  FROM n32 WINDOW a AS (PARTITION BY row_id ORDER BY k32, item_idx), b AS (PARTITION BY row_id ORDER BY score, k32, item_idx)) GROUP BY row_id),
both_orders AS (SELECT row_id, list(item_idx ORDER BY archived_float32) <> list(item_idx ORDER BY hardened_uint64) AS other,
  list_sort(list(DISTINCT item_idx) FILTER (WHERE archived_float32 <= {K})) <> list_sort(list(DISTINCT item_idx) FILTER (WHERE hardened_uint64 <= {K})) AS top,
  bool_or(is_positive AND archived_float32 <> hardened_uint64) AS rk FROM ranked_scored GROUP BY row_id)""",
)
def contract_audit(spark, sf):
    return _rounded(diagnostics.contract_audit(td.scored(spark, sf), K))


# text

_SPACE = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]+"


@query(f"SELECT doc_id, md5(trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g'))) AS digest FROM documents", base=False)
def text_normalize(spark, sf):
    return td.table(spark, sf, "documents").select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("digest"))


_LICENSE = (r"\bmit license\b", r"\bapache license\b", r"\bgnu general public\b")


@query("SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '" + "|".join(f"(?:{p})" for p in _LICENSE) + "')::INTEGER AS label FROM documents", base=False)
def regex_labels(spark, sf):
    return td.table(spark, sf, "documents").select("doc_id", text.has_label(F.col("text"), _LICENSE).alias("label"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, 'apache license', ' ', 'gi'), 'all rights', ' ', 'gi'), '{_SPACE}', ' ', 'g'))) AS digest FROM documents", base=False)
def mask_terms(spark, sf):
    return td.table(spark, sf, "documents").select("doc_id", F.md5(text.mask_terms(F.col("text"), ("apache license", "all rights")).cast("binary")).alias("digest"))


_BUCKET = "CASE " + " ".join(f"WHEN p_size * 2.5 <= {b} THEN 'price::<={b}'" for b in text.PRICE_BOUNDS) + " ELSE 'price::>100' END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n, round(min(p_retailprice), 6) AS low FROM part GROUP BY 1", base=False)
def price_buckets(spark, sf):
    parts = td.table(spark, sf, "part").select("p_retailprice", text.price_bucket(F.col("p_size") * 2.5).alias("bucket"))
    return _rounded(parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("low")))


@query("SELECT event_id, 'k ' || (props ->> 'k') AS flat, (props ->> 'k')::BIGINT AS k FROM events", base=False)
def json_props(spark, sf):
    return td.table(spark, sf, "events").select("event_id", text.flatten_json(F.col("props")).alias("flat"), text.details_map(F.col("props"))["k"].cast("long").alias("k"))


@query("SELECT p_partkey, 'name ' || p_name || ' made by ' || p_brand || ' ' || p_type || ' deep size ' || p_size AS flat FROM part", base=False)
def nested_json(spark, sf):
    made = F.struct(F.array("p_brand", F.lit(None).cast("string"), "p_type").alias("by"), F.array(F.array(F.struct(F.struct(F.col("p_size").alias("size")).alias("deep")))).alias("x"))
    text_of = F.replace(F.to_json(F.struct(F.col("p_name").alias("name"), made.alias("made"))), F.lit('"x":'), F.lit('"":'))
    return td.table(spark, sf, "part").select("p_partkey", F.regexp_replace(text.flatten_json(text_of), " +", " ").alias("flat"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_partkey * 1000 + 0.25 WHEN 1 THEN p_size WHEN 2 THEN NULL ELSE -p_size / 1e4 END::DOUBLE AS price FROM part", base=False)
def price_texts(spark, sf):
    """Prices as texts with $ and commas, within words, without a number, and as numbers written with an exponent."""
    kind, size = F.col("p_size") % 4, F.col("p_size")
    said = F.when(kind == 0, F.concat(F.lit(" $"), F.format_number(F.col("p_partkey") * 1000 + 0.25, 2))).when(kind == 1, F.concat(F.lit("from "), size.cast("string"), F.lit(" each"))).when(kind == 2, " None ").otherwise(F.concat(F.lit("-"), size.cast("string"), F.lit("E-4")))
    return td.table(spark, sf, "part").select("p_partkey", F.when(kind == 3, text.numeric_price(said)).otherwise(text.parse_price(said)).alias("price"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'raw_details=' || p_name WHEN 2 THEN 'brand=' || p_brand || ';size=' || p_size ELSE 'raw_details=[\"' || p_type || '\"]' END AS details, CASE p_size % 4 WHEN 0 THEN 0 ELSE 1 END AS n_listed FROM part", base=False)
def details_and_lists(spark, sf):
    kind = F.col("p_size") % 4
    said = F.when(kind == 0, " \n").when(kind == 1, F.concat(F.lit("  "), "p_name", F.lit("\t"))).when(kind == 2, F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))).otherwise(F.to_json(F.array("p_type")))
    pairs = F.array_sort(F.transform(F.map_entries(text.details_map(said)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return td.table(spark, sf, "part").select("p_partkey", F.array_join(pairs, ";").alias("details"), F.size(text.text_list(said)).alias("n_listed"))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) >= 500 THEN regexp_matches(lower(coalesce(text, '')), '" + "|".join(f"(?:{p})" for p in _LICENSE) + "')::INTEGER END AS label FROM documents", base=False)
def regex_labels_of_long_texts(spark, sf):
    """No label where a text is too short to tell."""
    return td.table(spark, sf, "documents").select("doc_id", text.has_label(F.col("text"), _LICENSE, 500).alias("label"))


@query("""SELECT p_partkey, '["' || p_type || '","' || p_brand || '"]' AS listed FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT p_partkey, '[]' FROM part WHERE p_size % 3 = 0""", base=False)
def categories_as_json(spark, sf):
    listed = F.when(F.col("p_size") % 3 != 0, F.array("p_type", "p_brand"))
    return td.table(spark, sf, "part").select("p_partkey", tables.categories_json(listed).alias("listed"))


@query(
    """SELECT movieId, max((tagId = 3 AND relevance >= 0.7)::INTEGER)::DOUBLE AS attr_0, max((tagId = 1 AND relevance >= 0.7)::INTEGER)::DOUBLE AS attr_1
FROM (SELECT l_partkey AS movieId, l_suppkey % 5 AS tagId, l_discount * 10 AS relevance FROM lineitem) WHERE tagId IN (1, 3) GROUP BY movieId""",
    base=False,
)
def tag_attributes(spark, sf):
    """Relevances of items to tags as 0/1 columns of the chosen tags, in their order."""
    found = td.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("movieId"), (F.col("l_suppkey") % 5).alias("tagId"), (F.col("l_discount") * 10).alias("relevance"))
    tags = spark.createDataFrame([(i, f"tag {i}") for i in range(5)], "tagId int, tag string")
    return tables.tag_attributes(found, tags, ["tag 3", "tag 1"])


def _as_lines(spark, rows: DataFrame) -> str:
    """A folder with the rows as lines of JSON."""
    path = f"{tables.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return path


@query("SELECT o_custkey::VARCHAR AS user_id, o_orderpriority AS item_id, o_totalprice AS rating, o_orderkey AS ts FROM orders WHERE o_orderkey % 10 <> 0", base=False)
def reviews_from_json(spark, sf):
    """Orders written as lines of JSON, every tenth with no number or none at all as its rating, and read as reviews."""
    odd = F.when(F.col("o_orderkey") % 20 == 0, "n/a").when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_totalprice").cast("string"))
    rows = td.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("parent_asin"), odd.alias("rating"), F.col("o_orderkey").alias("timestamp"))
    return tables.read_reviews(spark, _as_lines(spark, rows)).select("user_id", "item_id", "rating", "ts")


@query(
    """SELECT p_partkey::VARCHAR AS item_id, p_name AS title, round(CASE p_size % 3 WHEN 0 THEN -p_retailprice WHEN 1 THEN p_retailprice END, 6) AS price_num,
trim(lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_brand || ' size ' || p_size || ' of deep ' || p_type)) AS item_text FROM part""",
    base=False,
)
def items_from_json(spark, sf):
    """Parts written as lines of JSON with nested fields and prices as numbers, texts and words, and read as items."""
    kind, price = F.col("p_size") % 3, F.col("p_retailprice")
    details = F.struct(F.col("p_size").alias("Size"), F.struct(F.array(F.col("p_type")).alias("Deep")).alias("of"))
    rows = td.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("parent_asin"), F.col("p_name").alias("title"), F.col("p_brand").alias("store"), F.array("p_type", F.lit(None).cast("string"), "p_brand").alias("categories"), details.alias("details"), kind.alias("kind"), price.alias("p"))
    own = [c for c in rows.columns if c not in ("kind", "p")]
    shared = _as_lines(spark, rows.where("kind = 0").select(*own, (-F.col("p")).alias("price")))
    texts = _as_lines(spark, rows.where("kind = 1").select(*own, F.concat(F.lit("$"), F.col("p").cast("string")).alias("price")))
    words = _as_lines(spark, rows.where("kind = 2").select(*own, F.lit("none").alias("price")))
    read = tables.read_items(spark, shared).unionByName(tables.read_items(spark, texts)).unionByName(tables.read_items(spark, words))
    return _rounded(read.select("item_id", "title", "price_num", "item_text"))


@query("SELECT o_custkey AS user_id, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1", base=False)
def last_row_of_each(spark, sf):
    rows = td.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey", "o_orderpriority")
    return prep.last_wins(rows, ("user_id",), ("o_orderdate", "o_orderkey")).select("user_id", "o_orderkey", "o_orderpriority")


@query(
    "SELECT user_id, event_id, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY position) AS rn FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, count(*) OVER () AS n FROM events) WHERE position >= floor(n * 0.9)) WHERE rn = 1 ORDER BY position LIMIT 50",
    base=False,
)
def first_test_users(spark, sf):
    """The first 50 users of the test part in time, each with its first row there."""
    placed = prep.global_time_split(td.table(spark, sf, "events").select("event_id", "user_id", "ts"), F.col("ts"), F.col("event_id"))
    return prep.first_targets(placed.where("split = 'test'"), 50, "user_id", "event_id").select("user_id", "event_id", "position")


# groups

_GROUPS = f"""gs AS (SELECT item_idx, unnest(['brand::' || p_brand, 'type::' || p_type, {_BUCKET}]) AS "group" FROM parts)"""


def _groups(spark, sf, rows, support: int = 1):
    items, _ = td.items_with_types(rows, spark, sf)
    return groups.item_groups(items, [groups.prefixed("brand", F.col("p_brand")), groups.prefixed("type", F.col("p_type")), text.price_bucket(F.col("p_size") * 2.5)], support)


@query('SELECT item_idx, "group" FROM gs WHERE "group" IN (SELECT "group" FROM gs GROUP BY "group" HAVING count(*) >= 50)', extra=_GROUPS)
def item_groups(spark, sf):
    return _groups(spark, sf, td.mapped(spark, sf), 50)


@query('SELECT "group", count(*) AS support, row_number() OVER (ORDER BY "group") - 1 AS group_idx FROM gs GROUP BY "group"', extra=_GROUPS)
def group_support(spark, sf):
    rows = tables.checkpointed(_groups(spark, sf, td.mapped(spark, sf)))
    return groups.group_support(rows).join(groups.group_ids(rows), "group")


_BIAS = "gm AS (SELECT avg(y::DOUBLE) AS gm FROM train), bias AS (SELECT user_idx, (sum(y::DOUBLE) + 5 * gm) / (count(*) + 5) AS bias FROM train, gm GROUP BY user_idx, gm)"


@query("SELECT user_idx, round(bias + 1e-9, 6) AS bias FROM bias", extra=_BIAS)
def user_bias_smoothed(spark, sf):
    return _rounded(groups.user_bias(td.split(spark, sf).where("split = 'train'"), SMOOTHING), nudge=1e-9)


@query('SELECT user_idx, "group", round(sum(y::DOUBLE - bias) / (count(*) + 5) + 1e-9, 6) AS coef FROM train JOIN bias USING (user_idx) JOIN gs USING (item_idx) GROUP BY user_idx, "group" HAVING count(*) >= 2', extra=f"{_GROUPS}, {_BIAS}")
def user_group_coef(spark, sf):
    rows = td.split(spark, sf)
    train = rows.where("split = 'train'")
    return _rounded(groups.user_group_coefficients(train, groups.user_bias(train, SMOOTHING), _groups(spark, sf, rows), SMOOTHING, 2), nudge=1e-9)


_ROW_KEY = "(user_idx * 1000000 + item_idx) * 100000 + ts"
_OOF = f"""tk AS (SELECT *, {_ROW_KEY} AS row_key FROM train), {_keys("fk", "tk", "user_idx", "row_key", "42")},
ff AS (SELECT user_idx, item_idx, row_key, y::DOUBLE AS y, ((row_number() OVER (PARTITION BY user_idx ORDER BY z, row_key) - 1) % 3)::INTEGER AS fold FROM fk),
fm AS (SELECT f.fold, sum(t.y) / count(*) AS m FROM (SELECT DISTINCT fold FROM ff) f JOIN ff t ON t.fold <> f.fold GROUP BY f.fold),
fu AS (SELECT *, sum(y) OVER (PARTITION BY user_idx) - sum(y) OVER (PARTITION BY user_idx, fold) AS us, count(*) OVER (PARTITION BY user_idx) - count(*) OVER (PARTITION BY user_idx, fold) AS un FROM ff),
fo AS (SELECT fu.*, (us + 5 * m) / (un + 5) AS user_oof FROM fu JOIN fm USING (fold)),
fg AS (SELECT fo.*, "group", sum(y) OVER (PARTITION BY user_idx, "group") - sum(y) OVER (PARTITION BY user_idx, "group", fold) AS s, count(*) OVER (PARTITION BY user_idx, "group") - count(*) OVER (PARTITION BY user_idx, "group", fold) AS n FROM fo JOIN gs USING (item_idx)),
oof AS (SELECT row_key, user_idx, item_idx, fold, y, user_oof, sum(CASE WHEN n >= 2 THEN (s - n * user_oof) / (n + 5) ELSE 0 END) AS group_oof FROM fg GROUP BY ALL)"""


def _oof(spark, sf):
    rows = td.split(spark, sf)
    train = rows.where("split = 'train'").withColumn("row_key", F.expr(_ROW_KEY)).select("row_key", "user_idx", "item_idx", "y")
    train = tables.checkpointed(groups.assign_folds(train, FOLDS, 42))
    return rows, groups.cross_fitted_control(train, _groups(spark, sf, rows), FOLDS, SMOOTHING, 2)


@query("SELECT row_key, fold, round(user_oof + 1e-9, 6) AS user_oof, round(group_oof + 1e-9, 6) AS group_oof FROM oof", extra=f"{_GROUPS}, {_OOF}")
def group_control_oof(spark, sf):
    return _rounded(_oof(spark, sf)[1].select("row_key", "fold", "user_oof", "group_oof"), nudge=1e-9)


_RATES = ", ".join(f"(sum(a{i}) OVER (PARTITION BY p_brand) + 5 * m{i}) / (count(*) OVER (PARTITION BY p_brand) + 5) AS p{i}" for i in range(_TYPES))
_RES = f"pr AS (SELECT v.*, {_RATES} FROM vecs v JOIN parts USING (item_idx), means), res AS (SELECT item_idx, {', '.join(f'CASE WHEN p{i} > 0.95 THEN 0 ELSE a{i} - p{i} END AS r{i}' for i in range(_TYPES))} FROM pr)"


@query(f"SELECT user_idx, {', '.join(f'round(sum((y - user_oof - group_oof) * r{i}) + 1e-9, 4) AS a{i}' for i in range(_TYPES))} FROM oof JOIN res USING (item_idx) GROUP BY user_idx", extra=f"{_GROUPS}, {_OOF}, {_RES}")
def residual_scores(spark, sf):
    """Residualized profiles; a label's propensity is its smoothed rate within the brand."""
    rows, oof = _oof(spark, sf)
    items, attrs = td.items_with_types(rows, spark, sf)
    means = scores.attribute_means(items, attrs)
    rates = items.groupBy(F.col("p_brand").alias("_b")).agg(*[((F.sum(a) + F.lit(SMOOTHING * means[a])) / (F.count(F.lit(1)) + F.lit(SMOOTHING))).alias(f"p_{a}") for a in attrs])
    residual = scores.residuals(items.join(rates, F.col("p_brand") == F.col("_b")), attrs)
    weight = F.col("y").cast("double") - F.col("user_oof") - F.col("group_oof")
    joined = oof.join(residual.select("item_idx", *attrs), "item_idx")
    return _rounded(joined.groupBy("user_idx").agg(*[F.sum(weight * F.col(a)).alias(a) for a in attrs]), 4, 1e-9)


@query(
    """WITH d AS (SELECT source, quality FROM labels JOIN documents USING (doc_id)), g AS (SELECT avg(quality) AS m FROM d),
p AS (SELECT quality AS y, (sum(quality) OVER (PARTITION BY source) + 5 * m) / (count(*) OVER (PARTITION BY source) + 5) AS p FROM d, g),
r AS (SELECT y, p, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0)::DOUBLE AS r, greatest(least(p, 1 - 1e-6), 1e-6) AS q FROM p)
SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auroc FROM r""",
    base=False,
)
def oof_logloss_brier_auc(spark, sf):
    rows = td.table(spark, sf, "labels").join(td.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("source", F.col("quality").alias("label"))
    mean = rows.agg(F.avg("label")).first()[0]
    rates = rows.groupBy("source").agg(((F.sum("label") + F.lit(SMOOTHING * mean)) / (F.count(F.lit(1)) + F.lit(SMOOTHING))).alias("p"))
    return _rounded(groups.binary_report(tables.checkpointed(rows.join(rates, "source"))))


@query(
    """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dot FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL)
SELECT query_id, vec_id, CASE WHEN round(dot, 4) = 0 THEN 0 ELSE round(dot, 4) END::DOUBLE AS dot, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, vec_id) AS rank FROM d""",
    base=False,
)
def embedding_dot_rank(spark, sf):
    """All rows ranked for every query; queries are the rows whose id is divisible by 20."""
    vectors = td.table(spark, sf, "embeddings")
    return _rounded(search.rank_by_dot(vectors.where("vec_id % 20 = 0"), vectors), 4)


@query("SELECT row_id, count(*) AS n FROM popular WHERE row_id % 5 <> 0 OR slot <> 7 GROUP BY row_id HAVING count(*) <> 31")
def incomplete_lists(spark, sf):
    """Lists of which every fifth lacks a candidate."""
    return sampling.incomplete_rows(td.scored(spark, sf).where("row_id % 5 <> 0 OR slot <> 7"), td.NEGATIVES + 1)


# reports


@query(
    " UNION ALL ".join(f"SELECT '{n}' AS score, " + ", ".join(f"round(avg(CASE WHEN {p} <= {K} THEN 1.0::DOUBLE / log2({p} + 1) ELSE 0 END), 6) AS {p}" for p in _ORDERS) + f" FROM ranked_{s} WHERE is_positive" for n, s in (("popularity", "scored"), ("raw_count", "rawkeyed"))),
    extra=f"{_ranked('scored')}, {_ranked('rawkeyed')}",
)
def policy_pivot_report(spark, sf):
    parts = [metrics.evaluate(td.scored(spark, sf, f)).withColumn("score", F.lit(f)) for f in ("popularity", "raw_count")]
    return _rounded(report.policy_pivot(parts[0].unionByName(parts[1]), list(_ORDERS)))


@query(
    f"""SELECT 'popularity' AS score, round(m.stable_positive_first, 6) AS stable_positive_first, round(m.hardened_uint64, 6) AS hardened_uint64, round(avg(g), 6) AS randomized_mean, round(stddev_samp(g), 6) AS randomized_sd,
format('{{:.6f}} ± {{:.6f}}', avg(g), stddev_samp(g)) AS randomized FROM per, (SELECT avg(CASE WHEN stable_positive_first <= {K} THEN 1.0::DOUBLE / log2(stable_positive_first + 1) ELSE 0 END) AS stable_positive_first,
avg(CASE WHEN hardened_uint64 <= {K} THEN 1.0::DOUBLE / log2(hardened_uint64 + 1) ELSE 0 END) AS hardened_uint64 FROM ranked_scored WHERE is_positive) m GROUP BY ALL""",
    extra=f"{_ranked('scored')}, {_SEEDED}",
)
def policy_report(spark, sf):
    lists = td.scored(spark, sf)
    found = metrics.evaluate(lists).withColumn("score", F.lit("popularity"))
    summary = metrics.summarize(metrics.repeated_metrics(lists, SEEDS, SEED_START, K)).withColumn("score", F.lit("popularity"))
    return _rounded(report.policy_report(found, summary, ("stable_positive_first", "hardened_uint64")))


def _gain(policy: str) -> str:
    return f"avg(CASE WHEN {policy} <= {K} THEN 1.0::DOUBLE / log2({policy} + 1) ELSE 0 END)"


@query(
    " UNION ALL ".join(
        f"SELECT '{label}' AS score, round(a, 6) AS stable, round(b, 6) AS keyed, round(b - a, 6) AS change FROM (SELECT {_gain('stable_positive_first')} AS a, {_gain('hardened_uint64')} AS b FROM ranked_{s} WHERE is_positive)"
        for label, s in (("Attribute overlap", "rawkeyed"), ("Popularity", "scored"))
    ),
    extra=f"{_ranked('scored')}, {_ranked('rawkeyed')}",
)
def policy_change_table(spark, sf):
    """What hardened keys change against input order, with the scores' names for readers."""
    parts = [metrics.evaluate(td.scored(spark, sf, f), (TiePolicy.STABLE, TiePolicy.HARDENED)).withColumn("score", F.lit(f)) for f in ("popularity", "raw_count")]
    changes = report.change_table(parts[0].unionByName(parts[1]), TiePolicy.STABLE, TiePolicy.HARDENED)
    return _rounded(report.relabelled(changes, "score", {"raw_count": "Attribute overlap", "popularity": "Popularity"}))


@query("SELECT count(DISTINCT row_id) AS n_rows, count(*) FILTER (WHERE is_positive <> (slot = 0)) AS misplaced_positives, (SELECT count(*) FROM turned WHERE moved_hardened_uint64) AS changed_rows FROM scored", extra=_TURNED)
def list_contract(spark, sf):
    return experiments.list_contract(td.scored(spark, sf), KEY_SEED)


@query(f"SELECT policy, k, n_rows, hit_at_k, ndcg_at_k, mrr, 0.0::DOUBLE AS max_abs_diff, 'pass' AS status FROM ({_by_policy('scored')})", extra=_ranked("scored"))
def replay_compare(spark, sf):
    """Freezes scored lists, reads them again, and compares the metrics of both."""
    lists = td.scored(spark, sf)
    path = f"{tables.shared_folder(spark)}/frozen-{uuid.uuid4().hex}"
    tables.freeze(lists, path, "popularity")
    again = metrics.evaluate(tables.frozen(spark, path).where("score_name = 'popularity'").drop("score_name"))
    return _rounded(again.join(report.compare(metrics.evaluate(lists), again, ("policy", "k")), ["policy", "k"]))


@query()
def propensity_tfidf_lr(spark, sf):
    """Quality labels from masked texts; the fits are iterative, so there is no SQL."""
    docs = td.table(spark, sf, "documents").join(td.table(spark, sf, "labels"), "doc_id")
    items = docs.select(F.col("doc_id").alias("item_idx"), F.col("text").alias("item_text"), F.col("quality").alias("good"))
    return _rounded(propensity.out_of_fold(items, "good", ("license",)))


def _figures(source: str, name: str) -> str:
    return f"SELECT '{name}' AS score, policy, hit_at_k, ndcg_at_k, mrr FROM ({_by_policy(source)})"


_BOTH = f"{_ranked('scored')}, {_ranked('rawkeyed')}, fa AS ({_figures('scored', 'popularity')}), fb AS ({_figures('rawkeyed', 'raw_count')})"


@query(
    "SELECT a.policy, round(greatest(abs(a.hit_at_k - b.hit_at_k), abs(a.ndcg_at_k - b.ndcg_at_k), abs(a.mrr - b.mrr)), 5) AS max_abs_diff, CASE WHEN b.policy IS NULL THEN 'missing' WHEN greatest(abs(a.hit_at_k - b.hit_at_k), abs(a.ndcg_at_k - b.ndcg_at_k), abs(a.mrr - b.mrr)) <= 0.1 THEN 'pass' ELSE 'fail' END AS status FROM fa a LEFT JOIN (SELECT * FROM fb WHERE policy <> 'archived_float32') b USING (policy)",
    extra=_BOTH,
)
def compare_families(spark, sf):
    """One family's figures held against another's, of which a policy is missing."""
    a, b = (_rounded(metrics.evaluate(td.scored(spark, sf, f))) for f in ("popularity", "raw_count"))
    return _rounded(report.compare(a, b.where("policy <> 'archived_float32'"), ("policy",), tolerance=0.1), 5)


@query(
    "SELECT score, policy, round(e, 6) AS expected, round(v, 6) AS actual, round(abs(e - v), 6) AS abs_diff, CASE WHEN v IS NULL THEN 'missing' WHEN abs(e - v) <= 0.05 THEN 'pass' ELSE 'fail' END AS status FROM (VALUES ('popularity', 'hardened_uint64', 0.33::DOUBLE), ('raw_count', 'stable_positive_first', 0.1), ('raw_count', 'none', 0.5)) t(score, policy, e) LEFT JOIN (SELECT score, policy, hit_at_k AS v FROM fa UNION ALL SELECT score, policy, hit_at_k FROM fb) USING (score, policy)",
    extra=_BOTH,
)
def expected_hits(spark, sf):
    parts = [_rounded(metrics.evaluate(td.scored(spark, sf, f))).select(F.lit(f).alias("score"), "policy", F.col("hit_at_k").alias("value")) for f in ("popularity", "raw_count")]
    wanted = spark.createDataFrame([("popularity", "hardened_uint64", 0.33), ("raw_count", "stable_positive_first", 0.1), ("raw_count", "none", 0.5)], "score string, policy string, value double")
    return _rounded(report.within(wanted, parts[0].unionByName(parts[1]), ("score", "policy"), 0.05))


@query(
    "SELECT score, metric, round(stable, 5) AS stable, round(keyed, 5) AS keyed, round(keyed - stable, 5) AS change, source FROM (SELECT score, 'mrr' AS metric, max(mrr) FILTER (WHERE policy = 'stable_positive_first') AS stable, max(mrr) FILTER (WHERE policy = 'hardened_uint64') AS keyed, 'new' AS source FROM fa GROUP BY score UNION ALL SELECT 'raw_count', 'mrr', 0.5, 0.25, 'old')",
    extra=_BOTH,
)
def cross_domain(spark, sf):
    """Figures of this run before older ones of the same and of another family."""
    new = report.change_table(_rounded(metrics.evaluate(td.scored(spark, sf))).withColumn("score", F.lit("popularity")).withColumn("metric", F.lit("mrr")), "stable_positive_first", "hardened_uint64", ("score", "metric"), "mrr")
    old = spark.createDataFrame([("popularity", "mrr", 0.9, 0.1), ("raw_count", "mrr", 0.5, 0.25)], "score string, metric string, stable double, keyed double")
    return _rounded(report.cross_domain([("new", new), ("old", old)], ("score", "metric")), 5)
