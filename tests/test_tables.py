"""Preparation, sampling, scores, groups, text and sources."""

import gzip
import inspect
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from listrank.functions import text
from listrank.operators import groups, prep, propensity, report, sampling, scores, search
from listrank.plans import queries
from listrank.sources import tables


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_text(spark):
    assert one(spark, "  A \tB\n c ", text.normalize) == "a b c"
    for value, want in (("$1,234.50", 1234.5), ("none", None), ("", None), ("from 7", 7.0), (None, None), ("-3", 3.0)):
        assert one(spark, value, text.parse_price) == want
    for value, want in ((None, "price::unknown"), (float("nan"), "price::unknown"), (10.0, "price::<=10"), (10.5, "price::<=20"), (101.0, "price::>100")):
        assert one(spark, value, text.price_bucket, "double") == want
    assert one(spark, '["a", null, {"b": "c"}, ["d", "e"]]', text.flatten_json) == "a b c d e"
    deep = '{"a": {"b": ["x \\"q\\" y", {"c": [1, [true, null, "t\\u00e9\\\\"]]}], "d": null}, "e": "{[:,]}"}'
    assert one(spark, deep, text.flatten_json) == 'a b x "q" y c 1 true té\\ d e {[:,]}'
    assert one(spark, '"1.50"', text.flatten_json) == "1.50" and one(spark, "null", text.flatten_json) == "" and one(spark, None, text.flatten_json) == ""
    assert one(spark, json.dumps(['\\"' * 20_000]), text.flatten_json) == '\\"' * 20_000
    for value, want in (("1000000000.0", 1e9), ("1.0E-4", 1e-4), ("-3.5", -3.5), ("NaN", None), ("x", None), (None, None)):
        assert one(spark, value, text.numeric_price) == want
    assert one(spark, "  ", text.details_map) == {} and one(spark, " raw \n", text.details_map) == {"raw_details": "raw"} and one(spark, '[1]', text.details_map) == {"raw_details": "[1]"}
    assert one(spark, ' {"k": {"m": 1}, "n": null} ', text.details_map) == {"k": '{"m":1}', "n": None}
    assert one(spark, "", text.text_list) == [] and one(spark, " ", text.text_list) == []
    assert one(spark, '{"k": 1, "l": ["x", "y"]}', text.flatten_json) == "k 1 l x y" and one(spark, "plain words", text.flatten_json) == "plain words"
    assert one(spark, '{"k": "v"}', text.details_map) == {"k": "v"} and one(spark, "{bad", text.details_map) == {"raw_details": "{bad"} and one(spark, None, text.details_map) == {}
    assert one(spark, '["a", null, "b"]', text.text_list) == ["a", "b"] and one(spark, "solo", text.text_list) == ["solo"] and one(spark, None, text.text_list) == []
    rule = text.LABELS["fragrance_free"]
    assert [one(spark, t, lambda c: text.has_label(c, rule.patterns)) for t in ("Unscented cream", "fragrance-free!", "a perfume", None)] == [1, 1, 0, 0]
    assert one(spark, "short", lambda c: text.has_label(c, rule.patterns, 20)) is None
    cruel = text.LABELS["cruelty_free"]
    assert one(spark, "CRUELTY-FREE and Leaping Bunny face cream", lambda c: text.mask_terms(c, cruel.mask_terms)) == "and face cream"
    assert [one(spark, r, lambda c: text.scaled_rating(c), "double") for r in (0.0, 1.0, 3.0, 9.0)] == [0.0, 0.0, 0.5, 1.0]


def test_last_wins_and_core(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(12), rng.randrange(12), i, rng.randrange(5)) for i in range(90)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, source_row long, ts long")
    last = {}
    for u, i, s, t in rows:
        last[u, i, t] = s
    assert {(r["user_id"], r["item_id"], r["ts"]): r["source_row"] for r in prep.last_wins(df, ("user_id", "item_id", "ts"), ("source_row",)).collect()} == last
    core, history = prep.k_core(df, 7, 8)
    now = list(rows)
    while True:
        n = len(now)
        for at, k in ((0, 7), (1, 8)):
            c = Counter(r[at] for r in now)
            now = [r for r in now if c[r[at]] >= k]
        if len(now) == n:
            break
    assert sorted(tuple(r) for r in core.collect()) == sorted(now) and history[-1][1] == history[-1][2]


@pytest.mark.parametrize("parts", [1, 6])
def test_ids_and_splits(spark, parts):
    values = ["b", "a", "é", "z", "a", "B", "b"]
    df = spark.createDataFrame(list(enumerate(values)), "p long, v string").repartition(parts)
    assert {r["v"]: r["n"] for r in prep.dense_ids(df, "v", "n").collect()} == {v: i for i, v in enumerate(sorted(set(values)))}
    assert {r["v"]: r["n"] for r in prep.first_appearance_ids(df, "v", [F.col("p")], "n").collect()} == {v: i for i, v in enumerate(dict.fromkeys(values))}
    split = prep.global_time_split(spark.range(27).withColumn("ts", -F.col("id")), F.col("ts"))
    assert Counter(r["split"] for r in split.collect()) == {"train": 21, "validation": 3, "test": 3}
    assert split.where("position = 0").first()["id"] == 26
    rows = spark.createDataFrame([(u, t) for u in range(3) for t in range(u + 1)], "u long, t long")
    got = {(r["u"], r["t"]): r["split"] for r in prep.leave_last_two(rows, "u", ("t",)).collect()}
    assert got == {(0, 0): "test", (1, 1): "test", (1, 0): "validation", (2, 2): "test", (2, 1): "validation", (2, 0): "train"}


def test_sampling(spark):
    targets = spark.createDataFrame([(0, 0, 3), (1, 1, 5)], "row_id long, user_idx long, item_idx long")
    seen = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "user_idx long, item_idx long")
    for unique in (False, True):
        out = [sorted(tuple(r) for r in sampling.sample_candidates(t, seen, 20, 8, 42, unique).collect()) for t in (targets, targets.repartition(5))]
        assert out[0] == out[1] and len(out[0]) == 18
        for row, positive, past in ((0, 3, {1, 2}), (1, 5, {3, 4})):
            items = [i for r, _, s, i, p in out[0] if r == row and s > 0]
            assert positive not in items and not past & set(items) and (not unique or len(set(items)) == 8)
    with pytest.raises(ValueError):
        sampling.sample_candidates(targets, seen, 6, 8, unique=True)


@pytest.mark.parametrize("unique", [True, False])
def test_sampling_fills_whatever_can_be_filled(spark, unique):
    """Users who know all of 2,000 items but 30 (one of them the positive of a row) or but 31."""
    targets = spark.createDataFrame([(0, 0, 1_999), (1, 1, 5)], "row_id long, user_idx long, item_idx long")
    open_items = {0: set(range(1_969, 2_000)), 1: set(range(100, 130))}
    seen = spark.createDataFrame([(u, i) for u in (0, 1) for i in range(2_000) if i not in open_items[u]], "user_idx long, item_idx long")
    out = [sorted(tuple(r) for r in sampling.sample_candidates(t, seen, 2_000, 30, 42, unique).collect()) for t in (targets, targets.repartition(5))]
    assert out[0] == out[1] and [r[2] for r in out[0]] == [*range(31)] * 2
    for row, positive in ((0, 1_999), (1, 5)):
        items = [i for r, _, s, i, _ in out[0] if r == row and s > 0]
        assert set(items) <= open_items[row] - {positive} and (not unique or len(set(items)) == 30)
    if unique:
        with pytest.raises(ValueError):
            sampling.sample_candidates(targets, seen.unionByName(spark.createDataFrame([(1, 100)], seen.schema)), 2_000, 30, 42, True)
    else:
        one = seen.unionByName(spark.createDataFrame([(1, i) for i in range(101, 130)], seen.schema))
        assert {r["item_idx"] for r in sampling.sample_candidates(targets, one, 2_000, 30, 42).where("row_id = 1 and slot > 0").collect()} == {100}
        none = one.unionByName(spark.createDataFrame([(1, 100)], seen.schema))
        with pytest.raises(ValueError):
            sampling.sample_candidates(targets, none, 2_000, 30, 42)


@pytest.mark.parametrize("unique", [False, True])
def test_sampling_broadcasts_no_history(spark, monkeypatch, unique):
    """Spark takes an exploded history for a small one, whatever its size."""
    plans, stored = [], sampling.checkpointed
    monkeypatch.setattr(sampling, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or stored(df))
    targets = spark.range(3).select(F.col("id").alias("row_id"), F.col("id").alias("user_idx"), F.col("id").alias("item_idx"))
    seen = targets.select("user_idx", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("item_idx")).where("(item_idx + user_idx) % 10 <> 0")
    rows = sampling.sample_candidates(targets, seen, 400, 30, 42, unique).where("slot > 0").collect()
    assert len(rows) == 90 and all((r["item_idx"] + r["user_idx"]) % 10 == 0 and r["item_idx"] != r["row_id"] for r in rows)
    assert plans and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("unique", [False, True])
def test_sampling_stores_no_draws(spark, monkeypatch, unique):
    """Rows that draws alone fill are stored as they are and once a round, in catalogues of any size, with the same lists."""
    n, sizes, stored = 50, [], sampling.checkpointed
    monkeypatch.setattr(sampling, "checkpointed", lambda df: sizes.append(df.count()) or stored(df))
    targets = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 20).alias("user_idx"), F.col("id").alias("item_idx"))
    seen = spark.range(20).select(F.col("id").alias("user_idx"), F.explode(F.sequence(F.lit(0), F.lit(899))).alias("item_idx")).where("(item_idx + user_idx) % 3 <> 0")
    lists = [sorted(tuple(r) for r in sampling.sample_candidates(targets, seen, 900, 30, 42, unique).collect())]
    assert len(lists[0]) == 31 * n and sum(sizes) <= 4 * n
    monkeypatch.setattr(sampling, "PACKED", 0)
    lists.append(sorted(tuple(r) for r in sampling.sample_candidates(targets, seen, 900, 30, 42, unique).collect()))
    narrow = targets.withColumn("item_idx", F.col("row_id") % 90)
    for bound in (0, 90):
        monkeypatch.setattr(sampling, "PACKED", bound)
        lists.append(sorted(tuple(r) for r in sampling.sample_candidates(narrow, seen.where("item_idx < 90 OR item_idx > 800"), 90, 29, 42, unique).collect()))
    assert lists[0] == lists[1] and lists[2] == lists[3] and [len(x) for x in lists[2:]] == [30 * n] * 2


def test_scores(spark):
    train = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 1, 0.25), (1, 2, 1.0)], "user_idx long, item_idx long, y float")
    items = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, 0, 0)], "item_idx long, a int, b int")
    raw = {r["user_idx"]: (r["a"], r["b"]) for r in scores.user_profiles(train, items, ("a", "b")).collect()}
    assert raw == {0: (2.0, 1.0), 1: (1.0, 2.0)}
    centered = {r["user_idx"]: (r["a"], r["b"]) for r in scores.centered_profiles(train, items, ("a", "b")).collect()}
    direct = {r["user_idx"]: (r["a"], r["b"]) for r in scores.user_profiles(train, scores.centered(items, ("a", "b")), ("a", "b")).collect()}
    assert centered == direct == {0: (1.0, 0.0), 1: (0.0, 1.0)}
    assert {r["item_idx"]: r["popularity"] for r in scores.popularity(train, items).collect()} == {0: 1.0, 1: 2.0, 2: 1.0, 3: 0.0}
    cands = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (1, 9, 0, 1)], "row_id long, user_idx long, slot int, item_idx long")
    out = {(r["row_id"], r["slot"]): r["score"] for r in scores.score_by_profile(cands, scores.user_profiles(train, items, ("a", "b")), items, ("a", "b")).collect()}
    assert out == {(0, 0): 3.0, (0, 1): 1.0, (1, 0): 0.0}
    trimmed = scores.residuals(items.withColumn("p_a", F.lit(0.99)).withColumn("p_b", F.lit(None).cast("double")), ("a", "b")).orderBy("item_idx").collect()
    assert [r["a"] for r in trimmed] == [0, 0, 0, 0] and [r["b"] for r in trimmed] == [-0.5, 0.5, 0.5, -0.5]


def test_cross_fitted_control(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(4), rng.randrange(6), rng.choice([0.0, 0.25, 0.5, 1.0])) for k in range(40)]
    own = [(i, g) for i in range(6) for g in {"g" + str(i % 2), "h" + str(i % 3)}]
    train = groups.assign_folds(spark.createDataFrame(rows, "row_key long, user_idx long, item_idx long, y float"), 3, 42)
    fold = {r["row_key"]: r["fold"] for r in train.collect()}
    got = {r["row_key"]: (r["user_oof"], r["group_oof"]) for r in groups.cross_fitted_control(train, spark.createDataFrame(own, "item_idx long, `group` string"), 3, 5.0, 2).collect()}
    for k, u, i, _ in rows:
        rest = [r for r in rows if fold[r[0]] != fold[k]]
        mean = sum(r[3] for r in rest) / len(rest)
        mine = [r for r in rest if r[1] == u]
        bias = (sum(r[3] for r in mine) + 5 * mean) / (len(mine) + 5)
        coef = 0.0
        for g in {g for x, g in own if x == i}:
            part = [r[3] - bias for r in mine if (r[2], g) in own]
            coef += sum(part) / (len(part) + 5) if len(part) >= 2 else 0.0
        assert got[k] == pytest.approx((bias, coef))


def test_binary_report_and_propensity(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.2)]
    out = groups.binary_report(spark.createDataFrame(rows, "label int, p double")).first()
    pairs = [(a > b) + 0.5 * (a == b) for la, a in rows for lb, b in rows if la == 1 and lb == 0]
    assert out["auroc"] == pytest.approx(sum(pairs) / len(pairs)) and out["brier"] == pytest.approx(sum((p - y) ** 2 for y, p in rows) / 5)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(["cream", "soap", "oil", "water"]) for _ in range(8)) + (" vegan plain" if i % 3 == 0 else " rich") + " unscented", int(i % 3 == 0)) for i in range(120)]
    p = propensity.out_of_fold(spark.createDataFrame(items, "item_idx long, item_text string, label int"), "label", ("unscented",), max_features=500, max_iter=30)
    assert p.count() == 120 and groups.binary_report(p).first()["auroc"] > 0.95


def test_propensity_by_second_implementation(spark):
    """Counts, weights and the penalized fit in numpy, by Newton's method, on the same folds."""
    rng = random.Random(9)
    pool = ["cream", "soap", "oil", "water", "aloe", "x", "shea"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(4, 12))) + (" vegan" if (i % 3 == 0) != (i % 10 == 0) else ""), int(i % 3 == 0)) for i in range(90)]
    got = {r["item_idx"]: r for r in propensity.out_of_fold(spark.createDataFrame(items, "item_idx long, item_text string, label int"), "label", ("shea",)).collect()}
    assert len(got) == 90 and Counter((r["fold"], r["label"]) for r in got.values()) == {(f, y): 10 if y else 20 for f in range(3) for y in (0.0, 1.0)}

    def terms(t):
        w = [x for x in t.replace("shea", " ").split() if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    for fold in range(3):
        train, rest = ([x for x in items if (got[x[0]]["fold"] == fold) == out] for out in (False, True))
        df = Counter(t for _, x, _ in train for t in set(terms(x)))
        at = {t: k for k, t in enumerate(sorted(t for t in df if df[t] >= 2))}
        idf = np.array([np.log((len(train) + 1) / (df[t] + 1)) for t in at])

        def features(rows, at=at, idf=idf):
            x = np.zeros((len(rows), len(at)))
            for i, (_, text_of, _) in enumerate(rows):
                for t in terms(text_of):
                    if t in at:
                        x[i, at[t]] += 1
            x *= idf
            return np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.ones((len(rows), 1))])

        x, y = features(train), np.array([label for *_, label in train], float)
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        w, ridge = np.zeros(x.shape[1]), np.append(np.full(len(at), 1 / 3), 0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-12), x.T @ (weight * (p - y)) + ridge * w)
        for (i, *_), p in zip(rest, 1 / (1 + np.exp(-features(rest) @ w)), strict=True):
            assert got[i]["p"] == pytest.approx(p, abs=2e-3)


def test_propensity_query_fits_the_whole_vocabulary(monkeypatch, spark):
    asked = {}
    whole = inspect.signature(propensity.out_of_fold)

    def noted(items, *args, **kwargs):
        bound = whole.bind(items, *args, **kwargs)
        bound.apply_defaults()
        asked.update(bound.arguments)
        return items

    monkeypatch.setattr(propensity, "out_of_fold", noted)
    queries.propensity_tfidf_lr(spark, "/root/testdata/sf0.001")
    assert (asked["max_features"], asked["min_df"], asked["max_iter"]) == (15_000, 2, 300)


def test_vector_search_ranks_all_rows_for_all_queries(monkeypatch, spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(1, 101)] + [(120, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]): (r["dot"], r["rank"]) for r in search.rank_by_dot(df.where("vec_id % 20 = 0"), df, pass_bytes=100).collect()}
    want = {}
    for q in (20, 40, 60, 80, 100):
        dots = sorted((-sum(x * y for x, y in zip(v, rows[q - 1][1], strict=True)), i) for i, v in rows if v)
        want |= {(q, i): (-d, k) for k, (d, i) in enumerate(dots, 1)}
    assert got == want
    first = {(r["query_id"], r["vec_id"]): (r["dot"], r["rank"]) for r in search.rank_by_dot(df.where("vec_id % 20 = 0"), df, top=3).collect()}
    assert first == {pair: value for pair, value in want.items() if value[1] <= 3}
    assert search.rank_by_dot(df.where("false"), df).count() == 0
    assert search.rank_by_dot(df, df.where("false")).count() == 0
    monkeypatch.setattr(queries.td, "table", lambda *_: df)
    assert {(r["query_id"], r["vec_id"]): (r["dot"], r["rank"]) for r in queries.embedding_dot_rank(spark, "").collect()} == want


def test_vector_search_of_odd_vectors(spark):
    rows = [(20, [1.0, 2.0]), (1, [1.0, None]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (None, [1.0, 1.0]), (3, [1.0]), (4, []), (5, None), (40, [2.0])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, dot string, query_id int")
    got = [tuple(r) for r in search.rank_by_dot(df.where("vec_id % 20 = 0"), df).orderBy("query_id", "rank").collect()]
    assert got == [
        (20, 2, 5.0, 1), (20, 2, 5.0, 2), (20, 20, 5.0, 3), (20, None, 3.0, 4), (20, 1, None, 5), (20, 3, None, 6), (20, 4, None, 7), (20, 40, None, 8),
        (40, 40, 4.0, 1), (40, 3, 2.0, 2), (40, None, None, 3), (40, 1, None, 4), (40, 2, None, 5), (40, 2, None, 6), (40, 4, None, 7), (40, 20, None, 8),
    ]


def test_types_beyond_the_columns_raise(monkeypatch, spark):
    rows = spark.createDataFrame([(1, 0)], "item_id long, item_idx long")
    parts = spark.range(101).selectExpr("id AS p_partkey", "'b' AS p_brand", "concat('t', id) AS p_type", "1 AS p_size", "1.0D AS p_retailprice")
    monkeypatch.setattr(queries.td, "table", lambda *_: parts)
    with pytest.raises(ValueError):
        queries.td.items_with_types(rows, spark, "")
    monkeypatch.setattr(queries.td, "table", lambda *_: parts.where("p_partkey < 100"))
    assert len(queries.td.items_with_types(rows, spark, "")[1]) == 100


def test_lines_are_numbered_by_file_name_and_place(spark, tmp_path):
    """Files that are packed largest first, and one that is cut into many blocks."""
    many = [json.dumps({"user_id": "u", "parent_asin": "i", "rating": 1, "timestamp": n}) for n in range(3_000)]
    parts = {"a x.json": many[:1], "b.json": many[1:4], "c.json": many[4:2_900], "d.json": many[2_900:]}
    for name, lines in parts.items():
        (tmp_path / name).write_text("\n\n".join(lines) + "\n")
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (most, "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = tables.read_reviews(spark, str(tmp_path)).select("source_row", "ts").collect()
            assert [r["ts"] for r in sorted(rows)] == list(range(3_000)) and len({r["source_row"] for r in rows}) == 3_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_manifest_of_files_of_any_size(spark, tmp_path, monkeypatch):
    for name, size in (("a", 3), ("b c", 900), ("d", 0)):
        (tmp_path / name).write_bytes(name.encode()[:1] * size)
    want = sorted((r["path"], r["size"], r["sha256"]) for r in tables.file_manifest(spark, str(tmp_path)).collect())
    monkeypatch.setattr(tables, "WHOLE_FILE", 100)
    assert sorted((r["path"], r["size"], r["sha256"]) for r in tables.file_manifest(spark, str(tmp_path)).collect()) == want and len(want) == 2


def test_sources_and_reports(spark, tmp_path):
    reviews = [{"user_id": "u", "parent_asin": "i", "rating": 5, "timestamp": 10}, {"user_id": "u", "parent_asin": "i", "rating": "4.0", "timestamp": 11.9}, {"user_id": None, "parent_asin": "i", "rating": 1, "timestamp": 1}, {"user_id": "u", "parent_asin": "i", "rating": "x", "timestamp": 1}]
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write("\n\n".join(map(json.dumps, reviews)))
    got = [tuple(r) for r in tables.read_reviews(spark, str(tmp_path / "r.jsonl.gz")).orderBy("source_row").collect()]
    assert got == [(0, "u", "i", 5.0, 10), (2, "u", "i", 4.0, 11)]
    with gzip.open(tmp_path / "m.jsonl.gz", "wt") as f:
        f.write(json.dumps({"parent_asin": "i", "title": "Soap", "store": "S", "categories": ["A", None, "B"], "features": ["f1", "f2"], "details": {"Brand": "X"}, "price": "$3.50"}) + "\n" + json.dumps({"title": "no id"}))
    item = tables.read_items(spark, str(tmp_path / "m.jsonl.gz")).collect()
    assert len(item) == 1 and item[0]["categories"] == ["A", "B"] and item[0]["price_num"] == 3.5 and item[0]["item_text"] == "soap s a b f1 f2 brand x"
    odd = [{"title": "1.50", "price": 1e9}, {"title": "null", "price": 0.0001, "details": ' {"B": {"C": ["fragrance  free", 2]}} '}, {"price": -3.5, "details": "loose  words"}, {"price": "-3.5", "features": "[1]", "details": ["q"]}, {"price": "none", "description": [["Deep", ["er"]]]}]
    (tmp_path / "odd.jsonl").write_text("\n".join(json.dumps({"parent_asin": f"i{k}"} | x) for k, x in enumerate(odd)))
    got = {r["item_id"]: (r["price_num"], r["item_text"]) for r in tables.read_items(spark, str(tmp_path / "odd.jsonl")).collect()}
    assert got == {"i0": (1e9, "1.50"), "i1": (0.0001, "null b c fragrance free 2"), "i2": (-3.5, "raw_details loose words"), "i3": (3.5, '[1] raw_details ["q"]'), "i4": (None, "deep er")}
    (tmp_path / "odd.jsonl").unlink()
    (tmp_path / "s.csv").write_text("movieId,tagId,relevance\n1,7,0.9\n1,8,0.1\n2,8,0.7\n")
    (tmp_path / "t.csv").write_text("tagId,tag\n7,action\n8,classic\n")
    attrs = tables.tag_attributes(tables.read_csv(spark, str(tmp_path / "s.csv"), tables.TAG_SCORES), tables.read_csv(spark, str(tmp_path / "t.csv"), tables.TAGS), ["classic", "action"])
    assert {r["movieId"]: (r["attr_0"], r["attr_1"]) for r in attrs.collect()} == {1: (0.0, 1.0), 2: (1.0, 0.0)}
    assert tables.file_manifest(spark, str(tmp_path)).count() == 4
    a = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "policy string, mrr double")
    b = spark.createDataFrame([("p", 1.5)], "policy string, mrr double")
    assert {r["policy"]: r["status"] for r in report.compare(a, b, ("policy",), ("mrr",), 0.1).collect()} == {"p": "fail", "q": "missing"}
    assert {r["policy"]: r["mrr"] for r in report.prefer([b, a], ("policy",)).collect()} == {"p": 1.5, "q": 2.0}
    assert tables.table_checksum(a).first()["n"] == 2 and "pyspark" in tables.runtime_manifest()
