"""Whole experiments from raw files to tables of metrics, and their replay from what they froze.

A run writes below its folder: settings.json, the stages' tables (interactions, items, and so on), candidates (the
scored lists, a partition per score family), metrics_by_policy, randomized, randomized_summary and diagnostics as CSV,
run_summary.json, runtime_manifest.json, and manifest (digest and size of each of these files)."""

from __future__ import annotations

import time
import tomllib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listrank.functions.text import LABELS, has_label, normalize, price_bucket, scaled_rating
from listrank.operators import diagnostics, groups, metrics, prep, propensity, report, sampling, scores, validate
from listrank.operators.ranking import KEYED, TiePolicy
from listrank.sources import tables

ANALYTIC = "analytic_uniform_tie_expectation"
METRICS = "policy STRING, k INT, n_rows BIGINT, hit_at_k DOUBLE, ndcg_at_k DOUBLE, mrr DOUBLE, score STRING"
SUMMARY = "metric STRING, mean DOUBLE, sd DOUBLE, se DOUBLE, min DOUBLE, max DOUBLE, score STRING"
PER_SEED = "seed BIGINT, n_rows BIGINT, hit_at_k DOUBLE, ndcg_at_k DOUBLE, mrr DOUBLE, score STRING"


@dataclass(frozen=True)
class Evaluation:
    """Lists and their evaluation."""

    negatives: int = 30
    k: int = 10
    key_seed: int = 20_260_316
    repetitions: int = 20
    seed_start: int = 20_270_000
    sample_seed: int = 42


@dataclass(frozen=True)
class Ratings:
    """Ratings with tag relevances: positive ratings, split at points in time."""

    #: The tags.
    tags: tuple[str, ...] = ("action", "classic", "visually appealing", "based on a book", "violence", "sci-fi")
    least_rating: float = 4.0
    tag_threshold: float = 0.7
    train: float = 0.8
    validation: float = 0.1
    most_users: int = 10_000


@dataclass(frozen=True)
class Reviews:
    """Reviews with item texts: a core, each user's last two rows held out, labels, propensities, group control."""

    k_user: int = 3
    k_item: int = 3
    most_rounds: int = 25
    #: The labels.
    labels: tuple[str, ...] = ("fragrance_free", "cruelty_free", "sulfate_free")
    folds: int = 3
    max_features: int = 15_000
    min_df: int = 2
    c: float = 3.0
    max_iter: int = 300
    trim_above: float = 0.95
    smoothing: float = 5.0
    least_user_group: int = 2
    least_support: int = 10
    seed: int = 42
    unique_negatives: bool = False
    group_control: bool = True
    most_rows: int | None = None


def metrics_of(candidates: DataFrame, score: str, evaluation: Evaluation) -> DataFrame:
    """The three keyed policies' metrics and the analytic expectation of one family."""
    k = evaluation.k
    expected = metrics.expected_metrics(candidates, k).withColumn("policy", F.lit(ANALYTIC)).withColumn("k", F.lit(k))
    found = metrics.evaluate(candidates, KEYED, evaluation.key_seed, (k,)).unionByName(expected)
    return found.withColumn("score", F.lit(score)).select(*[f.split()[0] for f in METRICS.split(", ")])


def diagnostics_of(candidates: DataFrame, score: str, evaluation: Evaluation) -> DataFrame:
    """How tied a family is, and what changes from input order to the hardened keys; one row."""
    ties = diagnostics.tie_diagnostics(candidates, evaluation.k)
    moves = diagnostics.policy_difference(candidates, TiePolicy.STABLE, TiePolicy.HARDENED, evaluation.k, evaluation.key_seed)
    return ties.join(moves, "n_rows").withColumn("score", F.lit(score))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _begin(spark: SparkSession, out: str, settings: dict, resume: bool) -> float:
    if resume and tables.path_exists(spark, f"{out}/settings.json"):
        if tables.read_json(spark, f"{out}/settings.json") != settings:
            raise ValueError(f"{out} was begun with other settings")
    tables.write_json(spark, f"{out}/settings.json", settings)
    return time.time()


def _evaluate(spark: SparkSession, out: str, families: dict[str, DataFrame], evaluation: Evaluation, counts: dict, began: float) -> dict:
    """Freezes each family's lists, evaluates what was frozen, and writes the run's tables."""
    found, repeated, ties, audits = [], [], [], []
    for score, candidates in families.items():
        path = f"{out}/candidates/score_name={score}"
        candidates.write.mode("overwrite").option("compression", "zstd").parquet(path)
        lists = spark.read.parquet(path)
        validate.require(lists, evaluation.k, diagnostics=True)
        if short := sampling.incomplete_rows(lists, evaluation.negatives + 1).count():
            raise ValueError(f"{score}: {short} lists have not {evaluation.negatives + 1} candidates")
        found.append(metrics_of(lists, score, evaluation))
        ties.append(diagnostics_of(lists, score, evaluation))
        audits.append(diagnostics.contract_audit(lists, evaluation.k, evaluation.key_seed).withColumn("score", F.lit(score)))
        if evaluation.repetitions:
            repeated.append(metrics.repeated_metrics(lists, evaluation.repetitions, evaluation.seed_start, evaluation.k).withColumn("score", F.lit(score)))
    tables.write_table(_union(found), f"{out}/metrics_by_policy")
    tables.write_table(_union(ties), f"{out}/diagnostics")
    tables.write_table(_union(audits), f"{out}/audit")
    if repeated:
        tables.write_table(_union(repeated).select(*[f.split()[0] for f in PER_SEED.split(", ")]), f"{out}/randomized")
        per_seed = spark.read.csv(f"{out}/randomized", header=True, schema=PER_SEED)
        tables.write_table(_union([metrics.summarize(per_seed.where(F.col("score") == s)).withColumn("score", F.lit(s)) for s in families]), f"{out}/randomized_summary")
        summaries = spark.read.csv(f"{out}/randomized_summary", header=True, schema=SUMMARY)
        recorded = spark.read.csv(f"{out}/metrics_by_policy", header=True, schema=METRICS)
        tables.write_table(report.policy_report(recorded, summaries, (*map(str, KEYED), ANALYTIC)), f"{out}/policy_report")
    summary = {"dataset": counts, "score_families": list(families), "runtime_seconds": round(time.time() - began, 3)}
    tables.write_json(spark, f"{out}/run_summary.json", summary)
    tables.write_json(spark, f"{out}/runtime_manifest.json", tables.runtime_manifest())
    write_manifest(spark, out)
    return summary


def write_manifest(spark: SparkSession, out: str) -> None:
    tables.delete(spark, f"{out}/manifest")  # an earlier one would be listed, and replaced while it is read
    tables.write_table(own_files(spark, out), f"{out}/manifest")


def own_files(spark: SparkSession, out: str) -> DataFrame:
    """name, size, sha256 of a run's files, named from its folder; not of the manifest, nor of replays."""
    name = F.regexp_extract("path", r"^.*?/" + out.rstrip("/").rsplit("/", 1)[-1].replace(".", r"\.") + "/(.*)$", 1)
    return tables.file_manifest(spark, out).select(name.alias("name"), "size", "sha256").where("name NOT LIKE 'manifest/%' AND name NOT LIKE 'replay/%'")


def changed_files(spark: SparkSession, out: str) -> DataFrame:
    """name, status (missing, changed or added) of the files that are not as the run's manifest says."""
    recorded = spark.read.csv(f"{out}/manifest", header=True, schema="name STRING, size BIGINT, sha256 STRING")
    now = own_files(spark, out).select(F.col("name").alias("_name"), F.col("size").alias("_size"), F.col("sha256").alias("_sha256"))
    both = recorded.join(now, F.col("name") == F.col("_name"), "full")
    status = F.when(F.col("_name").isNull(), "missing").when(F.col("name").isNull(), "added").when((F.col("sha256") != F.col("_sha256")) | (F.col("size") != F.col("_size")), "changed")
    return both.select(F.coalesce("name", "_name").alias("name"), status.alias("status")).where("status IS NOT NULL")


def run_ratings(spark: SparkSession, folder: str, out: str, ratings: Ratings = Ratings(), evaluation: Evaluation = Evaluation(key_seed=20_260_318), resume: bool = False) -> dict:
    """From ratings.csv, genome-tags.csv and genome-scores.csv.

    Positive ratings of tagged movies; ids by first appearance in the file; rows split at two points in time (ties in
    time by file order); of the first `most_users` users of the test part, the first row each; negatives drawn without
    repeats among what the user's training rows lack. Families: raw_count, centered_count, popularity."""
    began = _begin(spark, out, {"ratings": asdict(ratings) | {"tags": list(ratings.tags)}, "evaluation": asdict(evaluation)}, resume)
    attrs = [f"attr_{i}" for i in range(len(ratings.tags))]

    def attributes() -> DataFrame:
        found = tables.read_csv(spark, f"{folder}/genome-scores.csv", tables.TAG_SCORES)
        return tables.tag_attributes(found, tables.read_csv(spark, f"{folder}/genome-tags.csv", tables.TAGS), list(ratings.tags), ratings.tag_threshold)

    movies = tables.stored(spark, f"{out}/movies", attributes, resume)

    def interactions() -> DataFrame:
        rows = tables.source_rows(tables.read_csv(spark, f"{folder}/ratings.csv", tables.RATINGS))
        rows = tables.checkpointed(rows.where(F.col("rating") >= ratings.least_rating).join(movies.select("movieId"), "movieId", "left_semi"))
        users = prep.first_appearance_ids(rows, "userId", [F.col("source_row")], "user_idx")
        items = prep.first_appearance_ids(rows, "movieId", [F.col("source_row")], "item_idx")
        numbered = rows.join(users, "userId").join(items, "movieId").withColumnRenamed("timestamp", "ts")
        return prep.global_time_split(numbered, F.col("ts"), F.col("source_row"), train=ratings.train, validation=ratings.validation)

    rows = tables.stored(spark, f"{out}/interactions", interactions, resume)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    items = tables.stored(spark, f"{out}/items", lambda: rows.select("movieId", "item_idx").distinct().join(movies, "movieId"), resume)
    targets = prep.first_targets(test, ratings.most_users).select(F.col("user_idx").alias("row_id"), "user_idx", "item_idx")
    targets = tables.stored(spark, f"{out}/targets", lambda: targets, resume)
    n_items = items.count()
    lists = tables.stored(spark, f"{out}/lists", lambda: sampling.sample_candidates(targets, sampling.history(train), n_items, evaluation.negatives, evaluation.sample_seed, unique=True), resume)
    families = {
        "raw_count": scores.score_by_profile(lists, scores.user_profiles(train, items, attrs), items, attrs),
        "centered_count": scores.score_by_profile(lists, scores.centered_profiles(train, items, attrs), scores.centered(items, attrs), attrs),
        "popularity": scores.score_by_item(lists, scores.popularity(train, items), "popularity"),
    }
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    summary = {"n_users": rows.select("user_idx").distinct().count(), "n_items": n_items, "n_train": counts.get("train", 0), "n_validation": counts.get("validation", 0), "n_test": targets.count()}
    return _evaluate(spark, out, families, evaluation, summary, began)


def item_group_columns() -> list:
    """Store, main category, the first three categories and price bucket of an item, as group names."""
    listed = [groups.prefixed("category", normalize(F.get("categories", F.lit(i)))) for i in range(3)]
    return [groups.prefixed("store", normalize(F.col("store"))), groups.prefixed("main_category", normalize(F.col("main_category"))), *listed, price_bucket(F.col("price_num"))]


def run_reviews(spark: SparkSession, reviews_path: str, items_path: str, out: str, reviews: Reviews = Reviews(), evaluation: Evaluation = Evaluation(), stage: str = "all", resume: bool = False) -> dict:
    """From reviews and item metadata as lines of JSON. Stage preprocess ends with the split tables and model with the
    propensities and the control.

    Of equal (user, item, time) and of equal items the last line stays; reviews of unknown items go; a k-core; ids in
    order; each user's last row is the test row and the one before is for validation; item labels from texts. Families:
    raw_count, centered_count, residualized_group_control, item_residual_only."""
    if stage not in ("preprocess", "model", "all"):
        raise ValueError(f"unknown stage {stage}")
    began = _begin(spark, out, {"reviews": asdict(reviews) | {"labels": list(reviews.labels)}, "evaluation": asdict(evaluation)}, resume)
    said = tables.stored(spark, f"{out}/reviews", lambda: prep.last_wins(tables.read_reviews(spark, reviews_path), ("user_id", "item_id", "ts"), ("source_row",)), resume)
    metadata = tables.stored(spark, f"{out}/metadata", lambda: prep.last_wins(tables.read_items(spark, items_path), ("item_id",), ("source_row",)), resume)

    def interactions() -> DataFrame:
        core, history = prep.k_core(prep.known_items(said, metadata), reviews.k_user, reviews.k_item, most_rounds=reviews.most_rounds)
        tables.write_json(spark, f"{out}/kcore_history.json", [{"round": r, "before": a, "after": b} for r, a, b in history])
        users, items = prep.dense_ids(core, "user_id", "user_idx"), prep.dense_ids(core, "item_id", "item_idx")
        numbered = core.join(users, "user_id").join(items, "item_id").withColumn("y", scaled_rating(F.col("rating")))
        return tables.by_user(prep.leave_last_two(numbered, "user_idx", ("ts", "item_id", "source_row")))

    rows = tables.stored(spark, f"{out}/interactions", interactions, resume)

    def catalogue() -> DataFrame:
        known = rows.select("item_id", "item_idx").distinct().join(prep.item_statistics(rows), "item_id").join(metadata.drop("source_row"), "item_id")
        return known.withColumns({f"label__{n}": has_label(F.col("item_text"), LABELS[n].patterns) for n in reviews.labels})

    items = tables.stored(spark, f"{out}/items", catalogue, resume)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    n_items = items.count()
    summary = {"n_users": rows.select("user_idx").distinct().count(), "n_items": n_items, **{f"n_{s}": counts.get(s, 0) for s in ("train", "validation", "test")}}
    if stage == "preprocess":
        return {"dataset": summary, "stage": stage}

    train, attrs = rows.where("split = 'train'"), list(reviews.labels)

    def propensities() -> DataFrame:
        wide = items.select("item_idx", *[F.col(f"label__{n}").alias(n) for n in attrs])
        for n in attrs:
            p = propensity.out_of_fold(items, f"label__{n}", LABELS[n].mask_terms, reviews.folds, reviews.seed, reviews.max_features, reviews.min_df, reviews.c, reviews.max_iter)
            wide = wide.join(p.select("item_idx", F.col("p").alias(f"p_{n}")), "item_idx", "left")
        return wide

    labelled = tables.stored(spark, f"{out}/propensities", propensities, resume)
    _reports = [groups.binary_report(labelled.select(F.col(n).alias("label"), F.col(f"p_{n}").alias("p"))).withColumn("label", F.lit(n)) for n in attrs]
    tables.write_table(_union(_reports), f"{out}/propensity_report")
    if reviews.group_control:

        def control() -> DataFrame:
            folded = groups.assign_folds(train.withColumn("row_key", F.col("source_row")).select("row_key", "user_idx", "item_idx", "y"), reviews.folds, reviews.seed)
            return groups.cross_fitted_control(tables.checkpointed(folded), groups.item_groups(items, item_group_columns(), reviews.least_support), reviews.folds, reviews.smoothing, reviews.least_user_group)

        controlled = tables.stored(spark, f"{out}/group_control", control, resume)
    if stage == "model":
        return {"dataset": summary, "stage": stage}

    test = rows.where("split = 'test'").select(F.col("user_idx").alias("row_id"), "user_idx", "item_idx")
    targets = test if reviews.most_rows is None else test.orderBy("row_id").limit(reviews.most_rows)
    targets = tables.stored(spark, f"{out}/targets", lambda: targets, resume)
    lists = tables.stored(spark, f"{out}/lists", lambda: sampling.sample_candidates(targets, sampling.history(rows.where("split <> 'test'")), n_items, evaluation.negatives, evaluation.sample_seed, reviews.unique_negatives), resume)
    residual = scores.residuals(labelled, attrs, trim_above=reviews.trim_above)
    families = {
        "raw_count": scores.score_by_profile(lists, scores.user_profiles(train, labelled, attrs, F.col("y")), labelled, attrs),
        "centered_count": scores.score_by_profile(lists, scores.centered_profiles(train, labelled, attrs, F.col("y")), scores.centered(labelled, attrs), attrs),
    }
    if reviews.group_control:
        left = F.col("y").cast("double") - F.col("user_oof") - F.col("group_oof")
        families["residualized_group_control"] = scores.score_by_profile(lists, scores.user_profiles(controlled, residual, attrs, left), residual, attrs)
    families["item_residual_only"] = scores.score_by_profile(lists, scores.user_profiles(train, residual, attrs, F.col("y")), residual, attrs)
    return _evaluate(spark, out, families, evaluation, summary | {"n_evaluated": targets.count()}, began)


def replay(spark: SparkSession, out: str, tolerance: float = 1e-12) -> dict:
    """Evaluates the frozen lists again, and compares with what the run recorded; writes replay/metrics_by_policy and
    replay/comparison. The status is pass if every recorded figure is found again and none is new."""
    settings = tables.read_json(spark, f"{out}/settings.json")
    evaluation = Evaluation(**settings["evaluation"])
    recorded = spark.read.csv(f"{out}/metrics_by_policy", header=True, schema=METRICS)
    frozen = tables.frozen(spark, f"{out}/candidates")
    names = [r[0] for r in frozen.select("score_name").distinct().orderBy("score_name").collect()]
    again = [metrics_of(frozen.where(F.col("score_name") == n).drop("score_name"), n, evaluation) for n in names]
    tables.write_table(_union(again), f"{out}/replay/metrics_by_policy")
    replayed = spark.read.csv(f"{out}/replay/metrics_by_policy", header=True, schema=METRICS)
    compared = report.compare(recorded, replayed, ("score", "policy", "k"), tolerance=tolerance)
    tables.write_table(compared, f"{out}/replay/comparison")
    worst = compared.agg(F.max("max_abs_diff").alias("diff"), F.count_if(F.col("status") != "pass").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    good = worst["bad"] == 0 and worst["n"] == replayed.count() == len(names) * (len(KEYED) + 1)
    result = {"status": "pass" if good else "fail", "compared": worst["n"], "max_abs_diff": worst["diff"], "scores": names}
    tables.write_json(spark, f"{out}/replay/replay.json", result)
    return result


def expected_figures(spark: SparkSession, out: str, path: str, tolerance: float) -> DataFrame:
    """score, policy, quantity, expected, actual, abs_diff, status of each line of a CSV (score, policy, quantity,
    value): quantity is a column of metrics_by_policy, or of diagnostics where policy is empty, or a count of the data
    set where both are. Counts must be met exactly; a figure that the run has not is missing."""
    wanted = spark.read.csv(path, header=True, schema="score STRING, policy STRING, quantity STRING, value DOUBLE")

    def long(df: DataFrame, keys: list[str]) -> DataFrame:
        values = [c for c, kind in df.dtypes if c not in ("score", "policy", "k") and kind != "string"]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("quantity"), F.col(c).cast("double").alias("value")) for c in values])).alias("c")
        kept = df.select(*[F.col(x) if x in keys else F.lit(None).cast("string").alias(x) for x in ("score", "policy")], cells)
        return kept.select("score", "policy", "c.*")

    found = long(spark.read.csv(f"{out}/metrics_by_policy", header=True, schema=METRICS), ["score", "policy"])
    found = found.unionByName(long(spark.read.csv(f"{out}/diagnostics", header=True, inferSchema=True), ["score"]))
    counts = [(None, None, name, float(n)) for name, n in tables.read_json(spark, f"{out}/run_summary.json")["dataset"].items()]
    found = found.unionByName(spark.createDataFrame(counts, found.schema))
    checked = report.within(wanted, found, ("score", "policy", "quantity"), tolerance)
    exact = F.col("score").isNull() & F.col("policy").isNull() & (F.col("abs_diff") > 0)
    return checked.withColumn("status", F.when(exact, "fail").otherwise(F.col("status")))


def read_settings(path: str) -> dict:
    """Settings of a run from a TOML file: tables evaluation, and ratings or reviews, of the fields of Evaluation, Ratings
    and Reviews. A name that no field has raises."""
    with open(path, "rb") as f:
        said = tomllib.load(f)
    kinds = {"evaluation": Evaluation, "ratings": Ratings, "reviews": Reviews}
    out = {}
    for name, values in said.items():
        if name not in kinds:
            raise ValueError(f"{path}: unknown table {name}")
        if unknown := set(values) - {f.name for f in fields(kinds[name])}:
            raise ValueError(f"{path}: unknown settings of {name}: {sorted(unknown)}")
        out[name] = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return out


def list_contract(lists: DataFrame, seed: int) -> DataFrame:
    """One row: n_rows, misplaced_positives (not exactly in slot 0), changed_rows (lists whose hardened order depends on
    slots)."""
    moved = diagnostics.permutation_changes(lists, (TiePolicy.HARDENED,), seed).select("n_rows", "changed_rows")
    wrong = lists.agg(F.countDistinct("row_id").alias("n_rows"), F.count_if(F.col("is_positive") != (F.col("slot") == 0)).alias("misplaced_positives"))
    return wrong.join(moved, "n_rows")


def contract(spark: SparkSession, out: str) -> DataFrame:
    """score_name and the list_contract of each frozen family; lists that can't be evaluated raise."""
    evaluation = Evaluation(**tables.read_json(spark, f"{out}/settings.json")["evaluation"])
    frozen = tables.frozen(spark, f"{out}/candidates")
    parts = []
    for name in [r[0] for r in frozen.select("score_name").distinct().orderBy("score_name").collect()]:
        lists = frozen.where(F.col("score_name") == name).drop("score_name")
        validate.require(lists, evaluation.k)
        parts.append(list_contract(lists, evaluation.key_seed).select(F.lit(name).alias("score_name"), "*"))
    return _union(parts)


def smoke(spark: SparkSession) -> dict:
    """Facts that hold for any right evaluator: an all-tied list, slots permuted, and lists without ties."""
    tied = spark.range(31).select(F.lit(0).cast("long").alias("row_id"), F.lit(7).cast("long").alias("user_idx"), F.col("id").cast("int").alias("slot"), F.col("id").alias("item_idx"), (F.col("id") == 0).alias("is_positive"), F.lit(0.0).cast("float").alias("score"))
    stable = metrics.evaluate(tied, (TiePolicy.STABLE,)).first()
    expected = metrics.expected_metrics(tied).first()
    many = spark.range(50 * 31).select((F.col("id") / 31).cast("long").alias("row_id"), (F.col("id") % 31).alias("item_idx"))
    many = many.select("row_id", F.col("row_id").alias("user_idx"), F.col("item_idx").cast("int").alias("slot"), "item_idx", (F.col("item_idx") == 0).alias("is_positive"))
    few = many.withColumn("score", F.pmod(F.xxhash64("row_id", "item_idx"), F.lit(4)).cast("float"))
    moved = diagnostics.permutation_changes(few, (TiePolicy.HARDENED,)).first()["changed_rows"]
    strict = diagnostics.policy_difference(many.withColumn("score", (-F.col("item_idx")).cast("float")), TiePolicy.STABLE, TiePolicy.HARDENED).first()
    facts = {
        "all_tied_stable_hit": stable["hit_at_k"] == 1.0 and stable["ndcg_at_k"] == 1.0, "all_tied_expected_hit": abs(expected["hit_at_k"] - 10 / 31) <= 1e-12,
        "all_tied_expected_ndcg": abs(expected["ndcg_at_k"] - 0.1465664303) <= 1e-9, "hardened_ignores_slots": moved == 0, "strict_scores_ignore_policy": strict["positive_rank_change_rate"] == 0.0,
    }
    return {"status": "pass" if all(facts.values()) else "fail", **facts}
