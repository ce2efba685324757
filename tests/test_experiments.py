"""Whole runs from raw files, their replay, verification, downloads and the command line."""

import gzip
import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from listrank import __main__ as command
from listrank.operators import report
from listrank.plans import experiments
from listrank.sources import download, tables


def write_ratings(folder):
    """Movies 1 to 6 by users 1 to 6 in 24 training, 3 validation and 3 test rows; one low rating, one untagged movie."""
    rng, rows, now = random.Random(5), [], 100
    for user in range(1, 7):
        for movie in rng.sample(range(1, 7), 4):
            rows.append((user, movie, 5.0, now))
            now += 1
    seen = {u: {m for v, m, _, _ in rows if v == u} for u in range(1, 7)}
    for user in (1, 2, 3, 4, 5, 6):
        rows.append((user, min(set(range(1, 7)) - seen[user]), 4.0, now))
        now += 1
    rows.insert(3, (9, 1, 3.5, 1))
    rows.insert(9, (1, 77, 5.0, 2))
    (folder / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{u},{m},{r},{t}\n" for u, m, r, t in rows))
    (folder / "genome-tags.csv").write_text("tagId,tag\n1,action\n2,classic\n")
    (folder / "genome-scores.csv").write_text("movieId,tagId,relevance\n" + "".join(f"{m},1,{0.9 if m % 2 else 0.1}\n{m},2,{0.9 if m <= 3 else 0.1}\n" for m in range(1, 7)))
    return rows


def test_ratings_run(spark, tmp_path):
    rows = [r for r in write_ratings(tmp_path) if r[2] >= 4 and r[1] <= 6]
    out, settings = str(tmp_path / "run"), experiments.Ratings(("action", "classic"), most_users=2)
    evaluation = experiments.Evaluation(1, 1, 20_260_318, 3)
    got = experiments.run_ratings(spark, str(tmp_path), out, settings, evaluation)
    assert got["dataset"] == {"n_users": 6, "n_items": 6, "n_train": 24, "n_validation": 3, "n_test": 2}
    users, items = ({v: i for i, v in enumerate(dict.fromkeys(r[k] for r in rows))} for k in (0, 1))
    late = sorted(rows, key=lambda r: r[3])
    targets = {r["user_idx"]: r["item_idx"] for r in spark.read.parquet(f"{out}/targets").collect()}
    assert targets == {users[u]: items[m] for u, m, _, _ in late[27:29]}
    frozen = spark.read.parquet(f"{out}/candidates").collect()
    history = {(users[u], items[m]) for u, m, _, _ in late[:24]}
    label = {items[m]: (float(m % 2), float(m <= 3)) for m in range(1, 7)}
    for r in frozen:
        assert r["is_positive"] == (r["slot"] == 0) == (targets[r["user_idx"]] == r["item_idx"]) and (r["is_positive"] or (r["user_idx"], r["item_idx"]) not in history)
        mine = [label[i] for u, i in history if u == r["user_idx"]]
        if r["score_name"] == "raw_count":
            assert r["score"] == sum(sum(x[k] for x in mine) * label[r["item_idx"]][k] for k in (0, 1))
        if r["score_name"] == "popularity":
            assert r["score"] == sum(i == r["item_idx"] for _, i in history)
    found = spark.read.csv(f"{out}/metrics_by_policy", header=True, schema=experiments.METRICS)
    assert found.count() == 12 and {r["policy"] for r in found.collect()} == {"stable_positive_first", "archived_float32", "hardened_uint64", experiments.ANALYTIC}
    assert spark.read.csv(f"{out}/randomized", header=True).count() == 9 and spark.read.csv(f"{out}/diagnostics", header=True).count() == 3
    again = experiments.replay(spark, out)
    assert again["status"] == "pass" and again["compared"] == 12 and again["max_abs_diff"] <= 1e-12
    assert all(not r["misplaced_positives"] and not r["changed_rows"] for r in experiments.contract(spark, out).collect())
    assert experiments.changed_files(spark, out).count() == 0
    before = sorted(map(tuple, frozen))
    experiments.run_ratings(spark, str(tmp_path), out, settings, evaluation, resume=True)
    assert sorted(map(tuple, spark.read.parquet(f"{out}/candidates").collect())) == before
    with pytest.raises(ValueError):
        experiments.run_ratings(spark, str(tmp_path), out, experiments.Ratings(("action",)), evaluation, resume=True)
    tables.write_json(spark, f"{out}/run_summary.json", {})
    (tmp_path / "run" / "extra.txt").write_text("x")
    assert {tuple(r) for r in experiments.changed_files(spark, out).collect()} == {("run_summary.json", "changed"), ("extra.txt", "added")}


def test_reviews_run(spark, tmp_path):
    lines = []
    for user in range(6):
        for step in range(5):
            lines.append({"user_id": f"u{user}", "parent_asin": f"i{(user + step) % 6}", "rating": 1 + (user * step) % 5, "timestamp": 10 * step + user})
    lines.append({"user_id": "u0", "parent_asin": "i0", "rating": 5, "timestamp": 0})  # replaces the first line
    lines.append({"user_id": "u0", "parent_asin": "unknown", "rating": 5, "timestamp": 1})
    with gzip.open(tmp_path / "reviews.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, lines)))
    texts = ["fragrance-free cream", "cruelty free soap", "sulfate free wash", "a plain cream", "unscented vegan soap", "leaping bunny oil"]
    with gzip.open(tmp_path / "meta.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps({"parent_asin": f"i{k}", "title": t, "store": f"S{k % 2}", "main_category": "Beauty", "categories": ["Skin", "Care"], "price": 5 * k}) for k, t in enumerate(texts)))
    out = str(tmp_path / "run")
    settings = experiments.Reviews(folds=2, max_features=100, min_df=1, c=1.0, max_iter=20, smoothing=2.0, least_user_group=1, least_support=1)
    arguments = (spark, str(tmp_path / "reviews.jsonl.gz"), str(tmp_path / "meta.jsonl.gz"), out, settings, experiments.Evaluation(1, 1, repetitions=2))
    want = {"n_users": 6, "n_items": 6, "n_train": 18, "n_validation": 6, "n_test": 6}
    assert experiments.run_reviews(*arguments, stage="preprocess") == {"dataset": want, "stage": "preprocess"}
    got = experiments.run_reviews(*arguments, resume=True)
    assert got["dataset"] == want | {"n_evaluated": 6}
    assert got["score_families"] == ["raw_count", "centered_count", "residualized_group_control", "item_residual_only"]
    rows = spark.read.parquet(f"{out}/interactions").where("user_id = 'u0'").orderBy("within_user_rank").collect()
    assert [(r["item_id"], r["split"]) for r in rows] == [("i0", "train"), ("i1", "train"), ("i2", "train"), ("i3", "validation"), ("i4", "test")] and rows[0]["y"] == 1.0
    labels = {r["item_id"]: (r["label__fragrance_free"], r["label__cruelty_free"], r["label__sulfate_free"]) for r in spark.read.parquet(f"{out}/items").collect()}
    assert labels == {"i0": (1, 0, 0), "i1": (0, 1, 0), "i2": (0, 0, 1), "i3": (0, 0, 0), "i4": (1, 0, 0), "i5": (0, 1, 0)}
    assert spark.read.parquet(f"{out}/group_control").count() == 18
    assert experiments.replay(spark, out)["status"] == "pass"
    with pytest.raises(ValueError):
        experiments.run_reviews(*arguments, stage="other")


def test_download(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "a\n1\n")
    url, target = (tmp_path / "a.zip").as_uri(), str(tmp_path / "raw" / "a.zip")
    md5 = hashlib.md5((tmp_path / "a.zip").read_bytes()).hexdigest()
    with pytest.raises(ValueError):
        download.fetch(url, target, "0" * 32, "md5")
    assert not (tmp_path / "raw" / "a.zip").exists() and not (tmp_path / "raw" / "a.zip.part").exists()
    assert download.fetch(url, target, md5.upper(), "md5") == md5
    (tmp_path / "a.zip").unlink()
    assert download.fetch(url, target, md5, "md5") == md5  # used again
    assert download.unpack(target, str(tmp_path / "got")) == ["d/x.csv"] and (tmp_path / "got" / "d" / "x.csv").exists()
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../out.csv", "")
    with pytest.raises(ValueError):
        download.unpack(str(tmp_path / "b.zip"), str(tmp_path / "got"))


def test_data_sets(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "a\n1\n")
    md5 = hashlib.md5((tmp_path / "a.zip").read_bytes()).hexdigest()
    (tmp_path / "a.zip.md5").write_text(f"MD5 (a.zip) = {md5}\n")
    (tmp_path / "r.gz").write_text("r")
    known = {"x": {"url": (tmp_path / "a.zip").as_uri(), "md5_url": (tmp_path / "a.zip.md5").as_uri(), "md5": md5, "folder": "d", "files": ("x.csv",)}}
    to = str(tmp_path / "raw")
    got = download.data_set("x", to, archives=known)
    assert got["files"] == [{"path": "d/x.csv", "bytes": 4, "sha256": hashlib.sha256(b"a\n1\n").hexdigest()}] and json.loads((tmp_path / "raw/download.json").read_text()) == got
    assert download.data_set("r", to, files={"r": ((tmp_path / "r.gz").as_uri(),)})["files"][0]["bytes"] == 1
    for change in ({"md5": "0" * 32}, {"files": ("x.csv", "y.csv")}):
        with pytest.raises(ValueError):
            download.data_set("x", to, force=True, archives={"x": known["x"] | change})
    with pytest.raises(ValueError):
        download.data_set("none", to)


def test_cross_domain(spark):
    def t(*rows):
        return spark.createDataFrame(rows, "dataset string, score string, metric string, stable double, keyed double")

    out = report.cross_domain([("new", t(("a", "s", "n", 0.5, 0.25))), ("old", t(("a", "s", "n", 0.9, 0.1), ("b", "s", "n", 0.75, 0.5)))]).collect()
    assert {(r["dataset"], r["change"], r["source"]) for r in out} == {("a", -0.25, "new"), ("b", -0.25, "old")}


def test_reports(spark):
    metrics = spark.createDataFrame([("s", "a", 0.8474), ("s", "b", 0.1702)], "score string, policy string, ndcg_at_k double")
    assert report.change_table(metrics, "a", "b").first()["change"] == pytest.approx(-0.6772)
    rounded = spark.createDataFrame([("s", 0.8474, 0.1702, -0.6772), ("t", 0.5, 0.4, 0.1)], "score string, stable double, keyed double, change double")
    assert [r["score"] for r in report.wrong_changes(rounded).collect()] == ["t"]
    a = spark.createDataFrame([("s", 0.1), ("t", 0.2), ("u", 0.3)], "score string, value double")
    b = spark.createDataFrame([("s", 0.1001), ("t", 0.3)], "score string, value double")
    assert {r["score"]: r["status"] for r in report.within(a, b, ("score",), 0.002).collect()} == {"s": "pass", "t": "fail", "u": "missing"}
    assert [tuple(r) for r in report.relabelled(a, "score", {"t": "Second", "s": "First"}).collect()] == [("Second", 0.2), ("First", 0.1)]


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "run")
    run = ["reviews", "--reviews", "r", "--items", "i", "--out", out, "--stage", "model", "--no-group-control", "--most-rows", "5"]
    args = command.parser().parse_args(run)
    assert (args.stage, args.most_rows, args.no_group_control, args.negatives, args.k) == ("model", 5, True, None, None)
    write_ratings(tmp_path)
    run = ["ratings", "--folder", str(tmp_path), "--out", out, "--tags", "action", "--negatives", "1", "--k", "1", "--repetitions", "0"]
    assert command.execute(spark, command.parser().parse_args(run))[1]
    assert tables.read_json(spark, f"{out}/settings.json")["evaluation"]["key_seed"] == 20_260_318
    (tmp_path / "s.toml").write_text('[evaluation]\nnegatives = 1\nk = 1\nrepetitions = 2\n[ratings]\ntags = ["action"]\nmost_users = 3\n')
    again = ["ratings", "--folder", str(tmp_path), "--out", out, "--settings", str(tmp_path / "s.toml"), "--repetitions", "1"]
    assert command.execute(spark, command.parser().parse_args(again))[1]
    used = tables.read_json(spark, f"{out}/settings.json")
    assert (used["evaluation"]["repetitions"], used["evaluation"]["negatives"], used["ratings"]["most_users"], used["ratings"]["tags"]) == (1, 1, 3, ["action"])
    for wrong in ("[other]\nx = 1\n", "[evaluation]\nnegative = 1\n"):
        (tmp_path / "w.toml").write_text(wrong)
        with pytest.raises(ValueError):
            experiments.read_settings(str(tmp_path / "w.toml"))
    shown = spark.read.csv(f"{out}/policy_report", header=True).collect()
    assert {r["score"] for r in shown} == {"raw_count", "centered_count", "popularity"} and all(" ± " in r["randomized"] for r in shown)
    hit = next(r for r in spark.read.csv(f"{out}/metrics_by_policy", header=True, schema=experiments.METRICS).collect() if r["score"] == "popularity" and r["policy"] == "hardened_uint64")["hit_at_k"]
    users, lists = tables.read_json(spark, f"{out}/run_summary.json")["dataset"]["n_users"], spark.read.csv(f"{out}/audit", header=True, inferSchema=True).first()["n_rows"]
    (tmp_path / "e.csv").write_text(f"score,policy,quantity,value\npopularity,hardened_uint64,hit_at_k,{hit + 0.001}\npopularity,,n_rows,{lists}\n,,n_users,{users}\n")
    ask = ["expected", "--out", out, "--figures", str(tmp_path / "e.csv")]
    assert command.execute(spark, command.parser().parse_args(ask))[1]
    assert not command.execute(spark, command.parser().parse_args([*ask, "--tolerance", "0.0001"]))[1]
    (tmp_path / "e.csv").write_text(f"score,policy,quantity,value\n,,n_users,{users + 0.001}\npopularity,none,mrr,0.5\n")
    assert sorted(r["status"] for r in command.execute(spark, command.parser().parse_args(ask))[0]) == ["fail", "missing"]
    for name in ("verify", "manifest"):
        assert command.execute(spark, command.parser().parse_args([name, "--out", out]))[1], name
    assert command.execute(spark, command.parser().parse_args(["smoke"]))[1]
    assert not command.execute(spark, command.parser().parse_args(["preflight", out, out + "/absent"]))[1]
    source = tmp_path / "f.txt"
    source.write_text("x")
    assert command.main(["download", source.as_uri(), str(tmp_path / "g.txt"), "--sha256", hashlib.sha256(b"x").hexdigest()]) == 0
    assert json.loads(capsys.readouterr().out)["sha256"] == hashlib.sha256(b"x").hexdigest()
