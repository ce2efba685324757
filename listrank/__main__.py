"""Command line: python -m listrank COMMAND; each prints one JSON value."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from listrank.plans import experiments
from listrank.sources import download, tables


def preflight(spark: SparkSession, paths: Sequence[str], folder: str) -> dict:
    """Which inputs are there, and what room there is."""
    ready = {p: tables.path_exists(spark, p) for p in paths}
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    free = shutil.disk_usage(folder).free / 2**30
    return {"ready": all(ready.values()), "inputs": ready, "memory_gib": round(memory, 1), "free_disk_gib": round(free, 1), "runtime": json.loads(tables.runtime_manifest())}


def _rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="listrank")
    commands = top.add_subparsers(dest="command", required=True)
    run = argparse.ArgumentParser(add_help=False)
    run.add_argument("--out", required=True)
    run.add_argument("--resume", action="store_true", help="use the tables of stages that an earlier run completed")
    run.add_argument("--settings", help="a TOML file of all settings; options that are given come before it")
    run.add_argument("--negatives", type=int)
    run.add_argument("--k", type=int)
    run.add_argument("--repetitions", type=int)
    ratings = commands.add_parser("ratings", parents=[run], help="ratings and tags from CSV")
    ratings.add_argument("--folder", required=True)
    ratings.add_argument("--tags", nargs="+")
    ratings.add_argument("--most-users", type=int)
    reviews = commands.add_parser("reviews", parents=[run], help="reviews and item metadata from lines of JSON")
    reviews.add_argument("--reviews", required=True)
    reviews.add_argument("--items", required=True)
    reviews.add_argument("--stage", choices=("preprocess", "model", "all"), default="all")
    reviews.add_argument("--most-rows", type=int)
    reviews.add_argument("--no-group-control", action="store_true")
    data = commands.add_parser("dataset", help="a known data set's files, checked by digest")
    data.add_argument("name", choices=(*download.ARCHIVES, *download.FILES))
    data.add_argument("folder")
    data.add_argument("--force", action="store_true")
    expected = commands.add_parser("expected", help="a run's figures against a CSV of expected ones")
    expected.add_argument("--out", required=True)
    expected.add_argument("--figures", required=True)
    expected.add_argument("--tolerance", type=float, default=0.002)
    for name, text in (("replay", "evaluate frozen lists again"), ("verify", "contract of frozen lists, and changed files"), ("manifest", "write digests of a run's files")):
        commands.add_parser(name, help=text).add_argument("--out", required=True)
    commands.add_parser("smoke", help="facts any evaluator must meet")
    check = commands.add_parser("preflight", help="inputs, memory and disk")
    check.add_argument("paths", nargs="*")
    check.add_argument("--folder", default=".")
    fetch = commands.add_parser("download", help="a file, checked by digest; a zip archive may be unpacked")
    fetch.add_argument("url")
    fetch.add_argument("path")
    fetch.add_argument("--sha256")
    fetch.add_argument("--md5")
    fetch.add_argument("--unpack")
    fetch.add_argument("--force", action="store_true")
    return top


def execute(spark: SparkSession | None, args: argparse.Namespace) -> tuple[object, bool]:
    """What to print, and whether all is well."""
    if args.command == "download":
        kind, wanted = ("md5", args.md5) if args.md5 else ("sha256", args.sha256)
        found = {kind: download.fetch(args.url, args.path, wanted, kind, args.force)}
        return found | ({"files": download.unpack(args.path, args.unpack)} if args.unpack else {}), True
    if args.command == "dataset":
        return download.data_set(args.name, args.folder, args.force), True
    if args.command in ("ratings", "reviews"):
        said = experiments.read_settings(args.settings) if args.settings else {}
        given = {k: getattr(args, k) for k in ("negatives", "k", "repetitions") if getattr(args, k) is not None}
        seed = {"key_seed": 20_260_318} if args.command == "ratings" else {}
        evaluation = experiments.Evaluation(**seed | said.get("evaluation", {}) | given)
    if args.command == "ratings":
        own = {"tags": args.tags and tuple(args.tags), "most_users": args.most_users}
        ratings = experiments.Ratings(**said.get("ratings", {}) | {k: v for k, v in own.items() if v is not None})
        return experiments.run_ratings(spark, args.folder, args.out, ratings, evaluation, args.resume), True
    if args.command == "reviews":
        own = {"group_control": False if args.no_group_control else None, "most_rows": args.most_rows}
        reviews = experiments.Reviews(**said.get("reviews", {}) | {k: v for k, v in own.items() if v is not None})
        return experiments.run_reviews(spark, args.reviews, args.items, args.out, reviews, evaluation, args.stage, args.resume), True
    if args.command == "expected":
        rows = _rows(experiments.expected_figures(spark, args.out, args.figures, args.tolerance))
        return rows, bool(rows) and all(r["status"] == "pass" for r in rows)
    if args.command == "replay":
        result = experiments.replay(spark, args.out)
        return result, result["status"] == "pass"
    if args.command == "verify":
        lists, files = _rows(experiments.contract(spark, args.out)), _rows(experiments.changed_files(spark, args.out))
        return {"contract": lists, "files": files}, not files and not any(r["misplaced_positives"] or r["changed_rows"] for r in lists)
    if args.command == "manifest":
        experiments.write_manifest(spark, args.out)
        return {"files": experiments.own_files(spark, args.out).count()}, True
    if args.command == "smoke":
        result = experiments.smoke(spark)
        return result, result["status"] == "pass"
    result = preflight(spark, args.paths, args.folder)
    return result, result["ready"]


def main(arguments: Sequence[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = None if args.command in ("download", "dataset") else SparkSession.builder.appName("listrank").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result, good = execute(spark, args)
    print(json.dumps(result, indent=2, sort_keys=True, default=str))
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
