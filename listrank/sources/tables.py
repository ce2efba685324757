"""Readers and writers. Every path is read by Spark, so any store that it knows will do."""

from __future__ import annotations

import json
import platform
import re
import subprocess
import tempfile
from collections.abc import Callable, Sequence
from importlib import metadata

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listrank.functions.text import json_kind, json_words, normalize, numeric_price, parse_price


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, in the cluster's shared folder. Where none is configured, a folder of
    our own will do for a local session alone; on a cluster, whose executors don't share it, that raises."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp("checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def source_rows(lines: DataFrame) -> DataFrame:
    """Adds source_row to rows that come straight from files: larger for later lines of a file, and for files later by
    name, however the files are cut into partitions and packed.

    A row is known by its file, the first byte of its block and its place in the partition. Only the last block of a
    file shares a partition with others, and a block has no more lines than bytes, so block start + place rises along a
    file. Of one file that is one block, rows are numbered from 0."""
    spark = lines.sparkSession
    names = sorted({re.sub(":/+", ":/", n, count=1) for n in lines.inputFiles()})
    ranks = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "_name string, _rank long")
    own = lines.columns
    name = F.regexp_replace("_metadata.file_path", "^([^:/]+):/+", "$1:/")
    placed = lines.select("*", name.alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    placed = placed.join(F.broadcast(ranks), F.col("_path") == F.col("_name"), "left")
    rank = F.coalesce("_rank", F.raise_error(F.concat(F.lit("unknown file "), "_path")).cast("long"))
    return placed.select((F.shiftleft(rank, 42) + F.col("_start") + F.col("_place")).alias("source_row"), *own)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """source_row, record and kinds of each line of JSON that is not blank; kinds is the line as a variant, which tells a
    string from what it looks like."""
    lines = source_rows(spark.read.text(path))
    return lines.where(F.trim("value") != "").select("source_row", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("record"), F.try_parse_json("value").alias("kinds"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """source_row, user_id, item_id, rating, ts; rows without one of these, or with no finite number, are left out."""
    rows = read_json_lines(spark, path, "user_id string, parent_asin string, rating string, timestamp string").select("source_row", "record.*")
    rows = rows.select("source_row", "user_id", F.col("parent_asin").alias("item_id"), F.expr("try_cast(rating AS double)").alias("rating"), F.expr("try_cast(timestamp AS double)").alias("ts"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("rating", "ts")]
    return rows.where("user_id <> '' AND item_id <> ''").where(finite[0] & finite[1]).withColumn("ts", F.col("ts").cast("long"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """source_row, item_id, title, subtitle, author, store, main_category, categories, price_num, item_text. Rows without
    an id are left out. item_text joins the texts as they are and the other fields at any depth, normalized; details
    that are no object follow the word raw_details. A price that is a number is kept; one that is a text is parsed."""
    plain, nested = ("title", "subtitle", "author", "store", "main_category"), ("categories", "features", "description")
    rows = read_json_lines(spark, path, "parent_asin string, " + ", ".join(f"{f} string" for f in (*plain, *nested, "details", "price"))).where("record.parent_asin <> ''")
    kind = {f: F.regexp_extract(F.schema_of_variant(F.try_variant_get("kinds", f"$.{f}", "variant")), "^[A-Z]+", 0) for f in (*nested, "details", "price")}
    rows = rows.select("source_row", "record.*", *[k.alias(f"_{f}") for f, k in kind.items()])

    def words(f: str) -> Column:
        return F.when(F.col(f"_{f}") == "STRING", F.col(f)).otherwise(F.array_join(json_words(F.col(f)), " "))

    told = F.col("details")
    inner = F.when(F.trim(told) == "", F.lit("")).when(json_kind(told) == "OBJECT", F.array_join(json_words(told), " ")).otherwise(F.concat(F.lit("raw_details "), told))
    text = normalize(F.concat_ws(" ", *[F.col(f) for f in plain], *[words(f) for f in nested], inner))
    price = F.when(F.col("_price") == "STRING", parse_price(F.col("price"))).otherwise(numeric_price(F.col("price")))
    listed = F.array_compact(F.coalesce(F.from_json("categories", "array<string>"), F.array().cast("array<string>")))
    return rows.select("source_row", F.col("parent_asin").alias("item_id"), *plain, listed.alias("categories"), price.alias("price_num"), text.alias("item_text"))


def categories_json(categories: Column) -> Column:
    """A list of categories as JSON; [] for null."""
    return F.coalesce(F.to_json(categories), F.lit("[]"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a declared schema; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


RATINGS = "userId INT, movieId INT, rating DOUBLE, timestamp BIGINT"
TAGS = "tagId INT, tag STRING"
TAG_SCORES = "movieId INT, tagId INT, relevance DOUBLE"


def tag_attributes(scores: DataFrame, tags: DataFrame, names: list[str], threshold: float = 0.7) -> DataFrame:
    """movieId and a 0/1 column per selected tag (attr_0, attr_1, ...): relevance of threshold or more."""
    ids = {r["tag"]: r["tagId"] for r in tags.where(F.col("tag").isin(names)).collect()}
    if missing := [n for n in names if n not in ids]:
        raise KeyError(f"tags not found: {missing}")
    chosen = scores.where(F.col("tagId").isin(list(ids.values())))
    return chosen.groupBy("movieId").agg(*[F.max(F.when((F.col("tagId") == ids[n]) & (F.col("relevance") >= threshold), 1.0).otherwise(0.0)).alias(f"attr_{i}") for i, n in enumerate(names)])


def by_user(df: DataFrame) -> DataFrame:
    """Split rows as they are written: ranges of users, each sorted by user and time rank."""
    return df.repartitionByRange("user_idx").sortWithinPartitions("user_idx", "within_user_rank")


def freeze(candidates: DataFrame, path: str, score: str) -> None:
    """Adds the scored lists of one score family to a table partitioned by score."""
    candidates.withColumn("score_name", F.lit(score)).write.mode("append").option("compression", "zstd").partitionBy("score_name").parquet(path)


def frozen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small result as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


#: Bytes of a file up to which a task hashes it as one value.
WHOLE_FILE = 1 << 30


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file below a folder that holds a byte. Files are hashed by tasks, one a value; the few that are larger
    than a value may be are read as streams by the driver, whatever their size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= WHOLE_FILE).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = []
    for r in files.where(F.col("length") > WHOLE_FILE).select("path", "length").collect():
        store, at = _file_system(spark, r["path"])
        stream = store.open(at)
        try:
            large.append((r["path"], r["length"], spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    return small.unionByName(spark.createDataFrame(large, "path string, size long, sha256 string")) if large else small


def table_checksum(df: DataFrame) -> DataFrame:
    """One row: n and an order-free checksum of all columns."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("checksum"))


def runtime_manifest(packages: Sequence[str] = ("numpy", "pandas", "pyarrow"), folder: str | None = None) -> str:
    """Versions of what runs here, and the commit checked out in the folder, if any."""
    found = {}
    for name in packages:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = None
    try:
        got = subprocess.run(["git", "-C", folder or ".", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
        commit = got.stdout.strip() if got.returncode == 0 else None
    except (OSError, subprocess.TimeoutExpired):
        commit = None
    return json.dumps({"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__, "packages": found, "commit": commit}, sort_keys=True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One small JSON file with sorted keys, in any store."""
    files, at = _file_system(spark, path)
    stream = files.create(at, True)
    stream.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    stream.close()


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame], resume: bool) -> DataFrame:
    """A stage's table: built and written, or read again where an earlier run completed it."""
    if not (resume and path_exists(spark, f"{path}/_SUCCESS")):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
