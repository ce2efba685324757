"""Shared pieces: table reads, lineage cuts in the cluster's shared folder, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space separates words here; everything else belongs to a word.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Words of letters A-Z, digits and every code point from U+0080 on, after A-Z became a-z.
LOOSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this application. Where none is configured, a folder of our own will do for a local
    session alone; on a cluster, whose executors don't share it, that raises."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp("checkpoints"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def spread_join(rows: DataFrame, side: DataFrame, pairs: Sequence[tuple[str, str]], how: str, broadcast_rows: int, salts: int = 32) -> DataFrame:
    """rows joined to a table of one row a key, on pairs of equal columns, null with null. The side is broadcast if it
    has no more than broadcast_rows rows; else each of its rows goes to `salts` places and rows are dealt to these at
    random, so that a hot key is spread over as many tasks. Neither names a column _salt or _place."""
    on = [rows[a].eqNullSafe(side[b]) for a, b in pairs]
    if side.count() <= broadcast_rows:
        return rows.join(F.broadcast(side), on, how)
    many = side.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return dealt.join(many, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs] + [F.col("_salt") == F.col("_place")], how).drop("_salt", "_place")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow table by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Writes a wide table once, as Parquet in the shared folder, so that later passes can prune its columns. Also
    returns a function that deletes it, for use when nothing lazy refers to it any more."""
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(name)

    def delete() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(name), delete


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one with underscores before it that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Words parted by white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes."""
    return F.translate(text, UPPER, LOWER)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))
