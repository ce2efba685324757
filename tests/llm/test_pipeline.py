"""Pipeline stages on small tables, and the shape of what the registered queries return."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listrank.llm import decontam, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
COLUMNS = {
    "op1_mix_sources": "doc_id size source_size target taken", "op5_quality_classifier": "doc_id score kept", "op7_simhash": "doc_id fingerprint component_id",
    "op8_toxicity": "doc_id held_out score predicted", "op10_sharding": "doc_id slot shard",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_gives_a_row_per_document(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns) and out.count() == 200


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 100_000)
    odd = spark.createDataFrame([(None, None, None, None, None), (200_000, "", "en", "src0", 0)], docs.schema)
    now = docs.unionByName(extra).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SF).cache()
        assert now.columns == docs.columns, name
        if name.startswith("mixing"):
            most = now.groupBy("doc_id").count().agg(F.max("count")).first()[0]
            assert most <= 2
        else:
            assert now.exceptAll(before).isEmpty() and now.count() < before.count(), name
        if name.startswith("SimHash"):
            assert now.groupBy("text").count().where("count > 1").isEmpty()
        if name.startswith("benchmark"):
            left = decontam.find_contamination(now, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert left.where(F.size("found.spans") > 0).isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.count() == now.count() and last.where("shard is null").isEmpty()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Columns that are named as the stages' own helpers, of other types, and maps that no hash takes."""
    names = ("quality", "Found", "row", "shard_of", "_n", "_key", "text_key", "site", "path", "id", "copies")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id")) for n in names}).withColumn("found2", F.create_map(F.lit("a"), F.col("doc_id")))
    docs = docs.unionByName(docs.where("doc_id < 5"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.schema.simpleString() == docs.schema.simpleString(), name
    rows = now.distinct().collect() if "map" not in now.schema.simpleString() else now.collect()
    assert len(rows) > 50 and all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names) and all(r["found2"] == {"a": r["doc_id"]} for r in rows)


def test_query_columns_as_contracted(spark):
    """op7's hex digits, and op1's sizes and targets against SQL."""
    import duckdb
    import pandas as pd
    import xxhash

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_simhash(spark, SF).collect():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in docs[r["doc_id"]] or "")
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
        grams = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        assert r["fingerprint"] == f"{sum(1 << b for b in range(64) if sum(g >> b & 1 for g in grams) * 2 > len(grams)):016x}" and r["component_id"] <= r["doc_id"]
    got = queries.op1_mix_sources(spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source)
SELECT doc_id, size, source_size, w FROM d JOIN s USING (source)"""
    want = con.execute(sql).df()
    both = got.merge(want, on="doc_id", suffixes=("", "_w"))
    assert len(both) == len(got) == len(want) and (both["size"] == both["size_w"]).all() and (both.source_size == both.source_size_w).all()
    sources = both.groupby("source").agg(source_size=("source_size", "first"), target=("target", "first"), w=("w", "first"), taken=("taken", "sum"))
    left, capped = 1.5 * sources.source_size.sum(), pd.Series(False, index=sources.index)
    while True:
        share = (left - 2 * sources.source_size[capped].sum()) * sources.w / sources.w[~capped].sum()
        over = ~capped & (share > 2 * sources.source_size + 1e-9)
        if not over.any():
            break
        capped |= over
    expected = share.where(~capped, 2.0 * sources.source_size)
    assert ((sources.target - expected).abs() < 1e-6 * expected + 1e-6).all() and (both.taken <= 2 * both["size"]).all()


def test_run_reruns_alike(spark):
    a, b = (corpus_pipeline.run(spark, SF) for _ in range(2))
    assert a.count() > 50 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
