"""Exact vector search by dot product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listrank.sources.tables import checkpointed

#: Bytes of the queries that are broadcast at once, as doubles.
PASS_BYTES = 32 << 20
#: Queries and vectors that meet in one product: its sums stay in a core's cache.
QUERIES, VECTORS = 256, 512


def _by_width(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Ids and matrix of a table's (id, embedding) for each length; those with a null element have length -1."""
    ids, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
    width = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if flat.null_count:
        holds = np.zeros(len(width), bool)
        holds[np.repeat(np.arange(len(width)), width)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        starts, values = np.cumsum(width) - width, flat.to_numpy(zero_copy_only=False).astype(np.float64)
        width_of = np.where(holds, -1, width)
    else:
        starts, values, width_of = np.cumsum(width) - width, flat.to_numpy().astype(np.float64), width
    out = {}
    for w in np.unique(width_of).tolist():
        at = np.flatnonzero(width_of == w)
        cells = values[starts[at][:, None] + np.arange(w)] if w > 0 else np.zeros((len(at), 0))
        out[w] = ids.take(pa.array(at)), cells
    return out


def dots(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The products of two blocks. Every sum runs along the elements in order, whatever the block: equal vectors get
    equal bits, which a matrix product does not promise."""
    out, one = np.zeros((len(queries), len(vectors))), np.empty((len(queries), len(vectors)))
    columns = np.ascontiguousarray(vectors.T)
    for i in range(queries.shape[1]):
        np.multiply(queries[:, i : i + 1], columns[i], out=one)
        out += one
    return out


def _dot_batches(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTORS):
                for w, (vec_ids, vectors) in _by_width(batch.slice(begin, VECTORS)).items():
                    every = np.arange(len(vec_ids))
                    for width, (ids, cells) in queries.items():
                        for at in range(0, len(ids), QUERIES):
                            some, n = cells[at : at + QUERIES], len(ids[at : at + QUERIES])
                            found = pa.array(dots(some, vectors).ravel()) if w == width >= 0 else pa.nulls(n * len(every), pa.float64())
                            asked = ids.take(pa.array(np.repeat(np.arange(at, at + n), len(every))))
                            yield pa.RecordBatch.from_arrays([asked, vec_ids.take(pa.array(np.tile(every, n))), found], schema=schema)

    return run


def rank_by_dot(queries: DataFrame, vectors: DataFrame, top: int | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """queries, vectors (vec_id, embedding): query_id, vec_id, dot, rank (from 1, the largest dot first, then vec_id) of
    every vector for every query, or of the first `top` of each. Rows without an embedding are in no ranking; embeddings
    of unequal lengths, or with a null element, have a null dot and come last. Other columns are ignored.

    Queries are broadcast, in passes of about pass_bytes that follow one another, so that neither the driver nor a task
    ever holds more of them. A pass reads the vectors once and multiplies them block by block; no pair is left out. With
    `top`, a partition passes on no more than that many rows a query."""
    spark = vectors.sparkSession
    asked = queries.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    given = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = given.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(None).cast("double").alias("dot")).schema
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("dot"), "vec_id")
    size = asked.agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0
    passes, found = max(1, -(-size // pass_bytes)), None
    for k in range(passes):
        table = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == k).toArrow()
        shared = spark.sparkContext.broadcast(_by_width(table))
        arrow = pa.schema([("query_id", table.schema.field("vec_id").type), ("vec_id", table.schema.field("vec_id").type), ("dot", pa.float64())])
        part = given.mapInArrow(_dot_batches(shared, arrow), kind)
        if top is not None:
            part = part.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= top).drop("_at")
        if passes > 1:
            part = checkpointed(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.withColumn("rank", F.row_number().over(order).cast("long"))
