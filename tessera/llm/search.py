"""Exact top-k search over integer vectors (operator 3), block at a time.

Rows are dealt to shards by ranges of their id and, within a shard, to blocks of `block_rows` consecutive ids. A block
keeps its forward index (a dense integer matrix) and, for each term, the largest and the smallest value. For a query the
sum over terms of its value times the maximum (for negative values, the minimum) bounds every score in the block. Blocks
are scored in the order of their bounds until a bound falls below the k-th best score so far.

Each query first meets the shard of its own id; its k-th best score there is a threshold that holds everywhere. Then it
visits, with that threshold, the other shards whose own bound reaches it. A shard and `batch_queries` of its visitors at
most meet in one group, so a group is of bounded size. The best k over all shards follow by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import written


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, terms: floor(scale * x) of each component as long; rows without id, null vectors and vectors with a
    null or non-finite component are left out."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    sound = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("terms"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where no sum can leave its 53 exact bits."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return queries @ rows.T
    exact = queries.astype(object) @ rows.T.astype(object)
    return exact.astype(np.int64)  # an error if a score exceeds a long


def upper_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each query (row) and each block, a score that no row of the block exceeds."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


def best_of_shard(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's best k rows that score its floor or more; ties go to the smaller vec_id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    starts = np.arange(0, len(ids), block_rows)
    bounds = upper_bounds(queries, np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts))
    turns = np.argsort(-bounds, axis=1, kind="stable")
    n = len(query_ids)
    top_score = np.full((n, k), np.iinfo(np.int64).min)
    top_id = np.full((n, k), np.iinfo(np.int64).max)
    active = np.arange(n)
    for turn in range(len(starts)):
        block = turns[active, turn]
        going = bounds[active, block] >= np.maximum(top_score[active, -1], floors[active])  # an equal score with a smaller id may be there
        active, block = active[going], block[going]
        if not len(active):
            break
        for b in np.unique(block):
            own = active[block == b]
            part = slice(starts[b], starts[b] + block_rows)
            scores = products(queries[own], rows[part])
            found = np.broadcast_to(ids[part], scores.shape)
            itself = found == query_ids[own][:, None]
            scores = np.where(itself, np.iinfo(np.int64).min, scores)
            found = np.where(itself, np.iinfo(np.int64).max, found)
            scores, found = np.concatenate((top_score[own], scores), axis=1), np.concatenate((top_id[own], found), axis=1)
            best = np.lexsort((found, -scores), axis=1)[:, :k] if scores.min() > np.iinfo(np.int64).min else np.lexsort((found, -np.maximum(scores, np.iinfo(np.int64).min + 1)), axis=1)[:, :k]
            top_score[own], top_id[own] = np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)
    row, column = np.nonzero(top_id != np.iinfo(np.int64).max)
    return query_ids[row], top_id[row, column], top_score[row, column]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block_rows: int = 64, shard_blocks: int = 128, batch_queries: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k rows with the highest integer inner product.

    is_query tells the query rows by the column vec_id. A query's own id never is its candidate; ties go to the
    smaller vec_id; with fewer candidates all are given. Repeated rows count as often as they occur. Vectors of
    different widths are padded with zeros. An empty table, or one without queries, gives no rows. Other columns are
    not read.
    """
    rows = written(quantized(vectors, vec_id, embedding, scale), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("terms")).alias("width")).first()
    n_shards, width = max(1, -(-size["n"] // (block_rows * shard_blocks))), size["width"] or 0
    least = np.iinfo(np.int64).min
    edges = np.array(sorted(set(rows.approxQuantile("vec_id", [i / n_shards for i in range(1, n_shards)], 0.1 / n_shards))) if n_shards > 1 else [], np.float64)

    def shards_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges, ids.astype(np.float64), side="right").astype(np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shards_of(batch.column(0).to_numpy())), *batch.columns], names=["shard", "vec_id", "terms"])

    placed = written(rows.mapInArrow(dealt, "shard long, vec_id long, terms array<long>"), "shards")
    batch_of = F.pmod(F.xxhash64("query_id"), F.col("batches").cast("long"))

    def met(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score of the best k of each (shard, query_id, floor, terms)."""
        wanted = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / batch_queries).cast("int").alias("batches"))
        wanted = written(wanted, "meetings")  # a row for each shard that is visited
        queries = asked.join(wanted, "shard").withColumn("batch", batch_of)
        data = placed.join(wanted, "shard").select("shard", "vec_id", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - F.lit(1).cast("long"))).alias("batch"))

        def meet(data: pa.Table, asked: pa.Table) -> pa.Table:
            names = ["query_id", "vec_id", "score"]
            if not data.num_rows or not asked.num_rows:
                return pa.table({name: pa.array([], pa.int64()) for name in names})
            found = best_of_shard(asked["query_id"].to_numpy(), matrix(asked["q_terms"], width), asked["floor"].to_numpy(), data["vec_id"].to_numpy(), matrix(data["terms"], width), k, block_rows)
            return pa.table({name: pa.array(x) for name, x in zip(names, found, strict=True)})

        queries = queries.select(F.col("shard").alias("q_shard"), F.col("batch").alias("q_batch"), "query_id", "floor", F.col("terms").alias("q_terms"))
        return data.groupBy("shard", "batch").cogroup(queries.groupBy("q_shard", "q_batch")).applyInArrow(meet, "query_id long, vec_id long, score long")

    asked = placed.where(is_query).withColumnRenamed("vec_id", "query_id")
    first = written(met(asked.select("shard", "query_id", F.lit(least).alias("floor"), "terms")), "own-shards")
    if n_shards > 1:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        floors = first.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").alias("floor"))
        going = asked.join(floors, "query_id", "left").select("query_id", "shard", "terms", F.coalesce("floor", F.lit(least)).alias("floor"))
        first = first.union(met(visits(going, shard_bounds(placed, width), width)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def shard_bounds(placed: DataFrame, width: int) -> DataFrame:
    """shard, high, low: the largest and the smallest value of each term of a shard."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, terms = batch.column(0).to_numpy(), matrix(batch.column(1), width)
            order = np.argsort(shards, kind="stable")
            own, starts = np.unique(shards[order], return_index=True)
            if len(own):
                high, low = np.maximum.reduceat(terms[order], starts), np.minimum.reduceat(terms[order], starts)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(high), pa.list_(pa.int64())), pa.array(list(low), pa.list_(pa.int64()))], names=["shard", "high", "low"])

    parts = placed.select("shard", "terms").mapInArrow(bounds, "shard long, high array<long>, low array<long>")
    each = parts.select("shard", F.posexplode(F.arrays_zip("high", "low")).alias("at", "x"))
    merged = each.groupBy("shard", "at").agg(F.max("x.high").alias("high"), F.min("x.low").alias("low"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "high", "low")))  # one entry for each term
    return merged.groupBy("shard").agg(ordered.alias("b")).select("shard", F.transform("b", lambda x: x["high"]).alias("high"), F.transform("b", lambda x: x["low"]).alias("low"))


def visits(going: DataFrame, bounds: DataFrame, width: int, at_once: int = 4096) -> DataFrame:
    """shard, query_id, floor, terms: each query for each shard but its own whose bound reaches its floor. The bounds
    are taken `at_once` shards at a time, two rows of numbers each, so what a task holds of them is bounded."""
    numbered = written(bounds.withColumn("group", F.floor(F.col("shard") / at_once)), "bounds")
    out = None
    for group in sorted(r["group"] for r in numbered.select("group").distinct().collect()):
        found = numbered.where(F.col("group") == group).toArrow()
        shards, high, low = found["shard"].to_numpy(), matrix(found["high"], width), matrix(found["low"], width)

        def chosen(batches: Iterator[pa.RecordBatch], shards: np.ndarray = shards, high: np.ndarray = high, low: np.ndarray = low) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                reach = upper_bounds(matrix(batch.column(2), width), high, low) >= batch.column(3).to_numpy()[:, None]
                reach &= shards[None, :] != batch.column(1).to_numpy()[:, None]
                query, shard = np.nonzero(reach)
                at = pa.array(query)
                yield pa.RecordBatch.from_arrays([pa.array(shards[shard]), batch.column(0).take(at), batch.column(3).take(at), batch.column(2).take(at)], names=["shard", "query_id", "floor", "terms"])

        part = going.select("query_id", "shard", "terms", "floor").mapInArrow(chosen, "shard long, query_id long, floor long, terms array<long>")
        out = part if out is None else out.union(part)
    return out
