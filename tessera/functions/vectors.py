"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALLEST_NORM = 1e-30


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(vector: Column) -> Column:
    """The vector at length 1; null if a component is null or not finite or the length is next to nothing."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(dot(v, v))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & (norm > SMALLEST_NORM), F.transform(v, lambda x: x / norm))


def cosine(a: Column, b: Column) -> Column:
    """Of normalized vectors, held to -1 to 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def cosine_top(vectors: DataFrame, query_id: int, k: int, item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """item, score: the k vectors most like the one with query_id, itself left out; ties by item."""
    unit = vectors.select(item, normalized(F.col(vector)).alias("unit")).where("unit is not null")
    query = unit.where(F.col(item) == query_id).first()
    asked = F.lit(query["unit"] if query else None).cast("array<double>")
    scored = unit.where(F.col(item) != query_id).select(item, cosine(F.col("unit"), asked).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), item).limit(k)
