"""Dense vector algebra on array columns, inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    return F.aggregate(
        v,
        F.lit(0.0),
        lambda acc, x: acc + x * x,
        lambda acc: F.transform(v, lambda x: F.when(acc == 0, x).otherwise(x / F.sqrt(acc))),
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def scale(v: Column, weight: Column) -> Column:
    return F.transform(v, lambda x: x * weight)


def concat_vectors(*parts: Column) -> Column:
    """One vector, or NULL when any part is NULL."""
    missing = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
    return F.when(~missing, F.concat(*parts))



def mean_vector(df: DataFrame, keys: list[str], vector: str, output: str, *extra: Column) -> DataFrame:
    """Element-wise mean per key: partial sums on the map side, one vector per group in the shuffle."""
    return (
        df.where(F.col(vector).isNotNull())
        .withColumn("_dense", array_to_vector(as_double(F.col(vector))))
        .groupBy(*keys)
        .agg(vector_to_array(Summarizer.mean(F.col("_dense"))).alias(output), *extra)
    )
