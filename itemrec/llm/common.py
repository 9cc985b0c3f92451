"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from itemrec.runtime import store

ASCII_SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of one Arrow batch: what a Python worker holds of its partition at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column in ``taken`` has it in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add; Spark's names ignore case."""
    gone = {n.lower() for n in names}
    return df.select(*[named(c) for c in df.columns if c.lower() not in gone])


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(doc_id, text as UTF-8 bytes, more...): all that most operators read."""
    return df.select(
        named(id_col).alias("doc_id"), named(text_col).cast("binary").alias("text"), *[named(c).alias(m) for c, m in zip(more[::2], more[1::2], strict=True)]
    )


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def as_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """Lists, arrays or Arrow arrays by name, in the order and types of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [v.cast(f.type) if isinstance(v := columns[f.name], pa.Array) else pa.array(v, f.type) for f in schema], schema=schema
    )


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch of each partition; it returns the output columns by name."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield as_batch(fn(batch), out)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def id_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """128 bits of hash as two longs, for keys that must not meet by chance."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)


def join_frequent(rows: DataFrame, table: DataFrame, keys: list[str], n_col: str, n_rows: int, bound: int = 200_000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has a row for each key and in ``n_col`` how many rows hold the key.

    A key that holds a share of all rows would fill one task of a shuffled join. A table of at most
    ``bound`` rows is broadcast. Of a larger one, the keys that hold at least an even share of
    ``n_rows / bound`` rows are broadcast, and there are ``bound`` of them at most; the others are
    too rare to fill a task and are joined by shuffle.
    """
    table = store(table)
    if table.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(table), keys)
    even = max(1, n_rows // bound)
    hot, cold = table.where(F.col(n_col) > even), table.where(F.col(n_col) <= even)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(cold, keys))


def row_hashes(text_col: str, *also: str) -> tuple[Column, Column]:
    """``hash_pair`` of a row's text and of other columns by which rows of one id are told apart; nulls count as empty."""
    return hash_pair(*[F.coalesce(named(c).cast("string"), F.lit("")) for c in (text_col, *also)])


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, *also: str, bound: int = 200_000) -> DataFrame:
    """``docs`` without the rows whose id and ``row_hashes`` are in ``gone`` (doc_id, h1, h2).

    Up to ``bound`` rows to drop are broadcast, so that the texts needn't be shuffled.
    """
    rows = store(gone.select(*[F.col(c).alias(f"gone_{c}") for c in ("doc_id", "h1", "h2")]).distinct())
    if rows.limit(bound + 1).count() <= bound:
        rows = F.broadcast(rows)
    names = [fresh(docs.columns, c) for c in ("hash_1", "hash_2")]
    gone_by = [fresh([*docs.columns, *names], f"gone_{c}") for c in ("doc_id", "h1", "h2")]
    h1, h2 = row_hashes(text_col, *also)
    on = named(id_col).cast("bigint").eqNullSafe(F.col(gone_by[0])) & (F.col(names[0]) == F.col(gone_by[1])) & (F.col(names[1]) == F.col(gone_by[2]))
    return docs.withColumn(names[0], h1).withColumn(names[1], h2).join(rows.toDF(*gone_by), on, "left_anti").drop(*names)
