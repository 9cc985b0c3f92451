"""Line deduplication: lines found in several documents stay in the last of them only."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemrec.llm.common import arrow_schema, as_batch, bound_batches, fresh, join_frequent, map_batches, named, without
from itemrec.runtime import store

ADDED = ("n_lines", "n_dropped")
MIN_CHARS, MIN_DOCUMENTS = 20, 3


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line without outer white space and in lower case (ASCII); None for short lines."""
    key = line.strip()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def common_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_documents: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, line) for each document and long line in it; (line, keeper, n_rows) for the lines in enough documents."""

    def keys(batch: pa.RecordBatch) -> dict[str, object]:
        found = [{line_key(x, min_chars) for x in (t or b"").split(b"\n")} - {None} for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "lines": [list(x) for x in found]}

    rows = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).cast("binary").alias("text"))
    by_row = map_batches(rows, keys, "doc_id bigint, lines array<binary>")
    held = store(by_row.select("doc_id", F.explode("lines").alias("line")))
    common = (
        held.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
        .groupBy("line").agg(F.count("*").alias("n_documents"), F.max("doc_id").alias("keeper"), F.sum("n").alias("n_rows"))
        .where(F.col("n_documents") >= min_documents)
    )
    return held, common.select("line", "keeper", "n_rows")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``docs`` with the text's repeated lines gone, and n_lines (before) and n_dropped.

    A line's key is the line without white space (ASCII) at its ends and with A-Z in lower case. Keys
    of ``min_chars`` code points found in ``min_documents`` documents lose their lines everywhere
    but in the largest id that holds them; the other lines stay in order, joined by \\n.

    Null or empty text is one empty line and becomes ''. Rows of one id are one document. A null id
    is a document too, below all others. No rows give no rows. Other columns pass through, but
    those named n_lines or n_dropped are replaced.
    """
    held, common = common_lines(docs, id_col, text_col, min_chars, min_documents)
    n_held = held.count()
    keeper = F.coalesce(F.col("keeper") == F.col("doc_id"), F.col("keeper").isNull() & F.col("doc_id").isNull())
    lost = join_frequent(held, common, ["line"], "n_rows", n_held).where(~keeper).groupBy("doc_id").agg(F.collect_set("line").alias("lost"))
    rest = without(docs, ADDED)
    key, drop = fresh(rest.columns, "lost_by"), fresh(rest.columns, "lost_lines")
    found = rest.join(lost.select(F.col("doc_id").alias(key), F.col("lost").alias(drop)), named(id_col).cast("bigint").eqNullSafe(F.col(key)), "left").drop(key)
    fields = [f if f.name != text_col else T.StructField(f.name, T.StringType()) for f in rest.schema.fields]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType(), False) for c in ADDED]])
    out, passed = arrow_schema(schema), rest.columns

    def clean(batches):
        for batch in batches:
            kept, counts = [], []
            for text, gone in zip(batch[text_col].to_pylist(), batch[drop].to_pylist(), strict=True):
                lines = (text or "").split("\n")
                if gone:
                    gone = set(gone)
                    left = [x for x in lines if line_key(x.encode(), min_chars) not in gone]
                    counts.append((len(lines), len(lines) - len(left)))
                    kept.append("\n".join(left))
                else:
                    counts.append((len(lines), 0))
                    kept.append(text or "")
            columns = {c: batch[c] for c in passed} | {text_col: kept}
            yield as_batch(columns | {c: [x[i] for x in counts] for i, c in enumerate(ADDED)}, out)

    bound_batches(docs.sparkSession)
    return found.mapInArrow(clean, schema)
