"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemrec.llm.common import arrow_schema, as_batch, bound_batches, map_batches, named
from itemrec.runtime import store

UNKNOWN = "und"
#: Lengths of the n-grams, buckets they are hashed to, and what is added to each count.
ORDERS, BUCKETS, SMOOTHING = (1, 2, 3), 1 << 16, 0.5
#: Bytes of a log-probability matrix at most. More languages are scored in slices.
MATRIX_BYTES = 64 << 20
#: Characters hashed at a time.
BLOCK = 1 << 20
_MIX = np.uint32(2_654_435_761)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text in lower case, with a space at its ends; block by block."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    overlap = max(ORDERS) - 1
    for at in range(0, len(points), BLOCK):
        block = points[max(0, at - overlap) : at + BLOCK]
        skip, key = at - max(0, at - overlap), np.zeros(len(block), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            key = (key[: len(block) - n + 1] * np.uint32(31_337) + block[n - 1 :] + np.uint32(n)) * _MIX if n <= len(block) else key[:0]
            if n in ORDERS:
                yield (key[max(0, skip - n + 1) :] >> np.uint32(7)) % np.uint32(buckets)


def counts(text: str, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for part in grams(text, buckets):
        out += np.bincount(part, minlength=buckets)
    return out


class Model:
    """Log-probabilities of the buckets given each language, and of the languages."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.matrix, self.prior = langs, matrix, prior

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        total = self.totals(text)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())

    def totals(self, text: str) -> np.ndarray:
        total = self.prior.copy()
        for part in grams(text, len(self.matrix)):
            found, times = np.unique(part, return_counts=True)
            total += times @ self.matrix[found]
        return total


class Sliced:
    """A model whose matrix would exceed ``MATRIX_BYTES``: stored counts (lang, bucket, n), of ``width`` languages at a time."""

    def __init__(self, langs: list[str], counts: DataFrame, prior: np.ndarray, buckets: int, width: int):
        self.langs, self.counts, self.prior, self.buckets, self.width = langs, counts, prior, buckets, width

    def models(self) -> Iterator[tuple[int, Model]]:
        """(place of its first language, model) of each slice."""
        for at in range(0, len(self.langs), self.width):
            upto = min(len(self.langs), at + self.width)
            found = self.counts.where(F.col("lang").between(at, upto - 1)).withColumn("lang", F.col("lang") - at)
            yield at, Model(self.langs[at:upto], log_matrix(found, self.buckets, upto - at), self.prior[at:upto])


def log_matrix(found: DataFrame, buckets: int, n_langs: int) -> np.ndarray:
    matrix = np.full((buckets, n_langs), SMOOTHING)
    for batch in found.toArrow().to_batches():
        matrix[batch["bucket"].to_numpy(), batch["lang"].to_numpy()] += batch["n"].to_numpy()
    matrix /= matrix.sum(axis=0)
    return np.log(matrix, out=matrix)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", learn: Column | bool = True, buckets: int = BUCKETS) -> Model | Sliced:
    """Learn from the rows of ``docs`` for which ``learn`` holds and whose language isn't null.

    Every task adds up a count for each language and bucket that it meets; these are summed by
    bucket. A matrix over ``MATRIX_BYTES`` is never whole: its languages are scored in slices. Ties between languages go to the first in
    alphabetical order. Texts without a letter teach nothing.
    """
    bound_batches(docs.sparkSession)
    rows = docs.where(F.lit(learn) if isinstance(learn, bool) else learn).select(
        named(lang_col).cast("string").alias("lang"), named(text_col).cast("string").alias("text")
    ).where("lang is not null and text is not null")
    documents = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(documents)
    width = max(1, MATRIX_BYTES // (buckets * 8))
    number = {x: i for i, x in enumerate(langs)}
    out = arrow_schema("lang int, bucket int, n bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if has_letter(text):
                    at = number[lang]
                    if at not in own and len(own) >= width:
                        yield from flush(own)
                        own = {}
                    own[at] = own.get(at, 0) + counts(text, buckets)
        yield from flush(own)

    def flush(own: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at, n in own.items():
            full = np.flatnonzero(n)
            yield as_batch({"lang": np.full(len(full), at), "bucket": full, "n": n[full]}, out)

    summed = rows.mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    prior = np.log(np.array([documents[x] for x in langs], float) / max(1, sum(documents.values())))
    if len(langs) > width:
        return Sliced(langs, store(summed), prior, buckets, width)
    return Model(langs, log_matrix(summed, buckets, len(langs)), prior)


def predict(docs: DataFrame, model: Model | Sliced, text_col: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns, lang_pred and score, the probability of lang_pred, for each row of ``docs``.

    Null texts and those without a letter are ``UNKNOWN`` with score 0, and so is every text if the
    model has no language. No rows give no rows.
    """
    rows = docs.select(*[named(c) for c in keep], named(text_col).cast("string").alias("_text"))
    if isinstance(model, Sliced):
        return _predict_slices(rows, model, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def score(batch: pa.RecordBatch) -> dict[str, object]:
        found = [shared.value.predict(t) for t in batch["_text"].to_pylist()]
        return {c: batch[c] for c in keep} | {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    return map_batches(rows, score, f"{fields}, lang_pred string, score double")


def _predict_slices(rows: DataFrame, model: Sliced, keep: tuple[str, ...]) -> DataFrame:
    """The best language of each slice and the slice's summed likelihood for each row; then the best of the slices."""
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()))
    slices = []
    for first, part in model.models():
        shared = rows.sparkSession.sparkContext.broadcast(part)

        def score(batch: pa.RecordBatch, shared=shared, first: int = first) -> dict[str, object]:
            known = [(i, t) for i, t in zip(batch["_row"].to_pylist(), batch["_text"].to_pylist(), strict=True) if t and has_letter(t)]
            totals = [shared.value.totals(t) for _, t in known]
            best = [int(np.argmax(x)) for x in totals]
            return {
                "_row": [i for i, _ in known], "place": [first + b for b in best], "lang_pred": [shared.value.langs[b] for b in best],
                "total": [x[b] for x, b in zip(totals, best, strict=True)], "times": [np.exp(x - x[b]).sum() for x, b in zip(totals, best, strict=True)],
            }

        slices.append(store(map_batches(rows.select("_row", "_text"), score, "_row bigint, place int, lang_pred string, total double, times double")))
        shared.destroy()
    every = slices[0]
    for part in slices[1:]:
        every = every.unionByName(part)
    best = every.groupBy("_row").agg(
        F.max_by("lang_pred", F.struct("total", -F.col("place"))).alias("_lang"), F.max("total").alias("_most"),
        F.collect_list(F.struct("total", "times")).alias("_parts"),  # one for each slice
    ).select("_row", "_lang", (1 / F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["times"] * F.exp(x["total"] - F.col("_most")))).alias("_score"))
    return rows.join(best, "_row", "left").select(
        *[named(c) for c in keep], F.coalesce("_lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
