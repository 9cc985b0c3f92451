"""Quality classifier: votes of the nearest labelled documents in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemrec.llm.class_lm import words
from itemrec.llm.common import arrow_schema, as_batch, bound_batches, map_batches, named

#: Buckets of hashed words, dimensions of the latent space, rounds of its iteration.
WORDS, DIMENSIONS, ROUNDS = 1 << 14, 48, 4
#: Beside the words: shares of the byte values in the text, and steps of two shares of repetition.
STEPS = 8
TERMS = WORDS + 256 + 2 * (STEPS + 1)
#: Weight of a text's bytes, whose shares add up to one, against its words, whose vector has length one.
BYTES_WEIGHT = 3.0
#: Labelled documents of each label that are fitted, those with the least hash of the id: a bounded sample.
SAMPLE_EACH = 2_000
#: Neighbours that vote, and how steeply similarity weighs.
NEIGHBOURS, STEEPNESS = 25, 8.0
#: Documents whose similarities are computed at a time.
BLOCK = 256


def terms(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights) of each text: its words, bytes, and how much its words and lines repeat.

    A word's weight is one plus the logarithm of its count, and the words' weights have length one
    together. Long texts are described as fully as short ones.
    """
    numbers, sizes = words(texts)
    stops = np.cumsum(sizes)
    out = []
    for text, stop, size in zip(texts, stops.tolist(), sizes.tolist(), strict=True):
        own = numbers[stop - size : stop]
        at, n = np.unique(own & (WORDS - 1), return_counts=True)
        weight = 1 + np.log(n)
        weight /= np.sqrt((weight * weight).sum()) or 1.0
        bytes_in = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        values = np.flatnonzero(bytes_in)
        lines = text.split(b"\n")
        repeats = [1 - len(set(lines)) / len(lines), 1 - len(np.unique(own)) / max(1, size)]
        steps = [WORDS + 256 + i * (STEPS + 1) + round(STEPS * share) for i, share in enumerate(repeats)]
        out.append((
            np.concatenate([at, WORDS + values, steps]),
            np.concatenate([weight, BYTES_WEIGHT * bytes_in[values] / max(1, len(text)), [1.0, 1.0]]).astype(np.float32),
        ))
    return out


class Model:
    """Rarity of the terms, the axes of the latent space, and the labelled vectors in it."""

    def __init__(self, rarity: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.rarity, self.axes, self.vectors = rarity, axes.astype(np.float32), vectors.astype(np.float32)
        self.labels = labels
        share = labels.mean() if len(labels) else 0.5
        # Each label has the same say in all, whatever its share of the sample.
        self.say = np.where(labels == 1, 1 / max(share, 1e-9), 1 / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(labels))

    def project(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), np.float32)
        for i, (at, weight) in enumerate(terms(texts)):
            out[i] = (weight * self.rarity[at]) @ self.axes[at]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled documents."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out, near = np.zeros(len(texts)), min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            cosine = self.project(texts[a : a + BLOCK]) @ self.vectors.T
            best = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            weight = np.exp(STEEPNESS * np.take_along_axis(cosine, best, axis=1).astype(float)) * self.say[best]
            out[a : a + BLOCK] = (weight * (self.labels[best] == 1)).sum(axis=1) / weight.sum(axis=1)
        return out


def _rarity(rows: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the term)), over all documents."""
    out = arrow_schema("bucket int, n bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for at, _ in terms([t or b"" for t in batch["text"].to_pylist()]):
                n[at] += 1
            n[TERMS] += batch.num_rows
        full = np.flatnonzero(n)
        yield as_batch({"bucket": full, "n": n[full]}, out)

    n = np.zeros(TERMS + 1)
    for row in rows.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        n[row[0]] = row[1]
    return np.log((1 + n[TERMS]) / (1 + n[:TERMS])).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column | bool = True, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_each: int = SAMPLE_EACH,
) -> Model:
    """Fit on labelled rows of ``docs`` for which ``learn``, of its columns, holds.

    Rarity is counted over all documents. The sample has at most ``sample_each`` documents of label 0
    and of label 1; other labels are ignored, and of an id with several the least counts. The axes
    are the leading right singular vectors of the sample's weighted terms, by subspace iteration.
    """
    bound_batches(docs.sparkSession)
    all_rows = docs.select(named(text_col).cast("binary").alias("text"))
    rarity = _rarity(all_rows)
    marks = labels.select(named(id_col).cast("bigint").alias("doc_id"), named(label_col).cast("int").alias("label")).where("label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"))
    known = docs.where(F.lit(learn) if isinstance(learn, bool) else learn).select(
        named(id_col).cast("bigint").alias("doc_id"), named(text_col).cast("binary").alias("text")
    )
    # The ids are chosen before any text moves.
    ids = known.select("doc_id").distinct().join(marks, "doc_id")
    chosen = None
    for label in (0, 1):
        part = ids.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_each)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = chosen.toArrow()
    numbers = dict(zip(picked["doc_id"].to_pylist(), picked["label"].to_pylist(), strict=True))
    table = docs.sparkSession.createDataFrame(picked, "doc_id bigint, label int") if numbers else chosen
    sample = known.join(F.broadcast(table), "doc_id")

    def weigh(batch: pa.RecordBatch) -> dict[str, object]:
        found = terms([t or b"" for t in batch["text"].to_pylist()])
        return {"doc_id": batch["doc_id"], "label": batch["label"], "at": [a for a, _ in found], "weight": [w * rarity[a] for a, w in found]}

    rows = map_batches(sample, weigh, "doc_id bigint, label int, at array<int>, weight array<float>").toArrow().sort_by("doc_id")
    ats = [np.array(x, np.int64) for x in rows["at"].to_pylist()]
    weights = [np.array(x, np.float32) for x in rows["weight"].to_pylist()]
    norms = [np.sqrt((w * w).sum()) or 1.0 for w in weights]
    weights = [w / n for w, n in zip(weights, norms, strict=True)]
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(TERMS, DIMENSIONS)))[0].astype(np.float32)
    for _ in range(ROUNDS):
        image = np.zeros_like(basis)
        for at, w in zip(ats, weights, strict=True):
            image[at] += np.outer(w, w @ basis[at])
        basis = np.linalg.qr(image)[0].astype(np.float32)
    vectors = np.array([w @ basis[a] for a, w in zip(ats, weights, strict=True)]).reshape(len(ats), DIMENSIONS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Model(rarity, basis, vectors / np.where(length > 0, length, 1), np.array(rows["label"].to_pylist(), np.int64))


def predict(docs: DataFrame, model: Model, text_col: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns and score, from 0 to 1, of each row of ``docs``.

    Null texts are empty; an empty text has a score like any other. Without labelled documents every
    score is 0.5. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[named(c) for c in keep], named(text_col).cast("binary").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def score(batch: pa.RecordBatch) -> dict[str, object]:
        return {c: batch[c] for c in keep} | {"score": shared.value.score([t or b"" for t in batch["_text"].to_pylist()])}

    return map_batches(rows, score, f"{fields}, score double")
