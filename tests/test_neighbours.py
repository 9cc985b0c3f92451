"""Neighbours by products in single precision, settled in double precision, and what moves for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemrec.operators import ann, similarity


def by_definition(a, a_code, b, b_code, allowed, k):
    scores = np.round(a @ b.T, ann.PLACES)
    scores[(a_code[:, None] == b_code[None]) | ~allowed] = -np.inf
    best = [np.lexsort((np.arange(len(b)), -row))[:k] for row in scores]
    return {(r, int(c), float(scores[r, c])) for r, columns in enumerate(best) for c in columns if np.isfinite(scores[r, c])}


@pytest.mark.parametrize("kind", ["random", "copies", "codes", "pruned", "close"])
def test_single_precision_leaves_out_nothing(monkeypatch, kind):
    monkeypatch.setattr(ann, "PRODUCTS", 20_000)
    monkeypatch.setattr(ann, "SLICE", 64)
    rng = np.random.default_rng(3)
    b = rng.standard_normal((2500, 16))
    b = np.repeat(b[:25], 100, axis=0) if kind == "copies" else b[0] + b * 1e-3 if kind == "close" else b
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    code = np.arange(2500) // (3 if kind == "codes" else 1)
    cell, gap = rng.integers(0, 6, 2500), rng.random(2500)
    least = rng.random((6, 6)) * 1.5 if kind == "pruned" else np.full((6, 6), -np.inf)
    a, a_code, a_cell = b[::5], code[::5], cell[::5]
    found = {(int(r), int(c), float(v)) for x in ann.nearest_of(a, a_code, a_cell, b, code, cell, gap, least, 7) for r, c, v in zip(*x)}
    assert found == by_definition(a, a_code, b, code, gap[None] >= least[a_cell][:, cell], 7)


def test_rows_that_are_no_numbers_have_no_neighbours():
    b = np.array([[1.0, 0.0], [np.nan, 0.0], [0.0, 1.0]])
    cell = np.zeros(3, int)
    found = [(int(r), int(c)) for x in ann.nearest_of(b, np.arange(3), cell, b, np.arange(3), cell, np.ones(3), np.zeros((1, 1)), 2) for r, c, _ in zip(*x)]
    assert sorted(found) == [(0, 2), (2, 0)]


def test_a_pair_of_blocks_is_a_partition(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((400, 8)))]
    join = ann.PivotJoin(similarity.unit_vectors(spark.createDataFrame(rows, "video_id string, embedding array<double>")), "video_id", 3)
    found = join.neighbours(100)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and "FlatMapGroupsInPandas" not in text  # groups of pandas rows are sorted, and spill
    assert found.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).where("n <> 3").isEmpty() and found.count() == 1200


def test_blocks_of_many_rows_are_large():
    assert ann.block_rows(900_000, ann.TILE) == ann.TILE > 5 * ann.MAX_BLOCK
