import math

import numpy as np
import pytest

from itemrec.llm import whitening

SMALL = "/root/testdata/sf0.001/embeddings.parquet"


def by_definition(rows, wanted=32):
    """{(id, component): (n, deviation, whitened, explained)} for distinct ids, and the number of components."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(rows), [sum(c) for c in zip(*x, strict=True)]
    mean = [s // n for s in sums]
    y = np.array([[c - m for c, m in zip(r, mean, strict=True)] for r in x], float) - np.array([(s - n * m) / n for s, m in zip(sums, mean, strict=True)])
    values, directions = np.linalg.eigh(y.T @ y / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(wanted, int((values > 1e-12 * values[0]).sum()))
    z = y @ directions[:, :k] / np.sqrt(values[:k])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return {(i, j + 1): (n, deviation[m], z[m, j], values[j] / values.sum()) for m, (i, _) in enumerate(rows) for j in range(k)}, k


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, X int")
    found = {(r.vec_id, r.component): r for r in whitening.whiten(df, **options).collect()}
    rows = [(i, v if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    want, k = by_definition(rows, options.get("wanted", 32))
    assert found.keys() == want.keys()
    for j in range(1, k + 1):
        keys = [key for key in want if key[1] == j]
        a, b = np.array([found[key].whitened for key in keys]), np.array([want[key][2] for key in keys])
        np.testing.assert_allclose(a * np.sign(a @ b), b, atol=1e-8)
    for key, r in found.items():
        assert (r.n, int(r.deviation)) == want[key][:2]
        assert abs(r.explained / want[key][3] - 1) < 1e-9 and r.identity_error < 1e-9


def test_embeddings(spark):
    check(spark, [(r.vec_id, r.embedding) for r in spark.read.parquet(SMALL).collect()])


def test_odd_rows(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.standard_normal(5).tolist()) for i in range(30)]
    rows += [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [float("nan")] * 5), (53, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, random.standard_normal(5).tolist())]
    check(spark, rows)
    check(spark, rows, wanted=2)


def test_repeated_rows_count(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-1.0, 3.0]), (3, [2.0, 0.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert len(found) == 8 and {r.n for r in found} == {4}


def test_no_components(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], kind))


def test_fewer_directions_than_dimensions(spark):
    """Vectors in a space of 3 dimensions, written in 60: three components."""
    random = np.random.default_rng(2)
    turn = random.integers(-3, 4, (3, 60)).astype(float)
    check(spark, [(i, (random.integers(-40, 40, 3) @ turn / 64).tolist()) for i in range(80)])


def test_filter_damps_what_lies_below(spark):
    """One filter raises wanted directions over those between the bounds by as much as the polynomial says."""
    values = np.array([9.0, 8.0, 7.0, 2.0, 1.5, 1.2, 1.0])

    class Known:
        passes = 0

        def times(self, block):
            return values[:, None] * block

    block = np.linalg.qr(np.random.default_rng(3).standard_normal((7, 4)))[0]
    out = whitening.chebyshev(Known(), block, Known().times(block), np.array([9.0, 8.0, 7.0, 2.0]), 3, 1.0)
    gain = (out / block).mean(axis=1)
    assert np.allclose(out, gain[:, None] * block)
    assert np.abs(gain[3:]).max() < 1e-3 * np.abs(gain[:3]).min()


def test_wide_squares_stay_exact():
    x = np.array([[2**40, -(2**40)]])
    assert whitening._squares(x, 10**6, np.array([0, 0]), np.array([3, 5])) == [(10**6 * 2**40 - 3) ** 2 + (10**6 * 2**40 + 5) ** 2]
