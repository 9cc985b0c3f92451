"""Neighbours by coarse cells: an inverted file for near pairs, and an exact nearest-neighbour join by pivots.

Both give every vector the cell of its nearest centre and use distances to centres to leave cells out:
with d the chord between unit vectors, d(q, x) >= d(q, c) - d(c, x). Centres are few and go to every task;
cells of any size are cut into blocks, and exact cosines are computed block by block. Small cells that are
near each other travel as one group, so a row goes once to each group that needs it, not once to each cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.operators.ranking import top_n
from itemrec.operators.similarity import PLACES, PRODUCTS, blocked_similarity, distinct_vectors, passing_pairs
from itemrec.runtime import store

#: Centres at most, and rows at most that they are fitted on; every row is indexed.
MAX_LISTS, FIT_ROWS = 1_024, 65_536
#: Rows of one block of a group of cells: for small tables, and at most; at most where neighbours are looked for, by products that are only compared.
BLOCK, MAX_BLOCK, TILE = 2_000, 16_000, 100_000
#: Rows of which a task holds all cells at a time.
SLICE = 1_000
#: What rounded similarities may hide of a squared distance.
SLACK = 4 * 10.0**-PLACES


def _chords(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices."""
    squares = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None] - 2 * left @ right.T
    return np.sqrt(np.maximum(squares, 0))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        for i in range(0, len(rows), SLICE):
            yield rows.iloc[i : i + SLICE]


def placed(units: DataFrame, centres: np.ndarray, key: str) -> DataFrame:
    """(key, unit, cell, gap): the nearest centre of each vector and its distance."""
    shared = units.sparkSession.sparkContext.broadcast(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _slices(frames):
            gaps = _chords(_stacked(rows["unit"]), shared.value)
            yield rows.assign(cell=gaps.argmin(axis=1), gap=gaps.min(axis=1))

    return units.select(key, "unit").mapInPandas(run, f"{key} {units.schema[key].dataType.simpleString()}, unit array<double>, cell int, gap double")


def block_rows(n: int, most: int = MAX_BLOCK) -> int:
    """Rows of a block: as many as keep a few dozen pairs of blocks for the tasks, and no more than a task holds easily."""
    return max(BLOCK, min(most, n // 8))


def grouped_cells(centres: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """The group of each cell: cells along a chain of nearest centres, ``block`` rows together; a larger cell is a group of its own."""
    group, number, rows, at = np.zeros(len(sizes), int), 0, 0, 0
    left = np.ones(len(sizes), bool)
    for _ in range(len(sizes)):
        left[at] = False
        if rows and rows + sizes[at] > block:
            number, rows = number + 1, 0
        group[at], rows = number, rows + sizes[at]
        if left.any():
            at = int(np.where(left, ((centres - centres[at]) ** 2).sum(axis=1), np.inf).argmin())
    return group


def meet(asking: DataFrame, offered: DataFrame, key: str, rows: list[tuple[int, int, int]], block: int, compare: Callable, schema: str) -> DataFrame:
    """``compare`` (two frames, giving frames) on each block of ``asking`` and each of ``offered`` of one group.

    Both have group, ``key``, unit, cell, gap; ``rows``: how many at most each group has on either side.
    """
    cuts = [(g, max(1, math.ceil(a / block)), max(1, math.ceil(b / block))) for g, a, b in rows]
    blocks = F.broadcast(asking.sparkSession.createDataFrame(cuts, "group int, na int, nb int"))  # a row for each group
    place = lambda n: F.expr(f"cast(pmod(xxhash64({key}), {n}) as int)")
    columns = ["group", "ab", "bb", "asks", key, "unit", "cell", "gap"]
    a = asking.join(blocks, "group").withColumn("ab", place("na")).withColumn("bb", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("asks", F.lit(True))
    b = offered.join(blocks, "group").withColumn("bb", place("nb")).withColumn("ab", F.explode(F.expr("sequence(0, na - 1)"))).withColumn("asks", F.lit(False))

    def run(_: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = pd.concat(list(batches), ignore_index=True)
        sides = met[met["asks"]], met[~met["asks"]]
        if not any(side.empty for side in sides):
            yield from compare(*sides)

    return a.select(*columns).unionByName(b.select(*columns)).groupBy("group", "ab", "bb").applyInPandas(run, schema)


def _chosen(units: np.ndarray, centres: np.ndarray, radius: np.ndarray, reach: float, most: int) -> np.ndarray:
    """Which lists each row looks in: the nearest ``most`` of those that can hold a vector within reach."""
    gaps = _chords(units, centres)
    order = gaps.argsort(axis=1, kind="stable")
    inside = np.take_along_axis(gaps <= radius[None] + reach, order, axis=1)
    out = np.zeros(gaps.shape, bool)
    np.put_along_axis(out, order, inside & (inside.cumsum(axis=1) <= most), axis=1)
    return out


class InvertedFile:
    """Vectors by the list of their nearest centroid, searched in the lists around each query.

    Exact copies are folded first; the smallest id stands for them. The centroids are fitted on at most
    ``FIT_ROWS`` rows chosen by hash, but every row is in a list.
    """

    def __init__(self, targets: DataFrame, lists: int | None = None, seed: int = 7, fit_rows: int = FIT_ROWS):
        units = store(distinct_vectors(targets).select("video_id", "unit"))
        n = units.count()
        count = min(MAX_LISTS, lists or max(1, round(math.sqrt(n))), max(1, n))
        sample = units.orderBy(F.xxhash64("video_id"), "video_id").limit(fit_rows).withColumn("dense", array_to_vector("unit"))
        sample = sample.repartition(units.sparkSession.sparkContext.defaultParallelism)  # a limit leaves its rows to one task
        self.centres = np.zeros((0, 0))
        self.rows = units.withColumn("cell", F.lit(0)).withColumn("gap", F.lit(0.0))
        self.radius, self.sizes = np.zeros(0), np.zeros(0, int)
        if n == 1:
            self.centres = np.array([units.first().unit])
        elif n:
            model = KMeans(k=max(2, count), seed=seed, featuresCol="dense", maxIter=10).fit(sample)
            self.centres = np.array(model.clusterCenters())
        if n:
            self.rows = store(placed(units, self.centres, "video_id"))
            self.radius, self.sizes = np.full(len(self.centres), -np.inf), np.zeros(len(self.centres), int)
            for r in self.rows.groupBy("cell").agg(F.max("gap"), F.count("*")).collect():  # one row for each list
                self.radius[r[0]], self.sizes[r[0]] = r[1], r[2]

    def probes(self, queries: DataFrame, floor: float, probes: int | float | None) -> DataFrame:
        """(video_id, unit, cell): the lists in which each query looks, nearest first.

        A list is left out if none of its vectors can be within reach. Of the others, the first
        ``probes`` are searched (below one: that share of the lists), or all: then no near pair is missed.
        """
        look = self._look(floor, probes)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in _slices(frames):
                at, cell = np.nonzero(_chosen(_stacked(rows["unit"]), *look))
                yield pd.DataFrame({"video_id": rows["video_id"].to_numpy()[at], "unit": rows["unit"].to_numpy()[at], "cell": cell})

        units = distinct_vectors(queries).select("video_id", "unit")
        return units.mapInPandas(run, "video_id string, unit array<double>, cell int")

    def _look(self, floor: float, probes: int | float | None) -> tuple:
        most = len(self.centres) if probes is None else probes if probes >= 1 else math.ceil(probes * len(self.centres))
        return self.centres, self.radius, math.sqrt(max(0.0, 2 - 2 * floor) + SLACK), most

    def near(self, queries: DataFrame, floor: float, probes: int | float | None = None, k: int | None = None, block: int | None = None) -> DataFrame:
        """(query_video_id, candidate_video_id, similarity) with a cosine of at least ``floor``; the best ``k`` of a query if given.

        Every pair found has its exact cosine. With ``probes`` some may be missed. A query goes once to each group
        of lists in one of which it looks; which of them those are is settled again beside them.
        """
        schema = "query_video_id string, candidate_video_id string, similarity double"
        if not len(self.centres):
            return queries.sparkSession.createDataFrame([], schema)
        block = block or block_rows(int(self.sizes.sum()))
        look, group = self._look(floor, probes), grouped_cells(self.centres, self.sizes, block)

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in _slices(frames):
                at, cell = np.nonzero(_chosen(_stacked(rows["unit"]), *look))
                at, to = np.unique(np.stack([at, group[cell]]), axis=1)
                yield pd.DataFrame({"group": to, "video_id": rows["video_id"].to_numpy()[at], "unit": rows["unit"].to_numpy()[at], "cell": -1, "gap": 0.0})

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
            chosen = np.concatenate([_chosen(_stacked(rows["unit"]), *look) for rows in _slices([left])])
            for cell, held in right.groupby("cell"):
                yield from passing_pairs(left[chosen[:, cell]], held, floor, "unit")

        asked = store(distinct_vectors(queries).select("video_id", "unit"))
        n, spark = asked.count(), queries.sparkSession
        cells = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "cell int, group int"))
        rows = [(int(g), n, int(self.sizes[group == g].sum())) for g in np.unique(group)]
        asking = asked.mapInPandas(ask, "group int, video_id string, unit array<double>, cell int, gap double")
        found = meet(asking, self.rows.join(cells, "cell"), "video_id", rows, block, compare, schema)
        found = found.withColumn("similarity", F.round("similarity", PLACES)).where(F.col("similarity") >= floor)
        if k is None:
            return found
        return top_n(found, ["query_video_id"], [F.col("similarity").desc(), F.col("candidate_video_id")], k).drop("rn")


def similarity_ann(queries: DataFrame, targets: DataFrame, floor: float, probes: int | float | None = 8, lists: int | None = None, k: int | None = None) -> DataFrame:
    """Near pairs by an inverted file: see ``InvertedFile.near``."""
    return InvertedFile(targets, lists).near(queries, floor, probes, k)


def ann_report(queries: DataFrame, targets: DataFrame, floor: float, probes: int | float | None, lists: int | None = None) -> DataFrame:
    """For each query with near pairs: how many there are, how many were found, and how many found ones are none.

    The exact pairs come from all blocks of both tables.
    """
    found = similarity_ann(queries, targets, floor, probes, lists).withColumn("found", F.lit(1))
    sides = [distinct_vectors(df).select(F.lit(0).alias("all"), "video_id", F.col("unit").alias("embedding")) for df in (queries, targets)]
    sides = [store(side) for side in sides]
    exact = blocked_similarity(*sides, ["all"], floor, block_rows(sides[1].count())).select("query_video_id", "candidate_video_id").withColumn("real", F.lit(1))
    both = exact.join(found.drop("similarity"), ["query_video_id", "candidate_video_id"], "full")
    return both.groupBy("query_video_id").agg(
        F.count("real").alias("exact_pairs"), F.count_if(F.col("real").isNotNull() & F.col("found").isNotNull()).alias("found_pairs"),
        F.count_if(F.col("real").isNull()).alias("false_pairs"),
    )


# ---- exact neighbours ------------------------------------------------------------------------

class PivotJoin:
    """The ``k`` nearest other rows of every row, exact, by Voronoi cells of pivots.

    For each cell, ``limit`` bounds how far the k-th neighbour of any of its rows can be, from the radius of the cell and
    the rows nearest to each pivot. A row is sent to a cell only if it can be within the limit of one
    of the cell's rows; a pair of cells for which no row can be is left out whole.
    """

    def __init__(self, units: DataFrame, key: str, k: int, pivots: int | None = None):
        """``units``: ``key``, ``unit`` (of length one); rows of one key are refused by none, but ties go by key."""
        self.key, self.k = key, k
        stored = store(units.select(key, "unit"))
        n = stored.count()
        chosen = stored.orderBy(F.xxhash64(key), key).limit(min(MAX_LISTS, pivots or max(1, round(math.sqrt(n)))))
        self.pivots = np.array([r.unit for r in chosen.collect()]).reshape(-1, len(chosen.first().unit) if n else 1)
        self.rows = store(placed(stored, self.pivots, key)) if n else stored.withColumn("cell", F.lit(0)).withColumn("gap", F.lit(0.0))
        self.bounds()

    def bounds(self) -> None:
        """``radius`` and ``limit`` of each cell, and ``least[i, j]``: the distance from pivot j from which a row of j can matter to cell i."""
        m = len(self.pivots)
        self.radius, self.sizes, nearest = np.full(m, -np.inf), np.zeros(m, int), []
        for r in self.rows.groupBy("cell").agg(F.max("gap"), F.count("*")).collect():
            self.radius[r[0]], self.sizes[r[0]] = r[1], r[2]
        closest = top_n(self.rows.select("cell", "gap", self.key), ["cell"], [F.col("gap"), F.col(self.key)], self.k + 1)
        for r in closest.select("cell", "gap").collect():  # k + 1 rows for each pivot
            nearest.append((r.cell, r.gap))
        apart = _chords(self.pivots, self.pivots) if m else np.zeros((0, 0))
        cells, gaps = (np.array([x[i] for x in nearest]) for i in (0, 1)) if nearest else (np.zeros(0, int), np.zeros(0))
        self.limit = np.full(m, np.inf)
        if len(gaps) > self.k:
            farthest = self.radius[:, None] + apart[:, cells.astype(int)] + gaps[None]
            self.limit = np.sqrt(np.partition(farthest, self.k, axis=1)[:, self.k] ** 2 + SLACK)
        self.least = np.full((m, m), np.inf)  # cells without rows ask for none
        full = np.isfinite(self.radius)
        self.least[full] = apart[full] - self.radius[full, None] - self.limit[full, None]

    def sent(self, group: np.ndarray) -> DataFrame:
        """(group, key, unit, cell, gap): every row beside each group of cells to one of which it can matter."""
        key, numbers = self.key, np.unique(group)
        least = np.array([self.least[group == g].min(axis=0) for g in numbers]).reshape(len(numbers), len(group))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in _slices(frames):
                needed = rows["gap"].to_numpy()[:, None] >= least.T[rows["cell"].to_numpy()]
                yield rows.assign(groups=[numbers[x] for x in needed])

        schema = f"{key} {self.rows.schema[key].dataType.simpleString()}, unit array<double>, cell int, gap double, groups array<int>"
        return self.rows.mapInPandas(run, schema).withColumn("group", F.explode("groups")).drop("groups")

    def pruned(self) -> float:
        """Share of all (row, row) pairs that are never compared."""
        least, sizes = self.least, self.sizes

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in _slices(frames):
                needed = rows["gap"].to_numpy()[:, None] >= least.T[rows["cell"].to_numpy()]
                yield pd.DataFrame({"met": [int((needed @ sizes).sum())]})

        met = self.rows.select("cell", "gap").mapInPandas(run, "met bigint").agg(F.sum("met")).first()[0]
        return 1 - (met or 0) / max(1, int(sizes.sum()) ** 2)

    def neighbours(self, block: int | None = None) -> DataFrame:
        """(key, neighbour, similarity, place): best first, equal similarities by key.

        A task compares a block of a group of cells with a block of what was sent to it, cell by cell and without the rows that can't
        matter to the cell, and keeps the best of each row; blocks are merged by row. Each pair of blocks is a partition, which
        needs no sorting, and blocks are large, since a row moves once for each block of the other side.
        """
        key, k, least = self.key, self.k, self.least
        kind = self.rows.schema[key].dataType.simpleString()
        block = block or block_rows(int(self.sizes.sum()), TILE)
        group = grouped_cells(self.pivots, self.sizes, block)
        own = {g: int(self.sizes[group == g].sum()) for g in np.unique(group)}
        reached = lambda g: int(self.sizes[(self.radius >= self.least[group == g].min(axis=0))].sum())
        cuts, tiles = [], 0
        for g, n in own.items():
            a, b = max(1, math.ceil(n / block)), max(1, math.ceil(reached(g) / block))
            cuts.append((int(g), a, b, tiles))
            tiles += a * b
        schema = f"{key} {kind}, neighbour {kind}, similarity double"
        spark = self.rows.sparkSession
        if not tiles:
            return top_n(spark.createDataFrame([], schema), [key], [F.col("similarity").desc(), F.col("neighbour")], k, "place")
        cells = F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "cell int, group int"))
        blocks = F.broadcast(spark.createDataFrame(cuts, "group int, na int, nb int, first int"))  # a row for each group
        place = lambda n: F.expr(f"cast(pmod(xxhash64({key}), {n}) as int)")
        each = lambda n, at: F.explode(F.transform(F.sequence(F.lit(0), F.col(n) - 1), at))
        columns = ["tile", "asks", key, "unit", "cell", "gap"]
        a = self.rows.join(cells, "cell").join(blocks, "group").withColumn("tile", each("nb", lambda i: F.col("first") + place("na") * F.col("nb") + i)).withColumn("asks", F.lit(True))
        b = self.sent(group).join(blocks, "group").withColumn("tile", each("na", lambda i: F.col("first") + i * F.col("nb") + place("nb"))).withColumn("asks", F.lit(False))
        met = a.select(*columns).unionByName(b.select(*columns)).repartitionById(tiles, F.col("tile"))
        names = ["neighbour", "similarity"]

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [x for x in batches if x.num_rows]
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            del held
            left, right = rows.filter(rows["asks"]), rows.filter(pc.invert(rows["asks"]))
            del rows
            if not left.num_rows or not right.num_rows:
                return
            right = right.take(pc.sort_indices(right, [(key, "ascending")]))  # equal similarities go by key
            code = pa.chunked_array([*left[key].chunks, *right[key].chunks]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            found = nearest_of(_matrix(left), code[: left.num_rows], left["cell"].to_numpy(), _matrix(right), code[left.num_rows :], right["cell"].to_numpy(), right["gap"].to_numpy(), least, k)
            for at, column, values in found:
                yield pa.RecordBatch.from_arrays([left[key].take(pa.array(at)).combine_chunks(), right[key].take(pa.array(column)).combine_chunks(), pa.array(values)], [key, *names])

        found = met.drop("tile").mapInArrow(best, schema)
        return top_n(found, [key], [F.col("similarity").desc(), F.col("neighbour")], k, "place")


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def nearest_of(a: np.ndarray, a_code: np.ndarray, a_cell: np.ndarray, b: np.ndarray, b_code: np.ndarray, b_cell: np.ndarray, b_gap: np.ndarray,
               least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, rounded product) of the ``k`` best rows of ``b`` for each row of ``a``; rows of equal code are left out, of equal products the first rows win.

    Products are taken in single precision first, whose error has a bound. Only those that can be among the best by it are taken again in
    double precision, so results are those of double precision.
    """
    real = np.isfinite(b).all(axis=1)  # others are near nothing
    at_b = np.nonzero(real)[0]
    b, b_code, b_cell, b_gap = (b, b_code, b_cell, b_gap) if real.all() else (b[real], b_code[real], b_cell[real], b_gap[real])
    if not len(b):
        return
    rows_of = np.argsort(a_cell, kind="stable")
    rows_of = rows_of[np.isfinite(a[rows_of]).all(axis=1)]
    b32, order_b = b.astype(np.float32), np.argsort(b_code, kind="stable")
    sorted_code, length = b_code[order_b], math.sqrt((b**2).sum(axis=1).max())
    parts = [(rows, np.nonzero(b_gap >= least[a_cell[rows[0]]][b_cell])[0]) for rows in np.split(rows_of, np.nonzero(np.diff(a_cell[rows_of]))[0] + 1) if len(rows)]
    to_all = [rows for rows, near in parts if len(near) == len(b)]  # cells to which every row matters are compared together
    parts = [(rows, near) for rows, near in parts if 0 < len(near) < len(b)] + ([(np.concatenate(to_all), np.arange(len(b)))] if to_all else [])
    for rows, near in parts:
        whole = len(near) == len(b)
        to32 = b32 if whole else b32[near]
        for i in range(0, len(rows), SLICE):
            asked = rows[i : i + SLICE]
            exact, mine = a[asked], a_code[asked]
            single = exact.astype(np.float32)
            slack = 10.0**-PLACES + 2 * (a.shape[1] + 4) * 2.0**-23 * length * math.sqrt((exact**2).sum(axis=1).max())
            # rows of b with the code of an asking row, by their places among the near ones
            low, high = np.searchsorted(sorted_code, mine), np.searchsorted(sorted_code, mine, "right")
            who = np.repeat(np.arange(len(asked)), high - low)
            same = order_b[np.concatenate([np.arange(x, y) for x, y in zip(low, high)])] if len(who) else np.zeros(0, int)
            if not whole:
                spot = np.minimum(np.searchsorted(near, same), len(near) - 1)
                kept = near[spot] == same
                who, same = who[kept], spot[kept]
            bound, best = np.full(len(asked), -np.inf, np.float32), []
            width = max(8, PRODUCTS // len(asked) // 8 * 8)
            step = max(1, min(12, len(near) // 1_000))
            if len(near) // step > k:  # the best of a part of the rows tell which of the others need not be looked at
                some = single @ to32[::step].T
                inside = same % step == 0
                some[who[inside], same[inside] // step] = -np.inf
                bound = np.partition(some, -k, axis=1)[:, -k]
            for j in range(0, len(near), width):
                scores = single @ to32[j : j + width].T
                inside = (same >= j) & (same < j + width)
                scores[who[inside], same[inside] - j] = -np.inf
                flat = _true(scores >= (bound - slack)[:, None])
                at, column = flat // scores.shape[1], flat % scores.shape[1]
                many = np.nonzero(np.bincount(at, minlength=len(asked)) > 32 * k)[0]
                if len(many) and scores.shape[1] >= k:
                    bound[many] = np.maximum(bound[many], np.partition(scores[many], -k, axis=1)[:, -k])
                    left = scores[at, column] >= (bound - slack)[at]
                    at, column = at[left], column[left]
                left = np.isfinite(scores[at, column])
                at, column = at[left], column[left] + j
                for part in range(0, len(at), PRODUCTS // 64 + 1):
                    r, c = (x[part : part + PRODUCTS // 64 + 1] for x in (at, column))
                    best.append(_first(r, c, np.round(np.einsum("ij,ij->i", exact[r], b[c if whole else near[c]]), PLACES), k))
            at, column, values = _first(*[np.concatenate(x) for x in zip(*best)], k) if best else (np.zeros(0, int),) * 3
            yield asked[at], at_b[column if whole else near[column]], values.astype(float)


def _true(passes: np.ndarray) -> np.ndarray:
    """Flat places of what is true, which is little: eight at a time are looked at."""
    if passes.size % 8:
        return np.flatnonzero(passes)
    eights = np.flatnonzero(passes.reshape(-1).view(np.uint64) != 0)
    row, column = np.nonzero(passes.reshape(-1, 8)[eights])
    return eights[row] * 8 + column


def _first(at: np.ndarray, column: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest of each row; of equal ones the first columns."""
    order = np.lexsort((column, -values, at))
    at, column, values = at[order], column[order], values[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[kept], column[kept], values[kept]


def _largest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the ``k`` largest finite scores of each row, rounded; of equal ones the first columns."""
    scores[np.isnan(scores)] = -np.inf
    k = min(k, scores.shape[1])
    kth = np.partition(scores, -k, axis=1)[:, -k]
    at, column = np.nonzero(scores >= np.round(kth, PLACES)[:, None] - 10.0**-PLACES)
    values = np.round(scores[at, column], PLACES)
    order = np.lexsort((column, -values, at))
    at, column, values = at[order], column[order], values[order]
    kept = (np.arange(len(at)) - np.searchsorted(at, at) < k) & np.isfinite(values)
    return at[kept], column[kept], values[kept]
