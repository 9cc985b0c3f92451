"""Block products, cells and means against plain numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from itemrec.operators import ann, clustering, similarity
from itemrec.plans import profiles


def vectors_of(spark, n=120, width=6, seed=1, repeats=1):
    r = np.random.default_rng(seed)
    rows = [(f"g{i % 2}", f"v{i:03d}", [float(x) for x in r.normal(size=width)]) for i in range(n) for _ in range(repeats)]
    return spark.createDataFrame(rows, "k string, video_id string, embedding array<double>"), rows


def brute(rows, floor):
    best = {}
    for k, a, x in rows:
        for m, b, y in rows:
            if k == m and a != b:
                s = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
                best[(k, a, b)] = max(best.get((k, a, b), -2), s)
    return {p: round(s, 6) for p, s in best.items() if round(s, 6) >= floor}


def test_blocks_find_exactly_the_pairs_over_the_floor(spark):
    df, rows = vectors_of(spark, repeats=2)
    for block in (7, 5000):
        found = similarity.blocked_similarity(df, df, ["k"], 0.6, block).collect()
        assert {(r.k, r.query_video_id, r.candidate_video_id): round(r.similarity, 6) for r in found} == brute(rows, 0.6)
        assert len(found) == len(brute(rows, 0.6))


def test_listed_pairs_and_topk(spark):
    df, rows = vectors_of(spark, n=20)
    want = brute([("g", b, c) for _, b, c in rows], -2)
    ids = df.select("video_id")
    pairs = ids.select(F.col("video_id").alias("query_video_id")).join(ids.select(F.col("video_id").alias("candidate_video_id")), F.lit(True))
    got = {("g", r.query_video_id, r.candidate_video_id): r.similarity for r in similarity.pair_similarity(pairs, df).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in got)
    top = similarity.similarity_topk(pairs, df, 3).groupBy("query_video_id").count().collect()
    assert {r["count"] for r in top} == {3}


def clustered(spark, n=240, width=8, seed=2, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    rows = [("g", f"v{i:03d}", (centres[i % 12] + spread * r.normal(size=width)).tolist()) for i in range(n)]
    return spark.createDataFrame([x[1:] for x in rows], "video_id string, embedding array<double>"), rows


def test_lists_report_true_similarities_with_good_recall(spark):
    for df, rows, floor, probes in ((*vectors_of(spark, n=200), 0.92, 6), (*clustered(spark), 0.95, 2)):
        near = {(a, b): s for (_, a, b), s in brute([("g", b, c) for _, b, c in rows], floor).items()}
        index = ann.InvertedFile(df.select("video_id", "embedding"))
        found = {(r.query_video_id, r.candidate_video_id): r.similarity for r in index.near(df, floor, probes).collect()}
        assert set(found) <= set(near) and all(abs(found[p] - near[p]) < 2e-6 for p in found)
        assert len(found) >= 0.9 * len(near) > 0
        # with no limit of probes the bound alone leaves lists out, and nothing is missed
        assert {(r.query_video_id, r.candidate_video_id) for r in index.near(df, floor).collect()} == set(near)
        assert index.probes(df, floor, None).count() < len(rows) * len(index.centres)
        best = index.near(df, floor, k=1).collect()
        assert {r.query_video_id: r.similarity for r in best} == {a: max(s for (x, _), s in near.items() if x == a) for a, _ in near}


def test_index_of_copies_and_of_nothing(spark):
    kind = "video_id string, embedding array<double>"
    copies = spark.createDataFrame([(f"v{i}", [1.0, 0.0]) for i in range(50)] + [("w", [1.0, 0.1])], kind)
    assert {(r.query_video_id, r.candidate_video_id) for r in ann.similarity_ann(copies, copies, 0.9).collect()} == {("v0", "w"), ("w", "v0")}
    assert ann.similarity_ann(copies, copies.limit(0), 0.9).collect() == []


def neighbours(rows, k):
    out = set()
    for _, a, x in rows:
        scores = sorted((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6), b) for _, b, y in rows if a != b)
        out |= {(a, b, i + 1) for i, (_, b) in enumerate(scores[:k])}
    return out


def test_pivots_find_the_nearest_of_every_row_and_prune(spark):
    for df, rows, least in ((*vectors_of(spark, n=90), 0.0), (*clustered(spark, spread=0.05), 0.3)):
        join = ann.PivotJoin(similarity.unit_vectors(df.select("video_id", "embedding")), "video_id", 5)
        for block in (2_000, 11):
            found = join.neighbours(block).collect()
            assert {(r.video_id, r.neighbour, r.place) for r in found} == neighbours(rows, 5)
        assert join.pruned() >= least  # on separate groups many pairs are never compared


def test_fewer_rows_than_neighbours(spark):
    units = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "video_id string, unit array<double>")
    found = {(r.video_id, r.neighbour, r.place) for r in ann.PivotJoin(units, "video_id", 10).neighbours().collect()}
    assert found == {("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2)}
    assert ann.PivotJoin(units.limit(0), "video_id", 3).neighbours().collect() == []


def test_quality_of_given_labels_equals_the_pairwise_definition(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 3)) + np.arange(40)[:, None] % 3
    labels = np.array([i % 3 for i in range(39)] + [7])
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(labels, x)], "cluster int, embedding array<double>")
    gaps = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    scores = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = gaps[i][own].sum() / (own.sum() - 1)
        b = min(gaps[i][labels == o].mean() for o in set(labels) - {c})
        scores.append((b - a) / max(a, b))
    cost = sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels))
    got = clustering.cluster_quality(df).first()
    assert abs(got.silhouette - np.mean(scores)) < 1e-9 and abs(got.training_cost - cost) < 1e-9 and got.members == 40
    assert clustering.cluster_quality(df.withColumn("cluster", F.lit(1))).first().silhouette == 0


def test_cluster_means_need_no_pairs(spark):
    df, rows = vectors_of(spark, n=30)
    users = df.select(F.substring("k", 2, 1).cast("int").alias("cluster_id"), "embedding")
    got = {(r.cluster_x, r.cluster_y): (r.mean_similarity, r.pairs) for r in similarity.cluster_similarity_matrix(users).collect()}
    unit = {k: np.array([np.array(x) / np.linalg.norm(x) for g, _, x in rows if g == f"g{k}"]) for k in (0, 1)}
    full = unit[0] @ unit[0].T
    assert abs(got[(0, 0)][0] - (full.sum() - 15) / (15 * 14)) < 1e-9 and got[(0, 0)][1] == 105
    assert abs(got[(0, 1)][0] - (unit[0] @ unit[1].T).mean()) < 1e-9 and got[(0, 1)][1] == 225


def test_mean_equals_the_exploded_form(spark, tables):
    a = profiles.avg_embedding(tables.item_index).select("video_id", F.posexplode("avg_embedding").alias("p", "x"))
    b = profiles.avg_embedding_exploded(tables.item_index).select("video_id", F.posexplode("avg_embedding").alias("p", "y"))
    assert a.join(b, ["video_id", "p"], "full").where("x is null or y is null or abs(x - y) > 1e-12").count() == 0


def test_choice_of_k():
    assert clustering.choose_k({6: (0.1, 5.0)}, 8) == 6
    nan = float("nan")
    assert clustering.choose_k({4: (0.9, 100.0), 6: (0.2, 40.0), 8: (nan, 35.0), 10: (0.1, 33.0)}, 5) == 6
    assert clustering.choose_k({4: (nan, 1.0), 6: (nan, 1.0)}, 8) == 8
    assert clustering.elbow({4: 100.0, 6: 40.0, 8: 35.0, 10: 33.0}) == 6


def test_separate_groups_are_found(spark):
    rows = [(f"v{i}", [float(i % 4) * 10 + (i % 3) * 0.1, float(i % 4 // 2) * 10]) for i in range(80)]
    df = spark.createDataFrame(rows, "video_id string, embedding array<double>")
    labelled, summary = clustering.fit_clusters(df, (3, 4, 5), 4, scale=True)
    groups = labelled.select("cluster", (F.substring("video_id", 2, 3).cast("int") % 4).alias("g")).distinct().collect()
    assert summary.where("chosen").first().k >= 4
    assert len({r.cluster for r in groups}) == len(groups)  # no cluster mixes groups


def test_a_row_goes_once_to_a_group_of_cells(spark):
    df, rows = vectors_of(spark, n=200)
    join = ann.PivotJoin(similarity.unit_vectors(df.select("video_id", "embedding")), "video_id", 5)
    for block, groups in ((200, 1), (60, 8)):
        group = ann.grouped_cells(join.pivots, join.sizes, block)
        assert len(set(group)) <= groups < len(join.pivots)
        assert all(join.sizes[group == g].sum() <= block or (group == g).sum() == 1 for g in group)
        assert join.sent(group).count() <= len(rows) * groups  # vectors without groups went to every cell before
    index = ann.InvertedFile(df.select("video_id", "embedding"))
    near = {(a, b) for (_, a, b) in brute([("g", b, c) for _, b, c in rows], 0.6)}
    for block in (200, 30):
        found = index.near(df, 0.6, block=block).select("query_video_id", "candidate_video_id").collect()
        assert len(found) == len(near) and {tuple(r) for r in found} == near


def test_largest_scores_keep_the_first_of_equal_ones():
    scores = np.array([[0.5, 0.9, 0.9000001, 0.9, -np.inf], [np.nan, -np.inf, 0.1, -np.inf, -np.inf]])
    at, column, values = ann._largest(scores, 2)
    assert list(zip(at, column, values)) == [(0, 1, 0.9), (0, 2, 0.9), (1, 2, 0.1)]


def test_pools_asked_in_groups_find_exactly_their_pairs(spark):
    """Pools of several parts, more than 64 to a group, items without vectors, rows that repeat and null keys."""
    r = random.Random(5)
    vectors = [(f"v{i}", [r.gauss(0, 1) for _ in range(4)]) for i in range(90) for _ in range(2)]
    pools = [(f"p{k}", f"v{r.randrange(95)}") for k in range(80) for _ in range(4)] + [("big", f"v{i}") for i in range(60)] + [(None, "v1"), ("p1", None)]
    asked = [(f"p{r.randrange(85)}", f"v{r.randrange(95)}") for _ in range(500)] + [("big", f"v{i}") for i in range(90)] + [("p1", None), (None, "v2")]
    known = spark.createDataFrame([*vectors, ("none", None)], "video_id string, embedding array<float>")
    at = {}
    for v, x in vectors:
        at.setdefault(v, []).append(np.array(x, np.float32).astype(float))
    want = {}
    for k, q in set(asked):
        for m, c in set(pools):
            if k is not None and k == m and q != c and q in at and c in at:
                s = round(max(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) for x in at[q] for y in at[c]), 6)
                if s >= 0.4:
                    want[k, q, c] = s
    asked, pools = spark.createDataFrame(asked, "pool_key string, query_video_id string"), spark.createDataFrame(pools, "pool_key string, video_id string")
    for sizes in ({}, {"part": 7, "together": 20, "block": 5}, {"part": 1000, "together": 100_000}):
        rows = similarity.pool_similarity(asked, pools, known, 0.4, **sizes).collect()
        assert {(x.pool_key, x.query_video_id, x.candidate_video_id): x.similarity for x in rows} == want
        assert len(rows) == len(want)
