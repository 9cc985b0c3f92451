"""Pair scores against the plain definition, with and without very active users."""

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from itemrec.operators import iou


def interactions(spark, rows):
    return spark.createDataFrame(
        [(t, c, u, v, p) for t, c, u, v, p in rows], "content_type string, cluster_id int, user_id string, video_id string, mean_percentage_watched double"
    )


def sample_rows(users=40, items=60, seed=3):
    import random

    r = random.Random(seed)
    rows = []
    for c in (0, 1):
        for u in range(users):
            many = items if u < 3 else r.randint(1, 9)
            for v in r.sample(range(items), many if u != 2 else items // 2):
                rows.append(("clean", c, f"u{u}", f"v{v:02d}", r.choice([0.3, 0.6, 0.8, 0.9])))
                if r.random() < 0.08:
                    rows.append(("clean", c, f"u{u}", f"v{v:02d}", 0.95))
    return rows


def by_definition(rows):
    """{(cluster, x, y): (den, num, score)} over all pairs with num > 0, and kept pairs."""
    scored, kept = {}, {}
    for c in {r[1] for r in rows}:
        mins, done = {}, {}
        for _, cc, u, v, p in rows:
            if cc == c and p > 0.5:
                mins.setdefault(v, []).append(u)
            if cc == c and p > 0.75:
                done.setdefault(v, []).append(u)
        good = [v for v in mins if len(set(mins[v])) >= 2 and len(set(done.get(v, []))) >= 2]
        here = {}
        for x, y in permutations(good, 2):
            num = sum(1 for u in done[x] if u in set(done[y]))
            if num:
                den = len(mins[x]) + len(mins[y])
                here[(c, x, y)] = (den, num, int(num / den * 100 + 0.5) / 100 * 2)
        order = sorted(s for _, _, s in here.values())
        cut = order[-(-95 * len(order) // 100) - 1]
        scored.update(here)
        kept.update({k: v for k, v in here.items() if v[2] > cut})
    return scored, kept


@pytest.mark.parametrize("options", [
    {}, {"block": 4}, {"heavy_items": 20}, {"heavy_items": 20, "block": 5, "class_block": 7}, {"heavy_items": 0, "class_block": 11},
])
def test_candidates_equal_the_definition(spark, options):
    rows = sample_rows()
    scored, kept = by_definition(rows)
    got = {(r.cluster_id, r.video_id_x, r.video_id_y): (r.den, r.num, r.iou_modified) for r in iou.iou_candidates(interactions(spark, rows), **options).collect()}
    assert got == kept
    scores = iou.PairScores(interactions(spark, rows), **options)
    histogram = {(r.cluster_id, r.score): r.pairs for r in scores.histogram().collect()}
    assert histogram == dict(Counter((c, s) for (c, _, _), (_, _, s) in scored.items()))


def test_any_number_of_very_active_users(spark):
    """Seventy users with every second item or more: two words of bits, blocks of classes, no pair of theirs listed."""
    import random

    r = random.Random(5)
    rows = [("clean", 0, f"u{u:02d}", f"v{v:02d}", r.choice([0.6, 0.8, 0.9])) for u in range(70) for v in r.sample(range(24), 16)]
    rows += [("clean", 0, f"w{u}", f"v{v:02d}", 0.9) for u in range(9) for v in r.sample(range(24), 3)] + [("clean", 0, "u01", "v03", 0.8)] * 3
    scored, kept = by_definition(rows)
    scores = iou.PairScores(interactions(spark, rows), heavy_items=5, class_block=10)
    assert scores.heavy.items.agg(F.max(F.size("bits"))).first()[0] >= 4
    assert scores.heavy.light.select("user_id").distinct().count() == 9
    histogram = {(r.cluster_id, r.score): r.pairs for r in scores.histogram().collect()}
    assert histogram == dict(Counter((c, s) for (c, _, _), (_, _, s) in scored.items()))
    got = {(r.cluster_id, r.video_id_x, r.video_id_y): (r.den, r.num, r.iou_modified) for r in iou.iou_candidates(interactions(spark, rows), heavy_items=5, class_block=10).collect()}
    assert got == kept


@pytest.mark.parametrize("options", [{}, {"heavy_items": 6, "class_block": 5}, {"heavy_items": 0}])
def test_pairs_across_clusters_equal_the_definition(spark, options):
    import random

    r = random.Random(6)
    rows = sorted({(None, r.randint(0, 2), f"u{u}", f"v{v}", r.choice([0.6, 0.8])) for u in range(15) for v in r.sample(range(14), 3 if u > 4 else 12)}, key=str)
    mins, done = {}, {}
    for _, c, u, v, p in rows:
        mins.setdefault((c, v), set()).add(u)
        if p > 0.75:
            done.setdefault((c, v), set()).add(u)
    good = [k for k in mins if len(mins[k]) >= 2 and len(done.get(k, ())) >= 2]
    want = {(x[0], y[0], x[1], y[1]): (len(mins[x]) + len(mins[y]), len(done[x] & done[y])) for x in good for y in good if x[0] != y[0] and x[1] != y[1] and done[x] & done[y]}
    df = interactions(spark, rows).withColumnRenamed("cluster_id", "label")
    found = {(r.cluster_id_x, r.cluster_id_y, r.video_id_x, r.video_id_y): (r.den, r.num) for r in iou.pairs_across_clusters(df, "label", **options).collect()}
    assert found == want and want


def test_repeats_count_on_the_left_only(spark):
    rows = [("clean", 0, u, v, 0.9) for u in ("a", "b") for v in ("x", "y")] + [("clean", 0, "a", "x", 0.8)]
    got = {(r.x, r.y): (r.den, r.num) for r in iou.PairScores(interactions(spark, rows)).directed().collect()}
    assert got == {("x", "y"): (5, 3), ("y", "x"): (5, 2)}


def test_a_score_can_round_to_zero_and_still_count(spark):
    rows = [("clean", 0, u, v, 0.9) for u in ("a", "b") for v in ("x",)] + [("clean", 0, u, "y", 0.9) for u in ("b", "c")]
    rows += [("clean", 0, f"u{i}", v, 0.6) for i in range(150) for v in ("x", "y")]
    got = {(r.x, r.y): (r.den, r.num, r.score) for r in iou.PairScores(interactions(spark, rows)).directed().collect()}
    assert got == {("x", "y"): (304, 1, 0.0), ("y", "x"): (304, 1, 0.0)}


def test_profile_counts_unrelated_pairs(spark):
    rows = sample_rows(users=20, items=30)
    scored, _ = by_definition(rows)
    profile = iou.pair_score_profile(interactions(spark, rows)).collect()
    for c in (0, 1):
        related = sum(r.pairs for r in profile if r.cluster_id == c and r.score is not None)
        assert related == sum(1 for k in scored if k[0] == c)
    assert len({(r.cluster_id, r.score) for r in profile}) == len(profile)
