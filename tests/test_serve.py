"""Serving rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from itemrec.operators import pools, tiers
from itemrec.plans import serve


def ranked_rows(spark, rows):
    return spark.createDataFrame(rows, "user_id string, query_video_id string, type_num int, candidate_video_id string, similarity double")


def history(spark, rows):
    return spark.createDataFrame(rows, "user_id string, video_id string, mean_percentage_watched double, last_watched_timestamp string")


@pytest.fixture
def queries(spark):
    return serve.query_items(history(spark, [("u", "new", 0.5, "2001-02-01 00:00:00"), ("u", "old", 1.0, "2001-01-01 00:00:00")]))


def test_query_order_threshold_and_importance(spark):
    rows = [("u", "a", 0.1, "2001-01-01 00:00:00"), ("u", "b", 0.09, "2001-02-01 00:00:00"), ("u", "c", 0.6, "bad"), ("u", "d", 0.3, "2001-03-01 00:00:00"),
            ("one", "x", 1.0, None)]
    got = {(r.user_id, r.query_video_id): (r.pos, r.n, round(r.importance, 6)) for r in serve.query_items(history(spark, rows)).collect()}
    assert got == {("u", "d"): (0, 3, 0.86), ("u", "a"): (1, 3, round(0.8 * 2 / 3 + 0.02, 6)), ("u", "c"): (2, 3, round(0.8 / 3 + 0.12, 6)), ("one", "x"): (0, 1, 1.0)}


def test_first_occurrence_wins_for_personal_and_best_for_pools(spark, queries):
    rows = [
        ("u", "new", 2, "c1", 0.5), ("u", "old", 1, "c1", 0.9),   # newer query first, although the later score is higher
        ("u", "new", 5, "p1", 0.5), ("u", "old", 3, "p1", 0.9),   # pools take the best score
        ("u", "new", 1, "low", 0.39), ("u", "new", 1, "edge", 0.40),
        ("u", "new", 6, "c1", 0.8),                               # in both lists
    ]
    got = {(r.is_pool, r.candidate_video_id): (round(r.score, 6), r.position) for r in serve.mix(ranked_rows(spark, rows), queries).collect()}
    new, old = 0.8 + 0.1, 0.8 * 0.5 + 0.2
    assert got == {
        # equal scores keep the order of processing: kind 1 before kind 2
        (False, "edge"): (round(new * 1.0 * 0.4, 6), 1), (False, "c1"): (round(new * 0.8 * 0.5, 6), 2),
        (True, "p1"): (round(old * 0.6 * 0.9, 6), 1), (True, "c1"): (round(new * 0.3 * 0.8, 6), 2),
    }


def test_cap_comes_before_the_floor_and_only_for_personal(spark, queries):
    rows = [("u", "new", 1, f"c{i:02d}", 0.9 - i * 0.01) for i in range(17)] + [("u", "new", 6, f"p{i:02d}", 0.9) for i in range(20)]
    got = serve.mix(ranked_rows(spark, rows), queries).collect()
    assert {r.candidate_video_id for r in got if not r.is_pool} == {f"c{i:02d}" for i in range(15)}
    assert sum(r.is_pool for r in got) == 20


def test_mix_does_not_depend_on_partitions(spark, queries):
    rows = [("u", q, k, f"c{i % 9}", 0.4 + (i * 7 % 50) / 100) for i in range(60) for q in ("new", "old") for k in (1 + i % 6,)]
    frame = ranked_rows(spark, rows).dropDuplicates(["user_id", "query_video_id", "type_num", "candidate_video_id"]).checkpoint()
    once = sorted(map(tuple, serve.mix(frame.repartition(1), queries).collect()))
    assert once == sorted(map(tuple, serve.mix(frame.repartition(7, "candidate_video_id"), queries).collect()))


def test_mix_sum_adds_pool_scores_and_lists_sources(spark, queries):
    rows = [("u", "new", 5, "p", 0.6), ("u", "old", 3, "p", 0.9), ("u", "new", 1, "c", 0.7), ("u", "old", 1, "c", 0.7)]
    got = {r.candidate_video_id: r for r in serve.mix_sum(ranked_rows(spark, rows), queries, with_sources=True).collect()}
    assert round(got["p"].score, 6) == round(0.9 * 0.4 * 0.6 + 0.6 * 0.6 * 0.9, 6) and got["p"].source_count == 2
    assert got["c"].source_count == 1 and [s.query_video_id for s in got["p"].sources] == ["new", "old"]


def test_filters_keep_order_and_empty_sets(spark):
    rows = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("u", "a", 3), ("w", "a", 1)], "user_id string, video_id string, position int")
    none = spark.createDataFrame([], "user_id string, video_id string")
    once = serve.dedup_preserve_order(rows)
    assert sorted((r.user_id, r.video_id, r.position) for r in once.collect()) == [("u", "a", 1), ("u", "b", 2), ("w", "a", 1)]
    seen = spark.createDataFrame([("u", "a")], "user_id string, video_id string")
    assert sorted(r.video_id + r.user_id for r in serve.filter_watched(once, none, seen).collect()) == ["aw", "bu"]
    assert serve.filter_duplicates(once, none).count() == 0
    assert {(r.user_id, r.video_id): r.seen for r in serve.split_by_flag(once, seen, "seen").collect()} == {("u", "a"): True, ("u", "b"): False, ("w", "a"): False}


def test_mapping_needs_both_parts(spark):
    rows = spark.createDataFrame([("v", "c", "1"), ("w", "c", "2"), ("x", "c", "3")], "video_id string, canister_id string, post_id string")
    mapping = spark.createDataFrame([("c", "1", "n", "9"), ("c", "2", "n", None)], "old_canister_id string, old_post_id string, canister_id string, post_id string")
    assert sorted(map(tuple, serve.apply_post_mapping(rows, mapping).collect())) == [("v", "n", "9"), ("w", "c", "2"), ("x", "c", "3")]


def test_user_without_cluster_gets_the_pools(spark):
    users = spark.createDataFrame([("u", "r")], "user_id string, region string")
    region = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "region string, video_id string, position int")
    popular = spark.createDataFrame([("p", 1), ("q", 2)], "video_id string, position int")
    untouched = spark.createDataFrame([("z", 1)], "video_id string, position int")
    watched = spark.createDataFrame([("u", "p"), ("u", "a")], "user_id string, video_id string")
    none = spark.createDataFrame([], "user_id string, video_id string")
    got = serve.fallback_recommendations(users, region, popular, untouched, watched, none).orderBy("position").collect()
    assert [r.video_id for r in got] == ["a", "b", "q", "z"]  # history filters the popular part only


def test_flag_of_equal_tier_in_next_cluster_is_null(spark):
    rows = [("clean", 0, 0, 5), ("clean", 0, 1, 5), ("clean", 1, 1, 5), ("clean", 2, 0, 5)]
    sizes = spark.createDataFrame(rows, "content_type string, cluster_id int, bin int, num_items long")
    flow = {(r.cluster_id, r.bin): (r.flag_compare, r.num_cx) for r in tiers.lag_tier(sizes).collect()}
    assert flow == {(0, 0): (False, 0), (0, 1): (True, 5), (1, 1): (None, 5), (2, 0): (False, 5)}


def test_history_cap_goes_by_id_or_recency(spark):
    rows = spark.createDataFrame([("u", f"v{i}", 10 - i) for i in range(5)], "user_id string, video_id string, d int").select(
        "user_id", "video_id", F.timestamp_seconds(F.col("d") * 86400).alias("last_watched_timestamp"))
    ids = lambda **k: sorted(r.video_id for r in pools.user_history(rows, "1970-01-12 00:00:00", size=2, **k).collect())
    assert ids() == ["v0", "v1"] and ids(recency=True) == ["v0", "v1"]
    assert sorted(r.video_id for r in pools.user_history(rows, "1970-01-12 00:00:00", days=4, size=9).collect()) == ["v0", "v1", "v2", "v3"][:4]


def test_recommendations_never_hold_watched_items(spark, tables):
    from itemrec.catalog import products

    found = products.catalogue_of(tables, "clean")
    rows = serve.recommend_all(found).checkpoint()
    assert rows.count() > 0
    assert rows.join(found.watched, ["user_id", "video_id"], "left_semi").count() == 0
    assert rows.join(found.reported, ["user_id", "video_id"], "left_semi").count() == 0
    assert rows.groupBy("user_id").agg(F.max("place").alias("m")).where("m > 50").count() == 0
    assert rows.groupBy("user_id", "video_id").count().where("count > 1").count() == 0


def test_first_that_are_not_excluded_equal_the_definition(spark):
    """Sketches so full that most rows are in doubt, and users without any exclusion."""
    import random

    r = random.Random(3)
    rows = [(f"u{u}", f"v{v:03d}", r.random()) for u in range(6) for v in range(120)]
    gone = {(f"u{u}", f"v{v:03d}") for u in range(5) for v in r.sample(range(120), 20 * u)} | {("u4", f"w{i}") for i in range(3_000)}
    df = spark.createDataFrame(rows, "user_id string, video_id string, score double")
    pairs = spark.createDataFrame(sorted(gone), "user_id string, video_id string")
    found = serve.Exclusions.of(pairs, pairs.limit(10), None)
    got = sorted((x.user_id, x.position, x.video_id) for x in found.first(df, ["user_id"], [F.col("score").desc()], F.lit(30)).collect())
    want = []
    for u in sorted({x[0] for x in rows}):
        left = sorted((x for x in rows if x[0] == u and x[:2] not in gone), key=lambda x: -x[2])[:30]
        want += [(u, i + 1, x[1]) for i, x in enumerate(left)]
    assert got == want
    doubt = df.join(found.sketches, "user_id", "left").withColumn("d", serve.may_be_excluded(F.col("sketch"), F.col("video_id"))).collect()
    assert all(x.d for x in doubt if (x.user_id, x.video_id) in gone)
    assert not any(x.d for x in doubt if x.user_id in ("u0", "u5")) and sum(x.d for x in doubt if x.user_id == "u1") < 30


def test_every_user_with_enough_items_gets_a_full_page(spark, tables):
    """Whoever is short of a page has been offered every item there is for them."""
    from itemrec.catalog import products

    for content in products.CONTENTS:
        c = products.catalogue_of(tables, content)
        rows = serve.recommend_all(c).checkpoint()
        places = {r.user_id: (r.n, r.last) for r in rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("place").alias("last")).collect()}
        assert all(n == last <= 50 for n, last in places.values())
        chains = {r.region: r.chain for r in serve.fallback_chains(c.region_pool, c.popular, c.untouched, c.metadata).collect()}
        gone = {(r.user_id, r.video_id) for p in (c.watched, c.live_watched, c.reported) for r in p.select("user_id", "video_id").collect()}
        for u in c.users.collect():
            eligible = [v for v in chains.get(u.region, chains[None]) if (u.user_id, v) not in gone]
            assert places.get(u.user_id, (0, 0))[0] >= min(50, len(eligible)), u
        assert rows.where("origin = 'fallback'").count() > 0


def test_fallback_rows_of_users_and_items_are_not_shuffled(spark):
    users = spark.createDataFrame([("a", "r"), ("b", None), ("c", "r"), ("c", "s"), (None, "r")], "user_id string, region string")
    region = spark.createDataFrame([("r", "r1", 1), ("r", "p1", 2), ("s", "s1", 1)], "region string, video_id string, position int")
    popular = spark.createDataFrame([("p1", 1), ("p2", 2)], "video_id string, position int")
    untouched = spark.createDataFrame([("t1", 1), ("p2", 2)], "video_id string, position int")
    pairs = lambda rows: spark.createDataFrame(rows, "user_id string, video_id string")
    watched, reported, excluded = pairs([("a", "p1"), ("a", "r1")]), pairs([("b", "p2"), (None, "p1")]), pairs([("a", "t1"), ("c", "r1")])
    rows = serve.fallback_recommendations(users, region, popular, untouched, watched, reported, excluded)
    got = {}
    for r in rows.collect():
        got.setdefault(r.user_id, []).append((r.position, r.source, r.video_id))
    assert {u: [x[1:] for x in sorted(v)] for u, v in got.items() if u != "c"} == {
        "a": [(0, "r1"), (0, "p1"), (1, "p2"), (2, "p2")], "b": [(1, "p1"), (2, "t1"), (2, "p2")],
        None: [(0, "r1"), (0, "p1"), (1, "p1"), (1, "p2"), (2, "t1"), (2, "p2")],
    }
    assert [x[1:] for x in sorted(got["c"])] == [(0, "s1"), (0, "p1"), (1, "p1"), (1, "p1"), (1, "p2"), (1, "p2"), (2, "t1"), (2, "t1"), (2, "p2"), (2, "p2")]
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]  # nothing is sorted, joined or numbered once the rows are made
    assert not any(x in above for x in ("Window", "Join", "Aggregate", "Repartition"))


def test_a_stored_stage_is_a_table_of_columns(spark):
    from itemrec.runtime import materialize

    kept = materialize(spark.range(100).selectExpr("id", "cast(id % 3 as string) as s"))
    assert kept.inputFiles() and "RDD" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count() == 100


def test_mix_gives_places_only_to_items_that_may_be_given(spark, queries):
    """Excluded items and own query items leave the sum, on both sides, and the others move up."""
    personal = spark.createDataFrame(
        [("u", "new", 1, "c1", 0.9, True), ("u", "new", 2, "c2", 0.8, True), ("u", "old", 1, "c3", 0.7, True), ("u", "old", 2, "c2", 0.99, True)],
        "user_id string, query_video_id string, type_num int, candidate_video_id string, similarity double, listed boolean",
    )
    asked = queries.select("user_id", "query_video_id", "pos", "importance").withColumn("pool_key", F.lit("global"))
    entries = [("new", [(6, "c1", 0.9), (6, "p1", 0.5), (6, "old", 0.9)]), ("old", [(6, "p1", 0.99), (6, "p2", 0.6), (6, "c2", 0.7)])]
    near = spark.createDataFrame([("global", *e) for e in entries], "pool_key string, query_video_id string, candidates array<struct<type_num int, candidate_video_id string, similarity double>>")
    scored = serve.Scored(personal, asked, near, 0.4)
    pairs = spark.createDataFrame([("u", "c1"), ("u", "c1"), ("w", "c2"), ("u", "x")], "user_id string, video_id string")
    got = serve.mix(scored, queries, exclusions=serve.Exclusions.of(pairs)).collect()
    assert sorted((r.is_pool, r.position, r.candidate_video_id, r.score) for r in got) == sorted(
        (r.is_pool, i, r.candidate_video_id, r.score)
        for side in (False, True)
        for i, r in enumerate(sorted((x for x in serve.mix(scored, queries).collect() if x.is_pool == side and x.candidate_video_id != "c1"), key=lambda x: x.position), 1)
    )
    assert {(r.is_pool, r.candidate_video_id) for r in got} == {(False, "c2"), (False, "c3"), (True, "p1"), (True, "p2"), (True, "c2")}


def test_refill_takes_the_first_of_the_chain_that_may_be_given(spark):
    """Only places that are left become rows, shared out to as many tasks as asked; a user who comes twice shares the places."""
    chains = spark.createDataFrame([("r", ["a", "b", "c", "d", "e"]), ("s", ["d", "z"]), (None, ["p", "q"])], "region string, chain array<string>")
    short = [("u", "r", 2, ["a"]), ("v", None, 5, None), ("w", "t", 1, ["p"]), ("x", "s", 3, []), ("y", "r", 3, None), ("y", "r", 3, None), ("g", "s", 1, ["d", "z"]), ("m", "r", 3, None), ("m", "s", 3, None)]
    pairs = spark.createDataFrame([("u", "b"), ("u", "k"), ("x", "z"), ("y", "b"), ("q", "p")], "user_id string, video_id string")
    found = serve.refill(
        spark.createDataFrame(short, "user_id string, region string, places int, taken array<string>"), chains, serve.Exclusions.of(pairs), 3
    )
    got = {}
    for r in found.orderBy("user_id", "position").collect():
        got.setdefault(r.user_id, []).append(r.video_id)
    assert {k: v for k, v in got.items() if k != "m"} == {"u": ["c", "d"], "v": ["p", "q"], "w": ["q"], "x": ["d"], "y": ["a", "a", "c"]}
    assert sorted(got["m"][:2]) == ["a", "d"] and got["m"][2] in ("b", "z")  # two regions: by place in each
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_exclusions_keep_only_pairs_of_items_that_can_be_offered(spark):
    pairs = spark.createDataFrame([("u", "a"), ("u", "b"), ("w", "a"), ("w", None), (None, "a")], "user_id string, video_id string")
    among = spark.createDataFrame([("a",), ("a",), (None,)], "video_id string")
    found = serve.Exclusions.of(pairs, None, pairs, among=among)
    assert sorted(((r.user_id or ""), r.video_id) for r in found.pairs.collect()) == [("", "a"), ("u", "a"), ("w", "a")]
