"""Plans: what reaches the scan, what stays in the JVM, and the catalogue itself."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from itemrec import catalog, quality
from itemrec.catalog import products
from itemrec.functions import ids, sql
from itemrec.operators import iou, pools, similarity, tiers
from itemrec.plans import profiles, serve
from itemrec.quality import expect_non_empty
from itemrec.sources import scans, sinks
from itemrec.sources.views import AS_OF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tables, tmp_path):
    path = str(tmp_path / "interaction")
    tables.interaction.write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(scans.scan_interactions(stored, "2000-01-01", "2000-12-31", users=["u1", "u2"]).select("user_id"))
    assert "PushedFilters: [" in text and "In(user_id, [u1,u2])" in text and "GreaterThanOrEqual(last_watched_timestamp" in text
    assert "liked" not in text.split("ReadSchema")[1]


def test_index_scan_leaves_vectors_unread(spark, tables, tmp_path):
    tables.item_index.write.parquet(str(tmp_path / "index"))
    text = plan(scans.scan_item_index(spark.read.parquet(str(tmp_path / "index")), ["uri", "post_id"], is_nsfw=True))
    assert "embedding" not in text.split("ReadSchema")[1]


def test_scan_limits(stored):
    assert [r[0] for r in scans.scan_interactions(stored, limit=3).select("user_id").collect()] and scans.scan_interactions(stored, limit=3).count() == 3


def test_means_have_partial_aggregation_and_no_python(tables):
    text = plan(profiles.avg_embedding(tables.item_index))
    assert text.count("ObjectHashAggregate") >= 2 and "Python" not in text


def test_audiences_avoid_expand(stored, tables):
    text = plan(iou.item_audiences(products.split(tables)))
    assert "Expand" not in text and "CartesianProduct" not in text


def test_windows_written_once_and_slices_replaced(spark, tmp_path):
    path = str(tmp_path / "slices")
    frame = lambda rows: spark.createDataFrame(rows, "content_type string, cluster_id int, v int")
    sinks.overwrite_slices(frame([("clean", 0, 1), ("clean", 1, 1), ("nsfw", 0, 1)]), path)
    sinks.overwrite_slices(frame([("clean", 1, 2)]), path)
    assert sorted((r.content_type, r.cluster_id, r.v) for r in spark.read.parquet(path).collect()) == [("clean", 0, 1), ("clean", 1, 2), ("nsfw", 0, 1)]
    bounds = spark.sql("select date'2001-01-01' as first, date'2001-01-31' as last")
    written = spark.sql("select date'2001-01-08' as window_start")
    assert [str(r[0]) for r in scans.pending_windows(bounds, written).orderBy("window_start").collect()] == ["2001-01-01", "2001-01-15", "2001-01-22", "2001-01-29"]


def test_empty_stage_fails(spark):
    with pytest.raises(ValueError):
        expect_non_empty(spark.range(0), "nothing")


def test_catalogue_is_consistent():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    for name, sql in catalog.ORACLES.items():
        assert catalog.expand(sql).lstrip().lower().startswith(("with", "select")), name


def test_pools_are_not_sorted_by_one_task_per_content_type(tables):
    for pool in (pools.popular_pool(tables.item_index, tables.item_nsfw, "items"), pools.untouched_pool(tables.item_index, tables.item_nsfw, tables.item_unique, tables.interaction, "2002-01-20 00:00:00")):
        assert "row_number" not in plan(pool)


def test_pool_scores_are_not_shuffled_by_user_and_query(tables):
    served = products.Served(tables, "clean")
    scored = served.scored()
    mixed = serve.mix(scored, served.queries)
    assert "BroadcastHashJoin [pool_key" in plan(mixed)
    full = serve.mix(serve.rerank(scored, served.queries), served.queries)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, full.collect()))
    summed, written = (serve.mix_sum(x, served.queries, floor=0.5) for x in (scored, serve.rerank(scored, served.queries)))
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, written.collect()))
    with pytest.raises(ValueError):
        serve.mix(scored, served.queries, floor=0.1)


def test_no_vector_is_shuffled_by_pair(tables):
    vectors = products.item_vectors(tables)
    pairs = vectors.select("video_id").distinct().limit(40).withColumnRenamed("video_id", "query_video_id").withColumn("candidate_video_id", F.col("query_video_id"))
    pairs = pairs.withColumn("candidate_video_id", F.lead("query_video_id").over(Window.orderBy("query_video_id"))).dropna()
    text = plan(similarity.pair_rows(pairs, vectors))
    assert not [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", text) if "query_video_id" in x and "candidate_video_id" in x]


def test_caps_bite_and_every_fallback_source_occurs(tables):
    watched, reported = pools.watched_items(tables.interaction, AS_OF), pools.all_reported(tables.reports)
    assert pools.user_history(tables.interaction, AS_OF, size=2).count() < watched.count()
    assert pools.reported_items(tables.reports, 2).count() < reported.count()
    rows = serve.fallback_recommendations(tables.user_region, *[f(tables, "nsfw") for f in (products.region_rows, products.popular_rows, products.untouched_rows)], watched, reported)
    assert {r.source for r in rows.select("source").distinct().collect()} == {0, 1, 2}


def test_long_id_lists_are_joined(tables):
    wanted = [r.video_id for r in tables.item_unique.limit(30).collect()]
    long = wanted + [f"none{i}" for i in range(scans.SHORT_LIST)]
    short = scans.scan_interactions(tables.interaction, items=wanted)
    assert sorted(map(str, scans.scan_interactions(tables.interaction, items=long).collect())) == sorted(map(str, short.collect()))
    either = scans.scan_duplicates(tables.item_duplicates, items=wanted)
    assert either.columns == tables.item_duplicates.columns
    for items in (long, spark_list(tables, long)):
        assert sorted(map(str, scans.scan_duplicates(tables.item_duplicates, items=items).collect())) == sorted(map(str, either.collect()))


def spark_list(tables, values):
    return tables.spark.createDataFrame([(v,) for v in values], "id string")


def test_views_reach_every_vector_and_report(spark, tables):
    assert tables.item_index.where("embedding is not null").select("embedding").distinct().count() > 0.3 * tables.embeddings.count()
    wanted = spark.sql("select distinct p_partkey % (select count(*) from {e}) as v from {p} where p_partkey % 41 <> 0", e=tables.embeddings, p=tables.part)
    held = tables.item_index.where("embedding is not null").select("embedding").distinct()
    assert wanted.withColumnRenamed("v", "vec_id").join(tables.embeddings, "vec_id").join(held, "embedding", "left_anti").count() == 0
    assert tables.reports.count() == tables.lineitem.where("l_returnflag = 'R'").count()


def test_checks_ride_on_the_write(spark):
    """The rows a check counts are those that the one run of the plan writes."""
    runs = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.range(100, numPartitions=3).withColumn("k", F.col("id").cast("string")).mapInArrow(passed, "id bigint, k string")
    assert expect_non_empty(df, "numbers", ("k",)).count() == 100 and runs.value == 100
    with pytest.raises(ValueError, match="no rows"):
        expect_non_empty(df.where("id < 0"), "nothing")
    with pytest.raises(ValueError, match="nulls in k"):
        expect_non_empty(df.withColumn("k", F.when(F.col("id") > 5, F.col("k"))), "nulls", ("k",))
    table, metrics = quality.store_observed(df, ["id"])
    assert (metrics["num_rows"], metrics["min_id"], metrics["max_id"], metrics["nulls_id"]) == (100, 0, 99, 0)
    assert quality.expect_keys_in_source(table, df, ["id"]).count() == 0
    assert {(r.id, r.side) for r in quality.expect_keys_in_source(df.where("id <> 7"), df, ["id"]).collect()} == {(7, "right")}


def test_a_viral_item_is_not_joined_in_one_task(spark):
    views = spark.createDataFrame([(f"u{i}", "viral" if i % 2 else f"v{i % 700}") for i in range(5_000)], "user_id string, video_id string")
    vectors = spark.createDataFrame([("viral", [1.0, 2.0])] + [(f"v{i}", [float(i), 0.0]) for i in range(0, 700, 4)] + [("viral", [3.0, 4.0]), ("v0", None)], "video_id string, embedding array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = profiles.attach_vectors(views, vectors)
        text = plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text  # hot rows by broadcast, the others by shuffle
    plain = views.join(vectors.where("embedding is not null"), "video_id")
    assert joined.exceptAll(plain.select(*joined.columns)).count() == 0 and joined.count() == plain.count()
    cold = text.split("SortMergeJoin", 1)[1]
    assert "LeftAnti" in cold  # the hot item's rows are taken out before the shuffle


def test_sketches_of_days_are_merged(spark):
    rows = spark.createDataFrame([("clean", i % 2, f"u{i}", float(i * 37 % 1000), f"2001-01-{1 + i % 9:02d}") for i in range(4_000)], "content_type string, cluster_id int, user_id string, total_seconds double, day string")
    rows = rows.withColumn("day", F.col("day").cast("date"))
    sketches = tiers.watch_time_sketches(rows)
    assert sketches.count() == 18
    checked = tiers.within_rank_bound(rows, tiers.tier_bins(rows), tiers.tier_bins_from(sketches), 0.02)
    assert [r.within_bound for r in checked.collect()] == [True, True]
    some = tiers.tier_bins_from(sketches, days=("2001-01-02", "2001-01-03"))
    assert sum(r.user_count for r in some.collect()) == rows.where("day between '2001-01-02' and '2001-01-03'").count()


def test_sql_functions_equal_the_columns(spark, tables):
    names = sql.register(spark, tables.item_index)
    assert {"item_id_strict", "item_urls", "urls_of"} <= set(names)
    uris = ["gs://items/a.mp4", "a.mp4", "gs://items/a.mov", "x/y.mp4.mp4", "", None, "plain", "gs://items/" + "0" * 32 + ".mp4"]
    df = spark.createDataFrame([(u,) for u in uris], "uri string")
    for name, column in (("item_id_strict", ids.item_id_strict), ("item_id_lenient", ids.item_id_lenient), ("item_id_passthrough", ids.item_id_passthrough)):
        assert [r[0] for r in df.selectExpr(f"{name}(uri)").collect()] == [r[0] for r in df.select(column(F.col("uri"))).collect()]
    assert [r[0] for r in df.selectExpr("item_id_hex32(uri, 'items')").collect()] == [r[0] for r in df.select(ids.item_id_hex32(F.col("uri"), "items")).collect()]
    assert spark.sql("select uri_matches_item('gs://x/a.mp4', 'a'), round2(0.125D), item_url('b', 'c', null), content_type_of(null)").first()[:] == (True, 0.13, None, None)
    known = spark.table(sql.KNOWN).where("url is not null").first()
    rows = spark.sql(f"select * from item_urls(array('nothing', '{known.video_id}')) order by pos, url").collect()
    assert rows[0][:] == (0, "nothing", None) and known.url in {r.url for r in rows if r.pos == 1}
    assert "Python" not in plan(spark.sql("select item_id_strict(uri) from {d}", d=df))
