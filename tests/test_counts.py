"""Differences of tables and counts of a split by their definition."""

import re

from itemrec import quality
from itemrec.operators.split import split_stats


def test_difference_counts_repeats_and_nulls_in_one_exchange(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), (None, 2), ("b", None), ("c", 3)], "x string, y int")
    right = spark.createDataFrame([("a", 1), (None, 2), ("b", None), ("b", None), ("d", 4)], "x string, y int")
    out = quality.difference(left, right)
    assert sorted(map(tuple, out.collect())) == [("a", 1, "left"), ("a", 1, "left"), ("b", None, "right"), ("c", 3, "left"), ("d", 4, "right")]
    text = quality.difference(left, right)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_split_stats_by_definition(spark):
    rows = [("v1", "a", 0, True, True, False), ("v1", "b", 1, False, False, True), ("v2", "a", 0, None, True, None), ("v3", None, None, True, None, False), (None, "a", 2, True, True, True), ("v1", "a", 0, True, True, False)]
    split = spark.createDataFrame(rows, "video_id string, user_id string, cluster_id int, nsfw_label boolean, liked boolean, shared boolean")
    out = split_stats(split)
    assert out.first().asDict() == {
        "total_rows": 6, "unique_videos": 3, "unique_users": 2, "unique_clusters": 3, "nsfw_rows": 4, "clean_rows": 1, "unlabelled_rows": 1,
        "nsfw_videos": 2, "clean_videos": 1, "liked_rows": 4, "shared_rows": 2,
    }
    assert set(split_stats(split.limit(0)).first()) == {0}
    # what multiplies rows is the two counts over (user, cluster), after the grouping by user
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "liked" not in "".join(line for line in text.splitlines() if "Expand" in line)
