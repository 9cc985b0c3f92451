"""Time the headline jobs, and two of them beside their naive forms; prints one JSON line.

A warm-up run comes first. A job and its naive form give the same columns, take turns, and count by
their best of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from itemrec import catalog  # noqa: E402
from itemrec.catalog import products  # noqa: E402
from itemrec.operators import iou  # noqa: E402
from itemrec.plans import profiles  # noqa: E402
from itemrec.runtime import prepare, release  # noqa: E402
from itemrec.sources.views import Tables  # noqa: E402

HEADLINE = [
    "avg_embedding", "user_vector", "split_interactions", "iou_candidates", "tier_bins", "tier_candidates",
    "region_candidates", "untouched_pool", "rerank", "recommend_all", "sessionize_lag", "stream_watch_history",
]


def naive_iou(t: Tables) -> DataFrame:
    """Every item pair of a cluster with the finishing users of both intersected: what the job avoids."""
    rows = products.labelled(t)
    watched = F.col("mean_percentage_watched")
    base = rows.groupBy(*iou.GROUP, "video_id").agg(
        F.collect_list(F.when(watched > 0.5, F.col("user_id"))).alias("mins"), F.collect_list(F.when(watched > 0.75, F.col("user_id"))).alias("done")
    ).where("size(mins) > 1 and size(done) > 1")
    x = base.select(*iou.GROUP, *[F.col(c).alias(c + "_x") for c in ("video_id", "mins", "done")])
    pairs = x.join(base, iou.GROUP).where("video_id_x <> video_id").withColumn("num", F.size(F.array_intersect("done_x", "done")))
    return pairs.where("num > 0").select(*iou.GROUP, "video_id_x", "video_id", "num", (F.size("mins_x") + F.size("mins")).alias("den"))


def iou_pairs(t: Tables) -> DataFrame:
    """Pairs and their counts as the job makes them, in the columns of ``naive_iou``."""
    rows = iou.PairScores(products.labelled(t)).directed()
    return rows.select(*iou.GROUP, F.col("x").alias("video_id_x"), F.col("y").alias("video_id"), "num", "den")


PAIRED = {
    "avg_embedding": (lambda t: profiles.avg_embedding(t.item_index), lambda t: profiles.avg_embedding_exploded(t.item_index)),
    "iou_pairs": (iou_pairs, naive_iou),
}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("bench").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cores).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    run(catalog.QUERIES["iou_candidates"](spark, folder))
    times: dict[str, float] = {}

    def timed(name: str, job) -> None:
        begin = time.time()
        run(job())
        times[name] = round(min(time.time() - begin, times.get(name, 1e9)), 3)
        print(name, times[name], file=sys.stderr, flush=True)

    for name in HEADLINE:
        if name not in PAIRED:
            timed(name, lambda n=name: catalog.QUERIES[n](spark, folder))
    for _ in range(2 if os.environ.get("BENCH_NAIVE", "1") == "1" else 0):
        for name, (own, naive) in PAIRED.items():
            timed(name, lambda f=own: f(Tables(spark, folder)))
            timed(f"naive_{name}", lambda f=naive: f(Tables(spark, folder)))
    if "avg_embedding" not in times:
        timed("avg_embedding", lambda: PAIRED["avg_embedding"][0](Tables(spark, folder)))
    release(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").split("sf")[-1],
    }))


if __name__ == "__main__":
    main()
