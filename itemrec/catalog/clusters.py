"""Clustering and similarity."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemrec.catalog import products
from itemrec.catalog.functions import elements
from itemrec.catalog.registry import query, sql_view
from itemrec.functions import vectors
from itemrec.operators import ann, clustering, sessions, similarity, tiers
from itemrec.operators.ranking import top_n
from itemrec.plans import profiles
from itemrec.runtime import materialize
from itemrec.sources.views import Tables


@query("standardise_vectors", """
    with e as (select vec_id, cast(generate_subscripts(embedding, 1) - 1 as int) as pos, unnest(embedding::double[]) as v from embeddings)
    select vec_id, pos, round((v - avg(v) over (partition by pos)) / stddev_samp(v) over (partition by pos), 6) + 0.0 as value from e""")
def standardise_vectors(t):
    scaled = clustering.standardise(t.embeddings).select("vec_id", vector_to_array("scaled").alias("v"))
    return elements(scaled, "vec_id", "v")


def item_frame(t) -> DataFrame:
    return profiles.avg_embedding(t.item_index).withColumnRenamed("avg_embedding", "embedding")


def user_frame(t) -> DataFrame:
    whole = profiles.user_vector(products.labelled_watches(t), profiles.first_embedding(t.item_index))
    return whole.withColumnRenamed("user_embedding", "embedding")


@query("user_vector", """
    select user_id, pos, round(r, 6) + 0.0 as value from user_average where user_id in (select user_id from cluster_share)
    union all select user_id, cast(64 + i as int), round(r, 6) + 0.0 from temporal_mean where user_id in (select user_id from user_average)
    union all select user_id, cast(80 + pos as int), round(r, 6) + 0.0 from cluster_share where user_id in (select user_id from user_average)""")
def user_vector(t):
    return elements(user_frame(t), "user_id", "embedding")


# ---- quality of given labels -------------------------------------------------------------------

def labelled_by(t, k: int) -> DataFrame:
    """The vectors with given labels in k clusters."""
    return t.embeddings.select("vec_id", "embedding", (F.col("label") % k).alias("cluster"))


def given_metrics(t) -> dict[int, tuple[float, float]]:
    return {k: tuple(clustering.cluster_quality(labelled_by(t, k)).first()[:2]) for k in clustering.ITEM_KS}


_KS = ", ".join(f"({k})" for k in clustering.ITEM_KS)
sql_view("given_label", f"""
    select k, vec_id, label % k as c, embedding::double[] as v from embeddings, (values {_KS}) ks(k)""")
sql_view("given_sum", """
    select k, c, list(m order by pos) as m, max(n) as n, max(q) as q from (
        select k, c, pos, avg(x) as m from (select k, c, generate_subscripts(v, 1) as pos, unnest(v) as x from given_label) group by all)
    join (select k, c, count(*) as n, sum(list_dot_product(v, v)) as q from given_label group by all) using (k, c) group by all""")
sql_view("given_gap", """
    select l.k, l.vec_id, l.c = s.c as own, s.n, list_dot_product(v, v) + s.q / s.n - 2 * list_dot_product(v, s.m) as d
    from given_label l join given_sum s on s.k = l.k""")
sql_view("given_score", """
    select k, vec_id, case when n > 1 then (b - a) / greatest(a, b) else 0 end as score, cost from (
        select k, vec_id, max(n) filter (where own) as n, max(d * n / nullif(n - 1, 0)) filter (where own) as a, min(d) filter (where not own) as b,
               max(d) filter (where own) / 2 as cost from given_gap group by k, vec_id)""")
sql_view("given_metric", "select k, avg(score) as silhouette, sum(cost) as training_cost from given_score group by k")
sql_view("given_choice", f"""
    with b as (select *, (k - min(k) over ()) / (max(k) over () - min(k) over ()) as a, (training_cost - min(training_cost) over ()) / (max(training_cost) over () - min(training_cost) over ()) as y,
                      row_number() over (order by k) as i, count(*) over () as n from given_metric),
    bend as (select arg_max(k, 1 - y - a) as k, max(1 - y - a) as drop from b where i > 1 and i < n)
    select greatest((select arg_max(k, silhouette) from given_metric), {clustering.ITEM_DEFAULT_K}, (select case when drop > 0 then k else 0 end from bend)) as k""")


@query("kmeans_sweep", "select k, round(silhouette, 6) as silhouette, round(training_cost, 3) as training_cost from given_metric")
def kmeans_sweep(t):
    """Silhouette and cost of given labels at every k that is tried."""
    rows = [clustering.cluster_quality(labelled_by(t, k)).select(F.lit(k).alias("k"), F.round("silhouette", 6).alias("silhouette"), F.round("training_cost", 3).alias("training_cost")) for k in clustering.ITEM_KS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("choose_k", "select cast(k as int) as k from given_choice")
def choose_k(t):
    return t.spark.createDataFrame([(clustering.choose_k(given_metrics(t), clustering.ITEM_DEFAULT_K),)], "k int")


@query("cluster_summary", """
    select cast(c as int) as cluster, count(*) as members, cast(m.k as int) as k, round(any_value(silhouette), 6) as silhouette, round(any_value(training_cost), 3) as training_cost
    from given_label l join given_metric m on m.k = l.k where m.k = (select k from given_choice) group by c, m.k""")
def cluster_summary(t):
    k = clustering.choose_k(given_metrics(t), clustering.ITEM_DEFAULT_K)
    quality = clustering.cluster_quality(labelled_by(t, k))
    return clustering.cluster_sizes(labelled_by(t, k)).select(
        F.col("cluster").cast("int").alias("cluster"), "members", F.lit(k).alias("k"), F.round(quality.select("silhouette").scalar(), 6).alias("silhouette"),
        F.round(quality.select("training_cost").scalar(), 3).alias("training_cost"),
    )


def _rounds(rows: str, key: str, start: str, steps: int) -> str:
    """Rounds of k-means over the view ``rows`` (key, pos, v) from labels by the expression ``start``."""
    text = f"l0 as (select distinct {key}, {start} as cluster from {rows})"
    for i in range(steps):
        text += f""",
    c{i} as (select cluster, pos, avg(v) as c from {rows} join l{i} using ({key}) group by all),
    l{i + 1} as materialized (select {key}, arg_min(cluster, (d, cluster)) as cluster from (
        select {key}, cluster, round(sum((v - c) * (v - c)), 9) as d from {rows} join c{i} using (pos) group by all) group by {key})"""
    return f"with {text} select {key}, cast(cluster as int) as cluster from l{steps}"


sql_view("scaled_item", """
    select video_id, pos, (v - avg(v) over (partition by pos)) / stddev_samp(v) over (partition by pos) as v from (
        select video_id, generate_subscripts(avg_embedding, 1) as pos, unnest(avg_embedding::double[]) as v from avg_vector)""")
sql_view("whole_user", """
    select user_id, pos, r as v from user_average where user_id in (select user_id from cluster_share) and user_id in (select user_id from temporal_mean)
    union all select user_id, cast(64 + i as int), r from temporal_mean where user_id in (select user_id from user_average)
    union all select user_id, cast(80 + pos as int), r from cluster_share where user_id in (select user_id from user_average)""")


@query("cluster_items", _rounds("scaled_item", "video_id", f"('0x' || substr(video_id, 1, 4))::bigint % {clustering.ITEM_DEFAULT_K}", 2))
def cluster_items(t):
    """Two rounds of k-means over standardised item vectors from given labels."""
    scaled = clustering.standardise(item_frame(t)).select("video_id", vector_to_array("scaled").alias("embedding"))
    rows = materialize(scaled.withColumn("start", F.conv(F.substring("video_id", 1, 4), 16, 10).cast("bigint") % clustering.ITEM_DEFAULT_K))
    return clustering.lloyd(rows, "start", "video_id", 2).withColumn("cluster", F.col("cluster").cast("int"))


@query("cluster_users", _rounds("whole_user", "user_id", f"cast(substr(user_id, 2) as bigint) % {clustering.USER_DEFAULT_K}", 1))
def cluster_users(t):
    """A round of k-means over user vectors from given labels."""
    rows = materialize(user_frame(t).select("user_id", "embedding", (F.substring("user_id", 2, 20).cast("bigint") % clustering.USER_DEFAULT_K).alias("start")))
    return clustering.lloyd(rows, "start", "user_id", 1).withColumn("cluster", F.col("cluster").cast("int"))


# ---- fitted clusters: no SQL, labels are arbitrary; tests compare partitions ---------------------

@query("kmeans_sweep_fitted")
def kmeans_sweep_fitted(t):
    metrics = clustering.kmeans_sweep(clustering.standardise(item_frame(t)), clustering.ITEM_KS)
    rows = [(k, s, c) for k, (s, c) in metrics.items()]
    return t.spark.createDataFrame(rows, "k int, silhouette double, training_cost double")


@query("choose_k_fitted")
def choose_k_fitted(t):
    metrics = clustering.kmeans_sweep(clustering.standardise(item_frame(t)), clustering.ITEM_KS)
    k = clustering.choose_k(metrics, clustering.ITEM_DEFAULT_K)
    return t.spark.createDataFrame([(k,)], "k int")


@query("cluster_items_fitted")
def cluster_items_fitted(t):
    labelled, _ = clustering.fit_clusters(item_frame(t), clustering.ITEM_KS, clustering.ITEM_DEFAULT_K, scale=True)
    return labelled.select("video_id", "cluster")


@query("cluster_users_fitted")
def cluster_users_fitted(t):
    labelled, _ = clustering.fit_clusters(user_frame(t), clustering.USER_KS, clustering.USER_DEFAULT_K, scale=False)
    return labelled.select("user_id", "cluster")


@query("cluster_summary_fitted")
def cluster_summary_fitted(t):
    labelled, summary = clustering.fit_clusters(item_frame(t), clustering.ITEM_KS, clustering.ITEM_DEFAULT_K, scale=True)
    sizes = clustering.cluster_sizes(labelled)
    chosen = summary.where("chosen")
    return sizes.select("cluster", "members", *[chosen.select(c).scalar().alias(c) for c in ("k", "silhouette", "training_cost")])


sql_view("centroid_row", """
    select label::int as cluster, pos, avg(v) as c from (
        select label, generate_subscripts(embedding, 1) as pos, unnest(embedding::double[]) as v from embeddings) group by label, pos""")


@query("assign_nearest_centroid", """
    with d as (select vec_id, cluster, round(sum((v - c) * (v - c)), 9) as d from (
                  select vec_id, generate_subscripts(embedding, 1) as pos, unnest(embedding::double[]) as v from embeddings) join centroid_row using (pos) group by all)
    select vec_id, arg_min(cluster, d) as cluster, round(min(d), 6) as distance from d group by vec_id""")
def assign_nearest_centroid(t):
    centroids = vectors.mean_vector(t.centroid, ["cluster"], "embedding", "centroid")
    rows = clustering.assign_nearest_centroid(t.embeddings, centroids, "vec_id")
    return rows.withColumn("distance", F.round("distance", 6))


@query("similarity_exact", "select query_video_id, candidate_video_id, max(similarity) as similarity from vector_row group by all")
def similarity_exact(t):
    pairs = products.iou(t).select(F.col("video_id_x").alias("query_video_id"), F.col("video_id_y").alias("candidate_video_id"))
    return similarity.pair_similarity(pairs, products.item_vectors(t))


@query("similarity_topk", """
    select query_video_id, candidate_video_id, max(similarity) as similarity from (
        select *, row_number() over (partition by query_video_id order by similarity desc, candidate_video_id) as rn from (
            select query_video_id, candidate_video_id, round(list_cosine_similarity(q.embedding, c.embedding), 6) as similarity
            from (select distinct query_video_id, candidate_video_id from tier_sampled where query_video_id <> candidate_video_id)
            join item_vector q on q.video_id = query_video_id join item_vector c on c.video_id = candidate_video_id)) where rn <= 200 group by all""")
def similarity_topk(t):
    return similarity.similarity_topk(tiers.tier_samples(products.tier_plan(t)).select("query_video_id", "candidate_video_id"), products.item_vectors(t))


# the vectors here have almost no groups, so near ones lie in most lists; where there are groups, two lists do (tests)
NEAR, PROBES = 0.35, 0.85
sql_view("near_vector", f"""
    select a.vec_id as x, b.vec_id as y from embeddings a join embeddings b on a.vec_id <> b.vec_id
    where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= {NEAR}""")


# what is promised of the pairs found in the nearest lists: none of them is false, and nine in ten are found
@query("similarity_ann", """
    select cast(x as varchar) as query_video_id, count(*) as exact_pairs, cast(0 as bigint) as false_pairs, true as recall_reached from near_vector group by x""")
def similarity_ann(t):
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("video_id"), "embedding")
    report = materialize(ann.ann_report(rows, rows, NEAR, PROBES))
    recall = report.agg(F.sum("found_pairs") / F.sum("exact_pairs")).scalar()
    return report.select("query_video_id", "exact_pairs", "false_pairs", (recall >= 0.9).alias("recall_reached"))


# lists are left out only where no vector can be near enough: nothing is missed
@query("similarity_ann_bound", """
    select cast(x as varchar) as query_video_id, cast(y as varchar) as candidate_video_id from near_vector""")
def similarity_ann_bound(t):
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("video_id"), "embedding")
    return ann.similarity_ann(rows, rows, NEAR, probes=None).select("query_video_id", "candidate_video_id")


@query("similarity_users", """
    with v as materialized (select user_id, list(r order by pos) as u from user_average group by user_id)
    select a.user_id, b.user_id as neighbour, round(list_dot_product(a.u, b.u), 6) + 0.0 as similarity,
           cast(row_number() over (partition by a.user_id order by round(list_dot_product(a.u, b.u), 6) desc, b.user_id) as int) as place
    from v a join v b on a.user_id <> b.user_id qualify place <= 10""")
def similarity_users(t):
    """The ten users most like each user."""
    users = profiles.user_avg_embedding(products.watches(t), profiles.first_embedding(t.item_index)).select("user_id", F.col("embedding").alias("unit"))
    return ann.PivotJoin(users, "user_id", 10).neighbours()


@query("similarity_matrix", """
    with u as (select user_id, cast(substr(user_id, 2) as bigint) % 4 as c, pos, r from user_average),
    s as (select c, pos, sum(r) as s from u group by all), n as (select c, count(distinct user_id) as n from u group by c),
    d as (select a.c as x, b.c as y, sum(a.s * b.s) as d from s a join s b on a.pos = b.pos and a.c <= b.c group by all)
    select cast(x as int) as cluster_x, cast(y as int) as cluster_y, round(case when x = y then (d - nx.n) / (nx.n * (nx.n - 1)) else d / (nx.n * ny.n) end, 6) as mean_similarity,
           cast(case when x = y then nx.n * (nx.n - 1) / 2 else nx.n * ny.n end as bigint) as pairs
    from d join n nx on nx.c = x join n ny on ny.c = y""")
def similarity_matrix(t):
    users = profiles.user_avg_embedding(products.watches(t), profiles.first_embedding(t.item_index)).join(t.user_cluster, "user_id")
    return similarity.cluster_similarity_matrix(users).withColumn("mean_similarity", F.round("mean_similarity", 6))


def nearest_ten(distances: DataFrame) -> DataFrame:
    return top_n(distances, ["content_type", "cluster_id", "bin", "query_video_id"], [F.col("distance"), F.col("candidate_video_id")], 10)


@query("nearest_10", "select content_type, cluster_id, bin, query_video_id, candidate_video_id, round(distance, 6) as distance, cast(rn as int) as rn from nearest_ten")
def nearest_10(t):
    rows = nearest_ten(tiers.tier_distances(products.tier_plan(t), products.averages(t), None))
    return rows.select("content_type", "cluster_id", "bin", "query_video_id", "candidate_video_id", F.round("distance", 6).alias("distance"), "rn")


sql_view("session_basket", """
    with n as (select *, row_number() over (partition by user_id, session_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id, session_id) as n from event_session)
    select user_id, session_id, item_id, pos, least(pos // 5, case when (n + 4) // 5 > 1 and n - ((n + 4) // 5 - 1) * 5 < 2 then (n + 4) // 5 - 2 else (n + 4) // 5 - 1 end) as batch_index
    from n where n >= 2""")


MIN_SUPPORT, MIN_CONFIDENCE = 0.0005, 0.02

sql_view("basket_item", "select distinct user_id || '/' || session_id || '/' || batch_index as k, item_id from session_basket")
sql_view("item_set", f"""
    with recursive grown as (
        select k, [item_id] as items from basket_item
        union all select g.k, list_append(g.items, b.item_id) from grown g join basket_item b on b.k = g.k and b.item_id > g.items[len(g.items)])
    select items, count(*) as freq from grown group by items having count(*) >= ceil((select count(distinct k) from basket_item) * {MIN_SUPPORT})""")


def baskets_of(t: Tables) -> DataFrame:
    return sessions.session_baskets(sessions.sessionize(t.watch_event.drop("event")))


@query("frequent_itemsets", """
    select array_to_string(items, ',') as items, freq from item_set""")
def frequent_itemsets(t):
    """Baskets hold at most six consecutive items of a session."""
    sets, _ = clustering.frequent_itemsets(baskets_of(t), MIN_SUPPORT, MIN_CONFIDENCE)
    return sets.select(F.array_join(F.array_sort("items"), ",").alias("items"), "freq")


@query("association_rules", f"""
    select array_to_string(a.items, ',') as antecedent, list_filter(s.items, lambda x: not list_contains(a.items, x))[1] as consequent,
           round(s.freq / a.freq, 9) as confidence, round(s.freq / a.freq / (c.freq / n.n), 9) as lift, round(s.freq / n.n, 9) as support
    from item_set s join item_set a on len(a.items) = len(s.items) - 1 and list_has_all(s.items, a.items)
    join item_set c on len(c.items) = 1 and c.items[1] = list_filter(s.items, lambda x: not list_contains(a.items, x))[1]
    join (select count(distinct k) as n from basket_item) n on true
    where len(s.items) > 1 and s.freq / a.freq >= {MIN_CONFIDENCE}""")
def association_rules(t):
    _, rules = clustering.frequent_itemsets(baskets_of(t), MIN_SUPPORT, MIN_CONFIDENCE)
    return rules.select(
        F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"), F.col("consequent")[0].alias("consequent"),
        *[F.round(c, 9).alias(c) for c in ("confidence", "lift", "support")],
    )


@query("session_baskets", """
    select user_id, session_id, batch_index, string_agg(item_id, ',' order by pos) as items from session_basket group by all""")
def session_baskets(t):
    rows = sessions.session_baskets(sessions.sessionize(t.watch_event.drop("event")))
    return rows.select("user_id", "session_id", "batch_index", F.array_join("items", ",").alias("items"))


