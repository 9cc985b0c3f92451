"""The id rules and lookups as functions of SQL text.

``register`` creates temporary functions in a session. Each is SQL itself, so queries that use it stay
in the JVM and are optimised as if it were written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemrec.functions import ids

#: Name, parameters, result and body of each scalar function.
SCALAR = {
    "item_id_strict": ("uri string", "string", r"nullif(regexp_extract(uri, '([^/]+)\\.mp4$', 1), '')"),
    "item_id_lenient": ("uri string", "string", "substring_index(substring_index(uri, '/', -1), '.mp4', 1)"),
    "item_id_passthrough": ("uri string", "string", "case when contains(uri, '.mp4') then substring_index(substring_index(uri, '/', -1), '.mp4', 1) else uri end"),
    "item_id_hex32": ("uri string, bucket string", "string", r"nullif(regexp_extract(uri, concat('gs://', bucket, '/([a-f0-9]{32})\\.mp4'), 1), '')"),
    "uri_from_item_id": ("item_id string, bucket string", "string", "concat('gs://', bucket, '/', item_id, '.mp4')"),
    "uri_matches_item": ("uri string, item_id string", "boolean", "endswith(uri, concat('/', item_id, '.mp4'))"),
    "item_url": ("base string, canister string, post string", "string", "concat(base, '/', canister, '/', post)"),
    "content_type_of": ("is_nsfw boolean", "string", "case when is_nsfw then 'nsfw' when not is_nsfw then 'clean' end"),
    "round2": ("x double", "double", "floor(x * 100 + 0.5D) / 100"),
}
KNOWN = "item_url_known"


def register(spark: SparkSession, item_index: DataFrame | None = None, base: str = "https://items.example/watch") -> list[str]:
    """Create the functions, and return their names.

    With ``item_index`` there are two table functions too: ``item_urls(ids)`` gives (pos, video_id, url) of a list of ids, unknown
    ids without a url, and ``urls_of(id)`` the urls of one id, for a lateral join with any number of rows.
    """
    for name, (parameters, kind, body) in SCALAR.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    if item_index is None:
        return list(SCALAR)
    url = ids.item_url(base, F.col("canister_id"), F.col("post_id"))
    item_index.select(ids.item_id_strict(F.col("uri")).alias("video_id"), url.alias("url")).where("video_id is not null").distinct().createOrReplaceTempView(KNOWN)
    spark.sql(f"""
        create or replace temporary function item_urls(wanted array<string>) returns table(pos int, video_id string, url string)
        return select p.pos, p.id, k.url from posexplode(wanted) as p(pos, id) left join {KNOWN} k on k.video_id = p.id""")
    spark.sql(f"""
        create or replace temporary function urls_of(wanted string) returns table(video_id string, url string)
        return select video_id, url from {KNOWN} where video_id = wanted""")
    return [*SCALAR, "item_urls", "urls_of"]
