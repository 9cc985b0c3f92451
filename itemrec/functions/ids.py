"""Item ids, keys and urls as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_id_strict(uri: Column) -> Column:
    """Text between the last slash and a final ``.mp4``; NULL for any other ending."""
    found = F.regexp_extract(uri, r"([^/]+)\.mp4$", 1)
    return F.when(found != "", found)


def item_id_lenient(uri: Column) -> Column:
    """Last path part, cut at its first ``.mp4``."""
    return F.substring_index(F.substring_index(uri, "/", -1), ".mp4", 1)


def item_id_passthrough(uri: Column) -> Column:
    """Lenient form for video uris; anything without ``.mp4`` is an id already."""
    return F.when(uri.contains(".mp4"), item_id_lenient(uri)).otherwise(uri)


def item_id_hex32(uri: Column, bucket: str) -> Column:
    """32 hex digits directly under one bucket."""
    found = F.regexp_extract(uri, "gs://" + bucket + r"/([a-f0-9]{32})\.mp4", 1)
    return F.when(found != "", found)


def uri_from_item_id(item_id: Column, bucket: str) -> Column:
    return F.concat(F.lit(f"gs://{bucket}/"), item_id, F.lit(".mp4"))


def uri_matches_item(uri: Column, item_id: Column) -> Column:
    """Suffix test; for joins prefer equality on ``item_id_strict``."""
    return F.endswith(uri, F.concat(F.lit("/"), item_id, F.lit(".mp4")))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def flow_label(cluster: Column, source_bin: Column, target_bin: Column) -> Column:
    return F.format_string("cluster_%d->bin_%d->bin_%d", cluster, F.coalesce(source_bin, F.lit(0)), target_bin)


def item_url(base: str, canister: Column, post: Column) -> Column:
    """NULL when any part is NULL."""
    return F.concat(F.lit(base + "/"), canister, F.lit("/"), post)


def hash_order(seed: str, *keys: Column) -> Column:
    """Reproducible shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def hash_number(seed: str, *keys: Column) -> Column:
    """Non-negative integer below 2^28 from the same hash."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 7), 16, 10).cast("bigint")


def packed(key: Column) -> Column:
    """A key in fewer bytes: pairs of lower-case hex digits as one byte each, any other text as it is; different keys stay different."""
    pairs = F.unhex(key)
    return F.when(F.lower(F.hex(pairs)) == key, F.concat(F.lit(b"\x01"), pairs)).otherwise(F.concat(F.lit(b"\x00"), key.cast("binary")))
