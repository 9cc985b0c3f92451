"""Labels, validity tests and other scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the labelling rules.
CLEAN_BELOW = 0.4
NSFW_ABOVE = 0.7
MISSING_PROBABILITY = 0.5
DEFAULT_CANISTER = "default-canister"

EVENT_SCHEMA = (
    "video_id string, percent_watched double, publisher_user_id string, "
    "timestamp struct<secs_since_epoch: bigint>"
)


def nsfw_split_label(p: Column) -> Column:
    """Both bounds exclusive; the band between and a missing probability stay unlabelled."""
    return F.when(p < CLEAN_BELOW, False).when(p > NSFW_ABOVE, True)


def nsfw_region_label(p: Column) -> Column:
    """As the split label, but the upper bound counts as nsfw."""
    return F.when(p >= NSFW_ABOVE, True).when(p < CLEAN_BELOW, False)


def content_type(label: Column) -> Column:
    return F.when(label, "nsfw").when(~label, "clean")


def pool_content_type(p: Column, flag: Column) -> Column:
    """Content type a pool item may serve, NULL when it may serve none."""
    q = F.coalesce(p, F.lit(MISSING_PROBABILITY))
    return F.when((q > NSFW_ABOVE) & flag, "nsfw").when((q < CLEAN_BELOW) & ~flag, "clean")


def round2(x: Column) -> Column:
    """Two places, halves up, by plain arithmetic so that engines agree."""
    return F.floor(x * 100 + F.lit(0.5)) / 100


def is_uint64(x: Column) -> Column:
    """Text that reads as an integer in 0..2^64-1; a plain cast would round ``1.5``."""
    text = F.trim(x)
    digits = F.regexp_replace(text, r"^\+?0*", "")
    in_range = (F.length(digits) <= 20) & (text.try_cast("decimal(38,0)") <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return F.coalesce(text.rlike(r"^[+]?[0-9]+$") & in_range, F.lit(False))


def is_item_id(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[A-Za-z0-9_-]+$") & F.length(x).between(8, 64), F.lit(False))


def is_opaque_post_id(x: Column) -> Column:
    """Present, longer than five characters and not an integer."""
    return x.isNotNull() & (F.length(x) > 5) & x.try_cast("bigint").isNull()


def tier_of(seconds: Column, p25: Column, p50: Column, p75: Column) -> Column:
    """Watch-time tier; -1 seconds is tier 0 and a cluster without bounds gives -1."""
    return (
        F.when(p25.isNull() | p50.isNull() | p75.isNull() | seconds.isNull(), F.lit(-1))
        .when(seconds == -1, F.lit(0))
        .when(seconds <= p25, F.lit(0))
        .when(seconds <= p50, F.lit(1))
        .when(seconds <= p75, F.lit(2))
        .otherwise(F.lit(3))
    )


def tier_of_strict(seconds: Column, p25: Column, p50: Column, p75: Column, p100: Column) -> Column:
    """As ``tier_of`` but a value above the top bound has no tier."""
    return F.when(seconds > p100, F.lit(-1)).otherwise(tier_of(seconds, p25, p50, p75))


def parse_event(text: Column) -> Column:
    """JSON watch event to a struct; broken JSON gives NULL item and is skipped by callers."""
    return F.from_json(text, EVENT_SCHEMA)


def default_canister(canister: Column) -> Column:
    return F.when(F.trim(F.coalesce(canister, F.lit(""))) == "", F.lit(DEFAULT_CANISTER)).otherwise(canister)


def watched_share(percent: Column) -> Column:
    """Percent on the 0..100 scale with missing as 0."""
    return F.coalesce(percent, F.lit(0.0)) * 100
