"""Scalar rules at their bounds."""

from pyspark.sql import functions as F

from itemrec.functions import ids, rules, vectors
from itemrec.operators.sessions import chunk_list
from itemrec.operators.summaries import watch_range

P = [None, 0.39, 0.40, 0.55, 0.70, 0.71]


def test_split_label_bounds(column):
    assert column(rules.nsfw_split_label, P, "double") == [None, False, None, None, None, True]


def test_region_label_counts_the_upper_bound(column):
    assert column(rules.nsfw_region_label, P, "double") == [None, False, None, None, True, True]


def test_pool_type_needs_flag_and_probability(column):
    assert column(lambda p: rules.pool_content_type(p, F.lit(True)), P, "double") == [None, None, None, None, None, "nsfw"]
    assert column(lambda p: rules.pool_content_type(p, F.lit(False)), P, "double") == [None, "clean", None, None, None, None]


def test_round2_is_the_plain_double_product(column):
    # 0.575 and 0.285 lie just under the half as doubles, 0.125 is exactly a half
    assert column(rules.round2, [0.575, 0.285, 0.125, 0.0049, 0.005], "double") == [0.57, 0.28, 0.13, 0.0, 0.01]


def test_uint64(column):
    values = ["0", "18446744073709551615", "18446744073709551616", "-1", "1.5", "text", None, " 7 ", "+8", "0" * 30 + "9"]
    assert column(rules.is_uint64, values, "string") == [True, True, False, False, False, False, False, True, True, True]


def test_item_ids(column):
    uris = [None, "plain", "gs://b/x.mp4.mp4", "gs://b/x.mov", "gs://b/" + "a" * 32 + ".mp4", "gs://b/dir/x.mp4"]
    assert column(ids.item_id_strict, uris, "string") == [None, None, "x.mp4", None, "a" * 32, "x"]
    assert column(ids.item_id_lenient, uris, "string") == [None, "plain", "x", "x.mov", "a" * 32, "x"]
    assert column(ids.item_id_passthrough, uris, "string") == [None, "plain", "x", "gs://b/x.mov", "a" * 32, "x"]
    assert column(lambda u: ids.item_id_hex32(u, "b"), uris, "string") == [None, None, None, None, "a" * 32, None]


def test_item_id_length_and_letters(column):
    assert column(rules.is_item_id, ["a" * 7, "a" * 8, "a" * 64, "a" * 65, "abc def gh", "A-b_c-123", None], "string") == [
        False, True, True, False, False, True, False]


def test_opaque_post_id(column):
    assert column(rules.is_opaque_post_id, [None, "abcde", "abcdef", "123456", "12345x"], "string") == [False, False, True, False, True]


def test_tiers(column):
    tier = lambda s: rules.tier_of(s, F.lit(10.0), F.lit(20.0), F.lit(30.0))
    strict = lambda s: rules.tier_of_strict(s, F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(40.0))
    none = lambda s: rules.tier_of(s, F.lit(None).cast("double"), F.lit(20.0), F.lit(30.0))
    values = [-1.0, 10.0, 10.5, 20.0, 30.0, 40.0, 41.0]
    assert column(tier, values, "double") == [0, 0, 1, 1, 2, 3, 3]
    assert column(strict, values, "double") == [0, 0, 1, 1, 2, 3, -1]
    assert column(none, [5.0], "double") == [-1]


def test_vectors(column):
    assert column(vectors.l2_normalise, [[0.0, 0.0], [3.0, 4.0]], "array<double>") == [[0.0, 0.0], [0.6, 0.8]]
    assert column(lambda v: vectors.concat_vectors(v, v), [None, [1.0]], "array<double>") == [None, [1.0, 1.0]]
    assert column(lambda v: vectors.cosine_distance(v, F.array(F.lit(0.0), F.lit(2.0))), [[0.0, 1.0], [1.0, 0.0]], "array<double>") == [0.0, 1.0]


def test_chunks(column):
    got = column(chunk_list, [list(range(n)) for n in (1, 2, 5, 6, 7, 11)], "array<int>")
    assert [[len(c) for c in row] for row in got] == [[], [2], [5], [6], [5, 2], [5, 6]]
    assert [x for c in got[5] for x in c] == list(range(11))


def test_broken_event_is_null(column):
    good = '{"video_id":"v","percent_watched":75.5,"publisher_user_id":"p","timestamp":{"secs_since_epoch":5}}'
    got = column(rules.parse_event, [good, '{"video_id": broken', None], "string")
    assert got[0].video_id == "v" and got[0].timestamp.secs_since_epoch == 5
    assert all(r is None or r.video_id is None for r in got[1:])


def test_watch_ranges_are_right_closed(column):
    assert column(watch_range, [0, 1, 10, 11, 200, 201], "int") == [None, "0-10", "0-10", "10-20", "100-200", None]


def test_blank_canister(column):
    assert column(rules.default_canister, [None, " ", "c"], "string") == [rules.DEFAULT_CANISTER, rules.DEFAULT_CANISTER, "c"]
