"""Key-table lookups, ordered layouts, payloads, keyed tables, and the plan of the audit."""

import os

import pytest
from conftest import SEED, SMALL_SF, d, rows
from pyspark.sql import functions as F

from seatspark import scenarios as S
from seatspark.operators.admit import admit_bookings
from seatspark.operators.audit import audit, check_list, violations_only
from seatspark.operators.dml import delete_cascade, patch_movies
from seatspark.plans import reports as R
from seatspark.plans import views as V
from seatspark.plans.lookups import lookup
from seatspark.schemas import MOVIE_PATCH, SCHEMAS
from seatspark.sources.bridge import bridge_tables
from seatspark.sources.keyed import BUCKET, bucket_of, change_keyed, read_keyed, write_keyed
from seatspark.sources.requests import parse_payloads, read_payloads, requests_from_text
from seatspark.sources.tables import load_tables, tables_from_rows, write_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snapshot") / "t")
    write_tables(bridge_tables(spark, SMALL_SF), path)
    return load_tables(spark, path)


@pytest.fixture()
def settings(spark):
    """Sets Spark settings for one test."""
    old = {}

    def put(**values):
        for k, v in values.items():
            key = k.replace("__", ".")
            old.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, v)

    yield put
    for key, v in old.items():
        spark.conf.unset(key) if v is None else spark.conf.set(key, v)


# ---- lookups ---------------------------------------------------------------------------

def test_the_key_range_and_the_bloom_filter_reach_the_scan(spark, snapshot, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
             spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0")
    keys = S.error_users(spark, SMALL_SF)
    text = plan(lookup(snapshot.booking, keys, "user_id"))
    assert "might_contain" in text and "bloom_filter_agg" in text
    assert "PushedFilters: [IsNotNull(user_id), GreaterThanOrEqual(user_id," in text
    # the filter stands below the shuffle of the big side
    assert text.index("SortMergeJoin") < text.index("Exchange") < text.index("might_contain")


def test_lookup_equals_a_plain_filter(spark, seed):
    keys = spark.createDataFrame([(1,), (3,), (3,), (None,), (99,)], "user_id int")
    assert rows(lookup(seed.booking, keys, "user_id"), "booking_id") == [(201,), (203,), (204,), (206,), (207,)]
    assert lookup(seed.booking, keys.where("user_id > 1000"), "user_id").collect() == []
    assert rows(R.pending_summary(seed, keys)) == [(1, 0, d(0)), (3, 0, d(0))]
    shows = spark.createDataFrame([(15,), (14,), (15,)], "showtime_id long")
    for report in (V.available_seats, V.bookable_seats, R.seat_layout):
        assert rows(report(seed, shows)) == rows(report(seed).where("showtime_id in (14, 15)"))
        assert rows(report(seed, 12)) == rows(report(seed).where("showtime_id = 12"))


def test_keyed_seat_reports_read_holds_of_their_showtimes_only(snapshot):
    for report in (V.bookable_seats, R.seat_layout):
        text = plan(report(snapshot, 7))
        assert text.count("EqualTo(showtime_id,7)") >= 2  # showtimes and held seats


# ---- ordered layout ---------------------------------------------------------------------

def test_layout_is_in_order_without_a_sort_of_seat_rows(spark, snapshot, seed):
    out = R.seat_layout(snapshot)
    text = plan(out)
    assert "Sort" not in text[:text.index("Generate")] and "Exchange" not in text[:text.index("Generate")]
    assert "rangepartitioning(showtime_id" in text
    got = [(r["showtime_id"], r["seat_number"].lower(), r["seat_number"]) for r in out.collect()]
    assert got == sorted(got) and len(got) > 5000
    assert [r["seat_number"] for r in R.seat_layout(seed, 11).collect()] == ["1", "10", "2", "3"]


# ---- payloads --------------------------------------------------------------------------

LINES = ['{"request_id": 1, "user_id": 6, "showtime_id": 15, "seats": ["1"]}',
         '{"request_id": 2, "user_id": 6, "showtime_id": 12, "seats": [', "[3]", "null", "7", "", "  ", None, "nonsense",
         '{"request_id": "x", "user_id": 6}', '{"request_id": 4, "user_id": 6, "showtime_id": 12, "seats": "2"}',
         '{"request_id": 5}', '{"request_id": 6, "user_id": 2, "showtime_id": 12, "seats": ["2"], "more": 1}']


def test_malformed_payloads_keep_their_text(spark, seed, tmp_path):
    good, bad = parse_payloads(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert good.columns == ["request_id", "user_id", "showtime_id", "seats", "requested_at"]
    assert rows(good, "request_id") == [(1,), (5,), (6,)]
    assert sorted(r["raw"] for r in bad.collect()) == sorted(LINES[k] for k in (1, 2, 3, 4, 8, 9, 10))
    assert {r["outcome"] for r in bad.collect()} == {"malformed"}
    _, out = admit_bookings(seed, good)
    assert rows(out, "request_id", "outcome") == [(1, "accepted"), (5, "missing_fields"), (6, "accepted")]
    (tmp_path / "lines.json").write_text("\n".join(x for x in LINES if x is not None))
    again, refused = read_payloads(spark, str(tmp_path))
    assert rows(again, "request_id") == rows(good, "request_id") and refused.count() == bad.count()


def test_form_text_of_odd_values(spark, seed):
    form = spark.createDataFrame([("1", "6", "15", " 1 , a"), ("2", "x", "15", "2"), ("y", "6", "15", "2"), ("4", "6", "15", None)],
                                 "request_id string, user_id string, showtime_id string, seats_text string")
    _, out = admit_bookings(seed, requests_from_text(form))
    assert sorted((r["request_id"] or 0, r["outcome"]) for r in out.collect()) == [
        (0, "missing_fields"), (1, "accepted"), (2, "missing_fields"), (4, "missing_fields")]


# ---- tables by key buckets ------------------------------------------------------------------

def _files(path):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(path)
            for f in names if f.endswith(".parquet")}


def test_a_change_rewrites_touched_buckets_only(spark, snapshot, tmp_path):
    path = str(tmp_path / "movie")
    write_keyed(snapshot.movie, "movie", path, 16)
    assert rows(read_keyed(spark, "movie", path)) == rows(snapshot.movie)
    patches = spark.createDataFrame([(1, 7, {"title": "Seven"}), (2, 8, {"title": "Eight"}), (3, 7, {"rating": "9.5"})], MOVIE_PATCH)
    before = _files(path)

    def patched(old):
        return patch_movies(snapshot.with_(movie=old), patches)[0].movie

    touched = change_keyed(spark, "movie", path, 16, patches.select("movie_id"), patched)
    after = _files(path)
    want = {r[0] for r in patches.select(bucket_of("movie", 16).alias("b")).distinct().collect()}
    assert set(touched) == want and len(want) <= 2
    changed = {f for f in before if after.get(f) != before[f]} | (set(after) - set(before))
    assert changed and all(any(f"{BUCKET}={b}/" in f for b in want) for f in changed)
    assert rows(read_keyed(spark, "movie", path)) == rows(patch_movies(snapshot, patches)[0].movie)


def test_deletes_and_inserts_by_bucket(spark, seed, tmp_path):
    path = str(tmp_path / "genre")
    t = tables_from_rows(spark, SEED)
    write_keyed(t.movie_genre, "movie_genre", path, 8)
    keys = spark.createDataFrame([(1, 501, "ACTION"), (2, 502, "comedy")], "request_id long, movie_id long, genre string")
    change_keyed(spark, "movie_genre", path, 8, keys.select("movie_id", "genre"),
                 lambda old: delete_cascade(t.with_(movie_genre=old), "movie_genre", keys)[0].movie_genre)
    assert rows(read_keyed(spark, "movie_genre", path)) == [(501, "Drama")]  # emptied buckets are gone
    new = spark.createDataFrame([(503, "War")], SCHEMAS["movie_genre"])
    change_keyed(spark, "movie_genre", path, 8, new, lambda old: old.unionByName(new))
    assert rows(read_keyed(spark, "movie_genre", path)) == [(501, "Drama"), (503, "War")]
    assert change_keyed(spark, "movie_genre", path, 8, new.limit(0), lambda old: old) == []


# ---- audit ---------------------------------------------------------------------------------

def test_the_audit_scans_each_table_once_and_shuffles_little(snapshot, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    text = plan(audit(snapshot))
    assert text.count("Exchange hashpartitioning") + text.count("Exchange SinglePartition") <= 6
    assert text.count("Scan parquet") <= len(SCHEMAS)


def test_the_audit_of_rows_that_break_every_rule(spark, seed):
    t = seed.with_(
        users=seed.users.unionByName(spark.createDataFrame([(1, "A" * 101, "ANN@X.IO", None, "customer"), (None, "N", None, "p", "x" * 11)],
                                                           "user_id long, name string, email string, password string, role string")),
        payment=seed.payment.withColumn("amount", F.expr("case payment_id when 901 then 'n/a' when 902 then '123456789.00' "
                                                         "else cast(amount as string) end")),
        movie=seed.movie.withColumn("rating", F.col("rating") * 100),
        booking=seed.booking.withColumn("status", F.expr("if(booking_id = 201, 'Lost', status)")).withColumn(
            "showtime_id", F.expr("if(booking_id = 202, 12, showtime_id)")),
        booking_seat=seed.booking_seat.unionByName(spark.createDataFrame([(999, "1", 7, 11), (206, "1", 8, 14)], SCHEMAS["booking_seat"])))
    got = {(r["rule"], r["table_name"], r["columns"]): r["violations"] for r in violations_only(t).collect()}
    assert got == {
        ("primary_key", "users", "user_id"): 1, ("unique", "users", "email"): 1, ("unique", "booking_seat", "seat_number,theater_id,showtime_id"): 1,
        ("not_null", "users", "user_id"): 1, ("not_null", "users", "email"): 1, ("not_null", "users", "password"): 1,
        ("varchar_length", "users", "name"): 1, ("varchar_length", "users", "role"): 1, ("status_set", "booking", "status"): 1,
        ("decimal_range", "payment", "amount"): 2, ("decimal_range", "movie", "rating"): 2,
        ("foreign_key", "movie", "owner_id"): 1, ("foreign_key", "booking_seat", "booking_id"): 1,
        ("held_seat_showtime", "booking_seat", "booking_id,showtime_id"): 1,
        ("held_seat_theater", "booking_seat", "showtime_id,theater_id"): 1, ("one_payment_per_booking", "payment", "booking_id"): 1}
    assert len(check_list()) == audit(t).count() == len(set(check_list()))
