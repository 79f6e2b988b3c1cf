"""Plan shape (pushdown, pruning, where the explode sits) and data properties."""

import tempfile

import pytest
from conftest import SMALL_SF

from seatspark.operators.audit import violations_only
from seatspark.plans import reports as R
from seatspark.plans import views as V
from seatspark.scenarios import admission, delete_some_movies
from seatspark.sources.bridge import bridge_tables
from seatspark.sources.tables import load_tables, write_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, seed):
    path = tempfile.mkdtemp(prefix="seatspark-plan-") + "/t"
    write_tables(seed, path)
    return load_tables(spark, path)


@pytest.fixture(scope="module")
def bridge(spark):
    return bridge_tables(spark, SMALL_SF)


def test_status_filter_reaches_the_payment_scan(stored):
    text = plan(R.revenue_by_movie(stored))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,Confirmed)" in text


def test_projection_is_pruned_at_the_scan(stored):
    text = plan(R.movie_list(stored))
    assert "ReadSchema: struct<movie_id:bigint,title:string>" in text


def test_seat_rows_are_exploded_after_every_shuffle(stored):
    """Availability is computed per showtime; the seat rows appear only at the top."""
    text = plan(V.available_seats(stored))
    top = text[: text.index("Generate")]
    assert "Exchange" not in top
    # the seat string report never materialises seat rows at all
    assert "Generate" not in plan(R.search_showtimes(stored))


def test_available_covers_bookable_and_partitions_the_slots(bridge):
    avail = V.available_seats(bridge)
    book = V.bookable_seats(bridge)
    assert book.exceptAll(avail).count() == 0
    layout = R.seat_layout(bridge)
    booked = layout.where("status = 'Booked'").count()
    assert avail.count() + booked == layout.count()


def test_admission_keeps_seats_unique(spark, bridge):
    nxt, out = admission(spark, SMALL_SF, bridge)
    rules = {(r["rule"], r["table_name"]) for r in violations_only(nxt).collect()}
    assert ("unique", "booking_seat") not in rules
    assert ("primary_key", "booking") not in rules
    assert out.where("outcome = 'accepted'").count() > 0


def test_delete_leaves_no_new_orphans(spark, bridge):
    before = {(r["rule"], r["table_name"], r["columns"]) for r in violations_only(bridge).collect()}
    nxt, _ = delete_some_movies(spark, SMALL_SF, bridge)
    after = {(r["rule"], r["table_name"], r["columns"]) for r in violations_only(nxt).collect()}
    assert after <= before


def test_bucketed_snapshot_removes_booking_shuffles(spark, seed, tmp_path):
    """Without broadcasts (the large-table case), booking-keyed buckets save shuffles."""
    from seatspark.sources.tables import load_catalog_tables, save_bucketed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        save_bucketed(seed, "plan_test", str(tmp_path / "b"), buckets=4)
        bucketed = load_catalog_tables(spark, "plan_test")
        write_tables(seed, str(tmp_path / "p"))
        plain = load_tables(spark, str(tmp_path / "p"))
        for report in (V.booking_totals, R.pay_quote):
            assert plan(report(bucketed)).count("Exchange") < plan(report(plain)).count("Exchange")
        assert sorted(V.booking_totals(bucketed).collect()) == sorted(V.booking_totals(plain).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_moves_and_events_keep_keys_clean(spark, bridge):
    from seatspark.scenarios import booking_events, move_some_bookings
    before = {(r["rule"], r["table_name"], r["columns"]) for r in violations_only(bridge).collect()}
    for change in (move_some_bookings, booking_events):
        nxt, _ = change(spark, SMALL_SF, bridge)
        after = {(r["rule"], r["table_name"], r["columns"]) for r in violations_only(nxt).collect()}
        assert after <= before, (change.__name__, after - before)


def test_tables_round_trip_through_another_format(spark, seed, tmp_path):
    path = str(tmp_path / "orc")
    write_tables(seed, path, fmt="orc")
    t = load_tables(spark, path, fmt="orc")
    assert sorted(V.booking_totals(t).collect()) == sorted(V.booking_totals(seed).collect())


def test_seat_lists_join_last(spark, stored):
    """Without broadcasts, the topmost join adds the seat lists and nothing above it shuffles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layout = R.seat_layout(stored)
        for df in (V.available_seats(stored), V.bookable_seats(stored), layout):
            text = plan(df)
            top = text.index("SortMergeJoin [theater_id")
            assert top == text.index("SortMergeJoin")
            # the layout alone shuffles above it: one row a showtime, for the order of its output
            assert text[:top].count("Exchange") == text[:top].count("Exchange rangepartitioning(showtime_id") == (df is layout)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_key_and_filter_forms_equal_the_whole_reports_rows(bridge):
    def same(some, whole):
        assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.collect()))

    user = bridge.booking.first()["user_id"]
    show = bridge.showtime.first()
    same(R.booking_history(bridge, user), R.booking_history(bridge).where(f"user_id = {user}"))
    same(R.pending_summary(bridge, user), R.pending_summary(bridge).where(f"user_id = {user}"))
    same(R.revenue_all_statuses(bridge, show["movie_id"]),
         R.revenue_all_statuses(bridge).where(f"movie_id = {show['movie_id']}"))
    same(V.available_seats(bridge, show["showtime_id"]),
         V.available_seats(bridge).where(f"showtime_id = {show['showtime_id']}"))
    same(R.search_showtimes(bridge, theater="nation_1"),
         R.search_showtimes(bridge).where("theater_name ilike '%nation_1%'"))


def test_payments_are_hidden_from_a_customer_without_id(seed):
    assert R.payment_record(seed, role="customer").count() == 0
    assert R.payment_record(seed, caller_id=3, role="customer").count() == 3
    assert R.payment_record(seed, role="staff").count() == 6
