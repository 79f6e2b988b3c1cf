"""Bulk changes on the seed rows, and M1/M2 against plain sequential models."""

import random

import pytest
from conftest import SEED, d, rows, ts
from pyspark.sql import functions as F

from seatspark.operators import dml
from seatspark.operators.admit import admit_bookings
from seatspark.operators.audit import violations_only
from seatspark.operators.dml import (delete_cascade, insert_rows, patch_movies, register_users,
                                     replace_showtimes, table_sizes)
from seatspark.operators.events import apply_booking_events
from seatspark.operators.ids import next_ids
from seatspark.operators.links import connected_components
from seatspark.operators.moves import reassign_bookings
from seatspark.operators.scan import ranked
from seatspark.schemas import BOOKING_EVENT, BOOKING_MOVE, BOOKING_REQUEST, MOVIE_PATCH
from seatspark.sources.tables import tables_from_rows

# ---- M1 ----------------------------------------------------------------------------


def _requests(spark, reqs):
    return spark.createDataFrame([(i, u, s, seats, None) for i, u, s, seats in reqs], BOOKING_REQUEST)


def test_admit_seed(spark, seed):
    reqs = [(1, 6, 11, ["3"]),        # held by a Cancelled booking: still refused
            (2, 6, 15, ["1", "a"]),   # 'a' is seat 'A'
            (3, 2, 15, ["A"]),        # taken by request 2
            (4, 77, 12, ["2"]),       # unknown user: takes nothing
            (5, 1, 12, ["2", "2"]),   # repeated seat: takes nothing
            (6, 1, 12, ["2"]),
            (7, 1, 99, ["1"]),
            (8, 1, 12, ["Z"]),
            (9, 1, 12, []),
            (10, None, 12, ["1"])]
    nxt, out = admit_bookings(seed, _requests(spark, reqs))
    assert rows(out) == [(1, "already_booked", None), (2, "accepted", 208),
                         (3, "already_booked", None), (4, "unknown_user", None),
                         (5, "duplicate_seat", None), (6, "accepted", 209),
                         (7, "showtime_not_found", None), (8, "seat_not_found", None),
                         (9, "empty_seats", None), (10, "missing_fields", None)]
    assert rows(nxt.booking_seat.where("booking_id >= 208")) == [
        (208, "1", 8, 15), (208, "A", 8, 15), (209, "2", 8, 12)]
    assert rows(nxt.booking.where("booking_id >= 208"), "booking_id", "status") == [
        (208, "Pending"), (209, "Pending")]
    assert "unique" not in {r["rule"] for r in violations_only(nxt).collect()}


def _admit_model(tables, reqs):
    """The reference, one request at a time."""
    show_theater = {r[0]: r[2] for r in tables["showtime"]}
    seats = {(s.lower(), t) for s, t in tables["seat"]}
    users = {u[0] for u in tables["users"]}
    held = {(bs[3], bs[1].lower()) for bs in tables["booking_seat"]}
    next_id = max(b[0] for b in tables["booking"]) + 1
    out = {}
    for rid, user, show, want in sorted(reqs):
        if user is None or show is None or want is None:
            out[rid] = ("missing_fields", None); continue
        if not want:
            out[rid] = ("empty_seats", None); continue
        if show not in show_theater:
            out[rid] = ("showtime_not_found", None); continue
        theater = show_theater[show]
        if any(s is None or (s.lower(), theater) not in seats for s in want):
            out[rid] = ("seat_not_found", None); continue
        if any((show, s.lower()) in held for s in want):
            out[rid] = ("already_booked", None); continue
        if user not in users:
            out[rid] = ("unknown_user", None); continue
        if len({s.lower() for s in want}) < len(want):
            out[rid] = ("duplicate_seat", None); continue
        held |= {(show, s.lower()) for s in want}
        out[rid] = ("accepted", next_id)
        next_id += 1
    return sorted((k, *v) for k, v in out.items())


@pytest.mark.parametrize("seed_value", [1, 2, 3])
def test_admit_matches_sequential_model(spark, seed, seed_value):
    rnd = random.Random(seed_value)
    seat_names = ["1", "2", "3", "10", "A", "a", "Z"]
    reqs = []
    for rid in rnd.sample(range(1, 10_000), 150):
        user = rnd.choice([1, 2, 3, 6, 77, None] + [1] * 6)
        show = rnd.choice([11, 12, 13, 14, 15, 15, 12, 98, None])
        want = None if rnd.random() < 0.03 else [rnd.choice(seat_names)
                                                 for _ in range(rnd.choice([0, 1, 1, 2, 2, 3]))]
        reqs.append((rid, user, show, want))
    _, out = admit_bookings(seed, _requests(spark, reqs))
    assert rows(out) == _admit_model(SEED, reqs)


# ---- M2 ------------------------------------------------------------------------------

def _events(spark, evs):
    return spark.createDataFrame([(b, seq, a, actor, ns, ts("2026-06-01 00:00")) for b, seq, a, actor, ns in evs],
                                 BOOKING_EVENT)


def test_events_seed(spark, seed):
    evs = [(201, 1, "refund", None, None),
           (202, 2, "checkin", None, None),
           (202, 3, "use", None, None),
           (202, 4, "cancel", 2, None),
           (203, 5, "cancel", 3, None),
           (205, 6, "cancel", 1, None),
           (205, 7, "pay", 2, None),
           (207, 8, "create_payment", 1, None),
           (204, 9, "set_status", None, "Bogus"),
           (204, 10, "set_status", None, "Pending"),
           (999, 11, "use", None, None)]
    nxt, out = apply_booking_events(seed, _events(spark, evs))
    assert rows(out, "seq", "outcome") == [
        (1, "ok"), (2, "not_confirmed"), (3, "ok"), (4, "already_used"), (5, "already_cancelled"),
        (6, "unauthorized"), (7, "ok"), (8, "no_seats"), (9, "invalid_status"), (10, "ok"),
        (11, "not_found")]
    status = dict(rows(nxt.booking, "booking_id", "status"))
    assert status[201] == "Cancelled" and status[202] == "Used" and status[205] == "Confirmed"
    assert status[204] == "Pending"
    pay = {r["payment_id"]: r for r in nxt.payment.collect()}
    assert pay[901]["status"] == "Refunded"
    assert (pay[907]["booking_id"], pay[907]["amount"], pay[907]["status"]) == (205, d(120), "Confirmed")


B = ("Pending", "Confirmed", "Cancelled", "Used")


def _events_model(tables, evs):
    book = {b[0]: {"user": b[1], "show": b[2], "status": b[3]} for b in tables["booking"]}
    price = {s[0]: s[4] for s in tables["showtime"]}
    nseat = {}
    for bs in tables["booking_seat"]:
        nseat[bs[0]] = nseat.get(bs[0], 0) + 1
    pay = {}
    for p in sorted(tables["payment"]):
        pay.setdefault(p[1], p[3])          # lowest payment_id per booking
    out = []
    for b, seq, act, actor, ns in sorted(evs, key=lambda e: e[1]):
        bk = book.get(b)
        p = pay.get(b)
        res = "ok"
        if act == "cancel":
            res = ("not_found" if not bk else "unauthorized" if actor != bk["user"] else
                   "already_cancelled" if bk["status"] == "Cancelled" else
                   "already_used" if bk["status"] == "Used" else "ok")
            if res == "ok":
                bk["status"] = "Cancelled"
        elif act == "pay":
            res = ("not_found" if not bk or bk["show"] not in price else
                   "unauthorized" if actor != bk["user"] else
                   "cancelled_booking" if bk["status"] == "Cancelled" else
                   "already_paid" if p == "Confirmed" else "ok")
            if res == "ok":
                pay[b] = "Confirmed"
                bk["status"] = "Confirmed"
        elif act == "create_payment":
            res = ("not_found" if not bk else "unauthorized" if actor != bk["user"] else
                   "payment_exists" if p is not None else
                   "no_seats" if bk["show"] not in price or not nseat.get(b) else "ok")
            if res == "ok":
                pay[b] = "Pending"
                bk["status"] = "Confirmed"
        elif act in ("use", "checkin"):
            res = ("not_found" if not bk else "cancelled_booking" if bk["status"] == "Cancelled" else
                   "already_used" if bk["status"] == "Used" else
                   "not_confirmed" if act == "checkin" and bk["status"] != "Confirmed" else "ok")
            if res == "ok":
                bk["status"] = "Used"
        elif act == "set_status":
            res = ("status_required" if not ns else "invalid_status" if ns not in B else
                   "not_found" if not bk else "ok")
            if res == "ok":
                bk["status"] = ns
        elif act == "refund":
            res = ("payment_not_found" if p is None else "already_refunded" if p == "Refunded" else
                   "not_confirmed" if p != "Confirmed" else "not_found" if not bk else
                   "used_booking" if bk["status"] == "Used" else "ok")
            if res == "ok":
                pay[b] = "Refunded"
                bk["status"] = "Cancelled"
        out.append((seq, res))
    return out, {k: v["status"] for k, v in book.items()}, pay


@pytest.mark.parametrize("seed_value,width", [(1, 1024), (2, 3), (3, 2)])
def test_events_match_sequential_model(spark, seed, seed_value, width):
    rnd = random.Random(seed_value)
    actions = ["cancel", "pay", "create_payment", "use", "checkin", "set_status", "refund"]
    evs = []
    for seq in rnd.sample(range(0, 5000), 200):
        b = rnd.choice([201, 202, 203, 204, 205, 206, 207, 999, 202, 205])
        actor = rnd.choice([1, 2, 3, None])
        ns = rnd.choice(["Pending", "Confirmed", "Used", "Cancelled", "Bogus", "", None])
        evs.append((b, seq, rnd.choice(actions), actor, ns))
    want_out, want_status, want_pay = _events_model(SEED, evs)
    nxt, out = apply_booking_events(seed, _events(spark, evs), width=width)
    assert rows(out, "seq", "outcome") == sorted(want_out)
    got_status = dict(rows(nxt.booking, "booking_id", "status"))
    assert got_status == want_status
    got_pay = {}
    for r in sorted(nxt.payment.collect(), key=lambda r: r["payment_id"]):
        got_pay.setdefault(r["booking_id"], r["status"])
    assert got_pay == want_pay


# ---- M3 -------------------------------------------------------------------------------

def test_moves_seed(spark, seed):
    moves = [(1, 202, 2, None, ["3"]),      # 3 is held by Cancelled 203: refused
             (2, 205, 2, 15, ["2"]),        # to another showtime
             (3, 202, 2, None, ["1"]),      # second move of 202
             (4, 201, 2, None, ["2"]),      # not the owner
             (5, 204, 1, None, ["2"]),      # Used booking
             (6, 207, 1, 11, None),         # new showtime without seats
             (7, 206, 3, None, ["1", "1"]),  # repeated seat
             (8, 201, 1, None, None)]
    nxt, out = reassign_bookings(seed, spark.createDataFrame(moves, BOOKING_MOVE))
    assert rows(out) == [(1, "already_booked"), (2, "moved"), (3, "duplicate_move"),
                         (4, "unauthorized"), (5, "closed_booking"), (6, "seats_required"),
                         (7, "duplicate_seat"), (8, "nothing_to_update")]
    assert rows(nxt.booking_seat.where("booking_id = 205")) == [(205, "2", 8, 15)]
    assert rows(nxt.booking.where("booking_id = 205"), "showtime_id") == [(15,)]


# ---- M4 -------------------------------------------------------------------------------

def test_next_ids_dense_in_order_across_partitions(spark):
    keys = list(range(0, 3000, 3))
    random.Random(5).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    got = sorted((r["k"], r["new_id"]) for r in next_ids(df, ["k"], 100, "new_id").collect())
    assert got == [(k, 101 + i) for i, k in enumerate(sorted(keys))]


# ---- M5-M9 ------------------------------------------------------------------------------

def test_insert_movies(spark, seed):
    new = spark.createDataFrame(
        [(1, 601, 61, "New One", 90), (2, 601, 62, "Second Try", 91), (3, 602, 99, "No Owner", 90),
         (4, 501, 61, "Dup", 90), (5, 603, 62, "", 90), (6, 604, 61, "Zero", 0), (7, 605, 0, "Zero owner", 90)],
        "request_id long, movie_id long, owner_id long, title string, duration int")
    nxt, out = insert_rows(seed, "movie", new)
    assert rows(out) == [(1, "inserted"), (2, "duplicate_key"), (3, "unknown_reference"),
                         (4, "duplicate_key"), (5, "missing_fields"), (6, "missing_fields"),
                         (7, "missing_fields")]
    assert rows(nxt.movie.where("movie_id = 601"), "title") == [("New One",)]


def test_insert_genre_is_case_insensitive_key(spark, seed):
    g = spark.createDataFrame([(1, 501, "ACTION"), (2, 502, "Action"), (3, 999, "x")],
                              "request_id long, movie_id long, genre string")
    _, out = insert_rows(seed, "movie_genre", g)
    assert rows(out) == [(1, "duplicate_key"), (2, "inserted"), (3, "unknown_reference")]


def test_register_users(spark, seed):
    u = spark.createDataFrame(
        [(1, 10, "Gus", "gus@x.io", "pw", None), (2, 11, "Hal", "GUS@X.IO", "pw", None),
         (3, 10, "Ivy", "ivy@x.io", "pw", None), (4, 12, "Jo", "ann@X.io", "pw", None),
         (5, 13, "Kim", "kim@x.io", "pw", "admin"), (6, 14, "Lu", "lu@x.io", "", None),
         (7, 1, "Max", "max@x.io", "pw", "customer")],
        "request_id long, user_id long, name string, email string, password string, role string")
    nxt, out = register_users(seed, u)
    assert rows(out) == [(1, "inserted"), (2, "duplicate_email"), (3, "duplicate_key"),
                         (4, "duplicate_email"), (5, "role_not_allowed"), (6, "missing_fields"),
                         (7, "duplicate_key")]
    assert rows(nxt.users.where("user_id = 10"), "role") == [("customer",)]


def test_replace_showtimes_last_valid_wins(spark, seed):
    r = spark.createDataFrame(
        [(1, 11, 502, 8, ts("2026-07-01 10:00"), d(70)), (2, 11, 503, 9, ts("2026-07-02 10:00"), d(75)),
         (3, 11, 999, 9, ts("2026-07-03 10:00"), d(75)), (4, 77, 502, 8, ts("2026-07-01 10:00"), d(70)),
         (5, 12, 502, 8, ts("2026-07-01 10:00"), d(0))],
        "request_id long, showtime_id long, movie_id long, theater_id long, show_date timestamp_ntz, "
        "price decimal(10,2)")
    nxt, out = replace_showtimes(seed, r)
    assert rows(out) == [(1, "updated"), (2, "updated"), (3, "unknown_reference"),
                         (4, "not_found"), (5, "missing_fields")]
    assert rows(nxt.showtime.where("showtime_id = 11")) == [(11, 503, 9, ts("2026-07-02 10:00"), d(75))]


def test_patch_movies(spark, seed):
    p = spark.createDataFrame(
        [(1, 501, {"title": "Owl II", "rating": "8.0"}), (2, 501, {"description": None}),
         (3, 502, {"duration": "abc"}), (4, 502, {"owner_id": "999"}), (5, 503, {"title": None}),
         (6, 504, {"title": "x"}), (7, 503, {"movie_id": "1"}), (8, 501, {"title": "Owl III"})],
        MOVIE_PATCH)
    nxt, out = patch_movies(seed, p)
    assert rows(out) == [(1, "updated"), (2, "updated"), (3, "invalid_value"),
                         (4, "unknown_reference"), (5, "null_not_allowed"), (6, "not_found"),
                         (7, "nothing_to_update"), (8, "updated")]
    m = nxt.movie.where("movie_id = 501").collect()[0]
    assert (m["title"], m["rating"], m["description"], m["duration"]) == ("Owl III", d(8.0), None, 95)


def test_delete_movie_cascades(spark, seed):
    keys = spark.createDataFrame([(1, 501), (2, 777)], "request_id long, movie_id long")
    nxt, out = delete_cascade(seed, "movie", keys)
    assert rows(out) == [(1, "deleted"), (2, "not_found")]
    sizes = dict(rows(table_sizes(nxt)))
    # movie 501 -> showtimes 11, 12 -> bookings 201-204 -> 5 held seats, 4 payments
    assert sizes == {"producer": 3, "users": 6, "theater": 3, "movie": 2, "showtime": 3,
                     "movie_genre": 1, "booking": 3, "seat": 8, "booking_seat": 2, "payment": 2}
    fk = [r for r in violations_only(nxt).collect() if r["rule"] == "foreign_key"]
    assert [(r["table_name"], r["columns"]) for r in fk] == [("movie", "owner_id")]  # seeded only


def test_delete_producer_restricted(spark, seed):
    keys = spark.createDataFrame([(1, 61), (2, 63)], "request_id long, owner_id long")
    nxt, out = delete_cascade(seed, "producer", keys)
    assert rows(out) == [(1, "restricted"), (2, "deleted")]
    assert rows(nxt.producer, "owner_id") == [(61,), (62,)]


def test_hot_showtime_third_of_requests(spark, seed):
    """One showtime gets a third of all requests; results still equal the one-by-one model."""
    rnd = random.Random(11)
    reqs = []
    for rid in range(1, 601):
        show = 15 if rid % 3 == 0 else rnd.choice([11, 12, 13, 14])
        want = [rnd.choice(["1", "2", "3", "10", "A"]) for _ in range(rnd.choice([1, 1, 2]))]
        reqs.append((rid, rnd.choice([1, 2, 3, 6]), show, want))
    _, out = admit_bookings(seed, _requests(spark, reqs))
    assert rows(out) == _admit_model(SEED, reqs)


def test_requests_from_form_text(spark, seed):
    from seatspark.sources.requests import requests_from_text
    form = spark.createDataFrame([(1, 6, 15, " 1 , a"), (2, 6, 12, "  ")],
                                 "request_id long, user_id long, showtime_id long, seats_text string")
    _, out = admit_bookings(seed, requests_from_text(form))
    assert rows(out, "request_id", "outcome") == [(1, "accepted"), (2, "empty_seats")]


def test_one_booking_with_thousands_of_events(spark, seed):
    """A hot booking (3,000 events) takes the chunk-and-tree path at the default width."""
    rnd = random.Random(21)
    actions = ["use", "set_status", "checkin", "cancel", "pay", "refund"]
    evs = [(202, seq, rnd.choice(actions), 2, rnd.choice(B)) for seq in range(3000)]
    evs += [(205, 5000 + i, "use", None, None) for i in range(3)]
    want_out, want_status, want_pay = _events_model(SEED, evs)
    nxt, out = apply_booking_events(seed, _events(spark, evs))
    assert rows(out, "seq", "outcome") == sorted(want_out)
    assert dict(rows(nxt.booking, "booking_id", "status")) == want_status


# ---- rows and values that a batch must survive ----------------------------------------

def test_refund_changes_every_payment_of_the_booking(spark, seed):
    pays = spark.createDataFrame([(1, 206, d(50), "Confirmed", None), (2, 206, d(10), "Pending", None),
                                  (3, 201, d(9), "Confirmed", None)], seed.payment.schema)
    nxt, out = apply_booking_events(seed.with_(payment=pays), _events(spark, [(206, 1, "refund", 3, None)]))
    assert rows(out, "outcome") == [("ok",)]
    assert rows(nxt.payment, "payment_id", "status") == [(1, "Refunded"), (2, "Refunded"), (3, "Confirmed")]


def test_events_without_booking_or_order_are_refused(spark, seed):
    evs = spark.createDataFrame([(None, 1, "cancel", 1), (202, None, "cancel", 2), (202, 3, "cancel", 2)],
                                "booking_id long, seq long, action string, actor_id long")
    nxt, out = apply_booking_events(seed, evs.selectExpr("*", "cast(null as string) new_status",
                                                         "cast(null as timestamp_ntz) at"))
    assert sorted(r["outcome"] for r in out.collect()) == ["missing_fields", "missing_fields", "ok"]


@pytest.mark.parametrize("width", [2, 8, 1024])
def test_event_order_of_any_integers(spark, seed, width):
    rnd = random.Random(width)
    actions = ["cancel", "pay", "use", "checkin", "set_status", "refund"]
    big = 1_700_000_000_000_000_000
    seqs = [-9, -3, 0, 1, 7] + [big + k for k in range(60)]
    evs = [(202, q, rnd.choice(actions), 2, rnd.choice(["Pending", "Confirmed", "Used"])) for q in seqs]
    want_out, want_status, _ = _events_model(SEED, evs)
    nxt, out = apply_booking_events(seed, _events(spark, evs), width=width)
    assert rows(out, "seq", "outcome") == sorted(want_out)
    assert dict(rows(nxt.booking, "booking_id", "status")) == want_status


def test_payment_without_time_is_dated(spark, seed):
    nxt, _ = apply_booking_events(seed, _events(spark, [(207, 1, "pay", 1, None)]))
    made = nxt.payment.join(seed.payment.select("payment_id"), "payment_id", "left_anti").collect()
    assert all(r["payment_date"] is not None for r in made)


def test_repeated_and_missing_request_ids_are_refused(spark, seed):
    reqs = spark.createDataFrame([(1, 6, 15, ["1"]), (1, 2, 15, ["1"]), (None, 6, 15, ["2"]), (2, 6, 15, ["1"])],
                                 "request_id long, user_id long, showtime_id long, seats array<string>")
    nxt, out = admit_bookings(seed, reqs.selectExpr("*", "cast(null as timestamp_ntz) requested_at"))
    assert sorted((r["request_id"] or 0, r["outcome"]) for r in out.collect()) == [
        (0, "missing_fields"), (1, "duplicate_request"), (1, "duplicate_request"), (2, "accepted")]
    assert "unique" not in {r["rule"] for r in violations_only(nxt).collect()}


def test_move_changes_the_lowest_payment_only(spark, seed):
    pays = spark.createDataFrame([(1, 205, d(1), "Pending", None), (2, 205, d(2), "Pending", None)], seed.payment.schema)
    nxt, out = reassign_bookings(seed.with_(payment=pays), spark.createDataFrame([(1, 205, 2, 15, ["2"])], BOOKING_MOVE))
    assert rows(out, "outcome") == [("moved",)]
    assert rows(nxt.payment, "payment_id", "amount") == [(1, d(90)), (2, d(2))]


def test_register_without_a_role_column(spark, seed):
    new = spark.createDataFrame([(1, 50, "Gil", "gil@x.io", "p")], "request_id long, user_id long, name string, "
                                "email string, password string")
    nxt, out = register_users(seed, new)
    assert rows(out, "outcome") == [("inserted",)]
    assert rows(nxt.users.where("user_id = 50"), "role") == [("customer",)]


# ---- admission by folds: all sizes, few jobs --------------------------------------------

def _jobs(spark, fn):
    """Jobs that ``fn`` starts."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        fn()
    finally:
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def _hot_requests(n, seats, seed_value):
    """A third of all requests want seat 1 of one showtime, the others of it a few seats."""
    rnd = random.Random(seed_value)
    out = []
    for rid in rnd.sample(range(1, 50 * n), n):
        kind = rnd.random()
        if kind < 0.33:
            out.append((rid, rnd.choice([1, 2, 3, 6]), 15, ["1"] + rnd.sample(seats, rnd.choice([0, 1]))))
        elif kind < 0.8:
            out.append((rid, rnd.choice([1, 2, 77]), 15, rnd.sample(seats, rnd.choice([1, 2, 3]))))
        else:
            out.append((rid, 1, 12, rnd.sample(seats, 2)))
    return out


@pytest.mark.parametrize("width", [2, 40, 4096])
def test_admission_is_the_same_at_every_width(spark, seed, width):
    seats = [str(k) for k in range(1, 131)]  # three words of bits
    tables = {**SEED, "seat": [(s, 8) for s in seats] + [("1", 7), ("1", 9)], "booking_seat": [(204, "1", 8, 12)]}
    t = tables_from_rows(spark, tables)
    reqs = _hot_requests(120, seats, 5)
    _, out = admit_bookings(t, _requests(spark, reqs), width=width)
    assert rows(out) == _admit_model(tables, reqs)


def test_admission_takes_few_jobs_whatever_the_seats(spark, seed):
    def run(n_seats):
        seats = [str(k) for k in range(1, n_seats + 1)]
        t = tables_from_rows(spark, {**SEED, "seat": [(s, 8) for s in seats], "booking_seat": []})
        # each request clashes with the one before it, so rounds of lowest claimants would follow the chain
        reqs = [(k, 1, 15, [str(k), str(k + 1)]) for k in range(1, n_seats)]
        result = {}
        jobs = _jobs(spark, lambda: result.update(out=rows(admit_bookings(t, _requests(spark, reqs))[1], "request_id", "outcome")))
        assert result["out"] == [(k, "accepted" if k % 2 else "already_booked") for k in range(1, n_seats)]
        return jobs

    run(10)
    assert run(120) <= run(10) + 2


def test_seats_that_differ_in_case_only_do_not_fail_admission(spark, seed):
    t = tables_from_rows(spark, {**SEED, "seat": SEED["seat"] + [("a", 8)]})
    _, out = admit_bookings(t, _requests(spark, [(1, 6, 15, ["a"]), (2, 6, 15, ["A"]), (3, 6, 15, ["2"])]))
    assert rows(out, "request_id", "outcome") == [(1, "accepted"), (2, "already_booked"), (3, "accepted")]


# ---- users: two keys that interact -----------------------------------------------------

USER = "request_id long, user_id long, name string, email string, password string, role string"


def _users_model(tables, new):
    """One at a time; what the table holds already is looked at first."""
    old_ids, old_mails = {u[0] for u in tables["users"]}, {u[2].lower() for u in tables["users"]}
    ids, mails, out = set(), set(), []
    for rid, uid, name, mail, pw, role in sorted(new):
        if uid in old_ids:
            out.append((rid, "duplicate_key"))
        elif mail.lower() in old_mails:
            out.append((rid, "duplicate_email"))
        elif uid in ids or mail.lower() in mails:
            out.append((rid, "duplicate_key" if uid in ids else "duplicate_email"))
        else:
            out.append((rid, "inserted"))
            ids.add(uid)
            mails.add(mail.lower())
    return sorted(out)


def _chain(n):
    """Requests k and k+1 share an id or an e-mail in turn: one component of n rows, decided from its beginning."""
    return [(k, 100 + k // 2, "N", f"m{(k + 1) // 2}@x.io", "pw", "customer") for k in range(1, n + 1)]


def test_a_chain_of_10000_users_takes_as_many_jobs_as_a_short_one(spark, seed):
    def run(n):
        new, result = _chain(n), {}
        df = spark.createDataFrame(new, USER)
        jobs = _jobs(spark, lambda: result.update(out=rows(insert_rows(seed, "users", df)[1])))
        assert result["out"] == _users_model(SEED, new)
        return jobs

    short, long = run(200), run(10_000)
    assert long <= 2 * short


@pytest.mark.parametrize("fold_rows", [12, 20_000])
def test_user_inserts_match_the_one_by_one_model(spark, seed, fold_rows):
    rnd = random.Random(fold_rows)
    new = [(rid, rnd.choice([7, rnd.randint(8, 60)]), "N", rnd.choice(["Hot@x.io", f"M{rnd.randint(1, 40)}@x.io", "m3@X.io", "ann@x.io"]),
            "pw", "customer") for rid in rnd.sample(range(5000), 90)]
    new += [(6000 + rid, 300 + uid, n, "c" + m, p, r) for rid, uid, n, m, p, r in _chain(16)]
    rnd.shuffle(new)
    nxt, out = dml._insert_users(seed, spark.createDataFrame(new, USER).repartition(3), fold_rows)
    assert rows(out) == _users_model(SEED, new)
    assert not {r["rule"] for r in violations_only(nxt).collect()} & {"primary_key", "unique"}


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(3)
    names = rnd.sample(range(10_000), 700)
    edges = list(zip(names[:500], names[1:500])) + [(names[500], x) for x in names[501:600]] + [(names[600], names[600])]
    edges += [(names[601], names[602])] * 3 + [(None, names[603])]
    rnd.shuffle(edges)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    want = {x: min(names[:500]) for x in names[:500]} | {x: min(names[500:600]) for x in names[500:600]}
    want |= {x: min(names[601:603]) for x in names[601:603]}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


# ---- batches with missing, repeated and malformed ids and values ------------------------

def _by_request(out):
    return sorted((r["request_id"] if r["request_id"] is not None else -1, r["outcome"]) for r in out.collect())


def test_inserts_with_repeated_missing_and_malformed_ids(spark, seed):
    new = spark.createDataFrame([("1", "9", "Again"), ("2", "20", "A"), ("2", "20", "B"), (None, "21", "C"), ("x", "22", "D"),
                                 ("5", "abc", "E"), ("6", "23", "F")], "request_id string, theater_id string, theater_name string")
    nxt, out = insert_rows(seed, "theater", new)
    assert _by_request(out) == [(-1, "missing_fields"), (-1, "missing_fields"), (1, "duplicate_key"), (2, "duplicate_request"),
                                (2, "duplicate_request"), (5, "missing_fields"), (6, "inserted")]
    assert rows(nxt.theater, "theater_id") == [(7,), (8,), (9,), (23,)]


def test_users_with_repeated_missing_and_malformed_ids(spark, seed):
    new = spark.createDataFrame(
        [("1", "70", "A", "a@x", "p", None), ("1", "70", "A", "a@x", "p", None), (None, "71", "B", "b@x", "p", None),
         ("3", "abc", "C", "c@x", "p", None), ("4", "72", "D", "d@x", "p", "admin"), ("5", "73", "E", "e@x", "p", None)],
        "request_id string, user_id string, name string, email string, password string, role string")
    nxt, out = register_users(seed, new)
    assert _by_request(out) == [(-1, "missing_fields"), (1, "duplicate_request"), (1, "duplicate_request"),
                                (3, "missing_fields"), (4, "role_not_allowed"), (5, "inserted")]
    assert rows(nxt.users.where("user_id > 6"), "user_id") == [(73,)]


def test_replacements_patches_and_deletes_survive_bad_rows(spark, seed):
    reps = spark.createDataFrame([("1", "11", "501", "7", "100"), ("2", "x", "501", "7", "100")],
                                 "request_id string, showtime_id string, movie_id string, theater_id string, price string")
    _, out = replace_showtimes(seed, reps)  # without a show_date
    assert _by_request(out) == [(1, "missing_fields"), (2, "missing_fields")]
    given = reps.selectExpr("*", "'2026-08-01 10:00:00' show_date")
    nxt, out = replace_showtimes(seed, given.unionByName(given))
    assert _by_request(out) == [(1, "duplicate_request")] * 2 + [(2, "duplicate_request")] * 2
    patches = spark.createDataFrame([("1", "abc", {"title": "x"}), (None, "501", {"title": "y"}), ("3", "501", {"title": "z"})],
                                    "request_id string, movie_id string, patch map<string,string>")
    nxt, out = patch_movies(seed, patches)
    assert _by_request(out) == [(-1, "missing_fields"), (1, "not_found"), (3, "updated")]
    keys = spark.createDataFrame([("1", "abc"), ("2", "503"), ("2", "501"), (None, "502"), ("4", "502")], "request_id string, movie_id string")
    nxt, out = delete_cascade(seed, "movie", keys)
    assert _by_request(out) == [(-1, "missing_fields"), (1, "not_found"), (2, "duplicate_request"), (2, "duplicate_request"), (4, "deleted")]
    assert rows(nxt.movie, "movie_id") == [(501,), (503,)]


def test_an_amount_too_large_fails_its_event_or_move_only(spark, seed):
    dear = seed.showtime.withColumn("price", F.expr("case when showtime_id in (11, 13) then 99999999.99 else price end")
                                    .cast("decimal(10,2)"))
    t = seed.with_(showtime=dear)
    nxt, out = apply_booking_events(t, _events(spark, [(201, 1, "refund", 1, None), (201, 2, "set_status", 1, "Pending"),
                                                       (201, 3, "pay", 1, None), (205, 4, "pay", 2, None)]))
    assert rows(out, "seq", "outcome") == [(1, "ok"), (2, "ok"), (3, "amount_too_large"), (4, "ok")]
    nxt, out = reassign_bookings(t, spark.createDataFrame(
        [(1, 202, 2, None, ["2", "3x"]), (2, 206, 3, 13, ["2", "3"]), (3, 205, 2, None, ["2"])], BOOKING_MOVE))
    assert rows(out) == [(1, "seat_not_found"), (2, "amount_too_large"), (3, "moved")]
    assert rows(nxt.booking_seat.where("booking_id = 206"), "showtime_id") == [(14,)]


@pytest.mark.parametrize("width", [2, 1024])
def test_events_that_share_an_order_are_refused(spark, seed, width):
    evs = [(202, 5, "cancel", 2, None), (202, 5, "use", 2, None), (205, 5, "use", 2, None)] + [
        (202, 1000 ** k, "set_status", 2, "Used" if k % 2 else "Pending") for k in range(6)]
    nxt, out = apply_booking_events(seed, _events(spark, evs), width=width)
    assert sorted(rows(out, "booking_id", "seq", "outcome")) == sorted(
        [(202, 5, "duplicate_event")] * 2 + [(205, 5, "ok")] + [(202, 1000 ** k, "ok") for k in range(6)])
    assert dict(rows(nxt.booking, "booking_id", "status"))[202] == "Used"


def test_chunks_hold_width_events_however_sparse_the_order(spark):
    evs = spark.createDataFrame([(1, 10 ** 15 * k) for k in range(50)] + [(2, k) for k in range(7)], "k long, o long")
    got = rows(ranked(evs.repartition(5), "k", "o"), "k", "o", "rank")
    assert got == [(1, 10 ** 15 * k, k) for k in range(50)] + [(2, k, k) for k in range(7)]


@pytest.mark.parametrize("table, key", [("movie", "movie_id"), ("theater", "theater_id"), ("users", "user_id")])
def test_cascades_leave_no_orphans(spark, seed, table, key):
    value = seed.get(table).agg(F.min(key)).first()[0]
    nxt, out = delete_cascade(seed, table, spark.createDataFrame([(1, value)], f"request_id long, {key} long"))
    assert rows(out) == [(1, "deleted")]
    before = {(r["table_name"], r["columns"]) for r in violations_only(seed).collect() if r["rule"] == "foreign_key"}
    after = {(r["table_name"], r["columns"]) for r in violations_only(nxt).collect() if r["rule"] == "foreign_key"}
    assert after <= before
