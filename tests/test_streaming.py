"""Streams: each second micro-batch sees what the first one wrote."""

import json
import os
import tempfile

from conftest import d, rows

from seatspark.sources.tables import write_tables
from seatspark.streaming.admission import current_tables, read_outcomes, start_admission_stream


def test_admission_stream_two_batches(spark, seed):
    root = tempfile.mkdtemp(prefix="seatspark-stream-")
    base, incoming = os.path.join(root, "base"), os.path.join(root, "incoming")
    write_tables(seed, base)
    os.makedirs(incoming)
    batches = [[{"request_id": 1, "user_id": 6, "showtime_id": 15, "seats": ["1"]},
                {"request_id": 2, "user_id": 2, "showtime_id": 15, "seats": ["1", "2"]}],
               [{"request_id": 3, "user_id": 3, "showtime_id": 15, "seats": ["1"]},
                {"request_id": 4, "user_id": 3, "showtime_id": 15, "seats": ["A"]}]]
    for i, batch in enumerate(batches):
        path = os.path.join(incoming, f"part-{i}.json")
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(r) for r in batch))
        os.utime(path, (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))  # arrival order
    q = start_admission_stream(spark, base, incoming, os.path.join(root, "out"),
                               os.path.join(root, "chk"), files_per_batch=1, available_now=True)
    q.awaitTermination(300)
    got = rows(read_outcomes(spark, os.path.join(root, "out")), "request_id", "outcome",
               "booking_id", "batch_id")
    assert got == [(1, "accepted", 208, 0), (2, "already_booked", None, 0),
                   (3, "already_booked", None, 1), (4, "accepted", 209, 1)]
    t = current_tables(spark, base, os.path.join(root, "out"), 99)
    assert rows(t.booking_seat.where("booking_id >= 208")) == [(208, "1", 8, 15), (209, "A", 8, 15)]


def test_events_stream_merges_changes(spark, seed):
    from seatspark.streaming import events as ES
    root = tempfile.mkdtemp(prefix="seatspark-events-")
    base, incoming = os.path.join(root, "base"), os.path.join(root, "incoming")
    write_tables(seed, base)
    os.makedirs(incoming)
    batches = [[{"booking_id": 205, "seq": 1, "action": "pay", "actor_id": 2},
                {"booking_id": 202, "seq": 2, "action": "use"}],
               [{"booking_id": 205, "seq": 3, "action": "refund"},
                {"booking_id": 202, "seq": 4, "action": "cancel", "actor_id": 2},
                {"booking_id": 207, "seq": 5, "action": "pay", "actor_id": 1}]]
    for i, batch in enumerate(batches):
        path = os.path.join(incoming, f"part-{i}.json")
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(r) for r in batch))
        os.utime(path, (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
    out = os.path.join(root, "out")
    q = ES.start_events_stream(spark, base, incoming, out, os.path.join(root, "chk"),
                               files_per_batch=1, available_now=True)
    q.awaitTermination(300)
    got = rows(spark.read.parquet(os.path.join(out, "outcomes")), "seq", "outcome", "batch_id")
    assert got == [(1, "ok", 0), (2, "ok", 0), (3, "ok", 1), (4, "already_used", 1), (5, "ok", 1)]
    t = ES.current_tables(spark, base, out, 99)
    status = dict(rows(t.booking, "booking_id", "status"))
    assert (status[205], status[202], status[207]) == ("Cancelled", "Used", "Confirmed")
    pay = {r["payment_id"]: (r["booking_id"], r["status"], r["amount"]) for r in t.payment.collect()}
    assert pay[907] == (205, "Refunded", d(120))      # created in batch 0, refunded in batch 1
    assert pay[908] == (207, "Confirmed", d(0))       # no seats: 0 x price
    assert len(pay) == 8


def test_rerun_of_a_micro_batch_is_idempotent(spark, seed):
    """Spark may run a micro-batch again after a failure: same output, no duplicates."""
    from seatspark.schemas import BOOKING_REQUEST
    from seatspark.streaming.admission import admit_batch
    root = tempfile.mkdtemp(prefix="seatspark-rerun-")
    base, out = os.path.join(root, "base"), os.path.join(root, "out")
    write_tables(seed, base)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    batch = spark.createDataFrame([(1, 6, 15, ["1"], None), (2, 2, 15, ["2"], None)], BOOKING_REQUEST)
    for _ in range(2):
        admit_batch(spark, base, out, batch, 0)
    got = rows(read_outcomes(spark, out), "request_id", "outcome", "booking_id")
    assert got == [(1, "accepted", 208), (2, "accepted", 209)]
    t = current_tables(spark, base, out, 1)
    assert t.booking.where("booking_id >= 208").count() == 2
    assert t.booking_seat.where("booking_id >= 208").count() == 2


def test_compacted_changes_read_the_same(spark, seed):
    from seatspark.schemas import BOOKING_EVENT
    from seatspark.streaming import events as ES
    root = tempfile.mkdtemp(prefix="seatspark-compact-")
    base, out = os.path.join(root, "base"), os.path.join(root, "out")
    write_tables(seed, base)
    batches = [[(205, 1, "pay", 2, None, None)], [(202, 2, "use", None, None, None)],
               [(205, 3, "refund", None, None, None), (207, 4, "pay", 1, None, None)]]
    for k, rows_ in enumerate(batches):
        ES.apply_events_batch(spark, base, out, spark.createDataFrame(rows_, BOOKING_EVENT), k)
    before = {n: rows(ES.current_tables(spark, base, out, 99).get(n)) for n in ("booking", "payment")}
    ES.compact(spark, out, 3)
    assert os.listdir(os.path.join(out, "changes", "booking")).count("batch_id=2") == 1
    assert not any(f in os.listdir(os.path.join(out, "changes", n)) for n in before for f in ("batch_id=0", "batch_id=1"))
    assert {n: rows(ES.current_tables(spark, base, out, 99).get(n)) for n in before} == before
    ES.apply_events_batch(spark, base, out, spark.createDataFrame([(202, 5, "set_status", None, "Pending", None)], BOOKING_EVENT), 3)
    assert dict(rows(ES.current_tables(spark, base, out, 99).booking, "booking_id", "status"))[202] == "Pending"


def test_events_see_bookings_of_the_admission_stream(spark, seed):
    from seatspark.schemas import BOOKING_EVENT, BOOKING_REQUEST
    from seatspark.streaming import events as ES
    from seatspark.streaming.admission import admit_batch
    root = tempfile.mkdtemp(prefix="seatspark-both-")
    base, added, out = (os.path.join(root, x) for x in ("base", "added", "out"))
    write_tables(seed, base)
    admit_batch(spark, base, added, spark.createDataFrame([(1, 6, 15, ["1", "2"], None)], BOOKING_REQUEST), 0)
    ES.apply_events_batch(spark, base, out, spark.createDataFrame([(208, 1, "pay", 6, None, None)], BOOKING_EVENT), 0, admitted=added)
    assert rows(spark.read.parquet(os.path.join(out, "outcomes")), "booking_id", "outcome") == [(208, "ok")]
    t = ES.current_tables(spark, base, out, 99, admitted=added)
    assert dict(rows(t.booking, "booking_id", "status"))[208] == "Confirmed"
    assert rows(t.payment.where("booking_id = 208"), "amount", "status") == [(d(180), "Confirmed")]
