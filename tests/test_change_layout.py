"""How the changes are laid out: inputs derived once, no seat lists in the shuffles of requests."""

import pytest

from seatspark import scenarios as S
from seatspark.catalog import queries
from seatspark.operators import admit as A
from seatspark.operators import moves as M
from seatspark.schemas import BOOKING_MOVE, BOOKING_REQUEST
from seatspark.sources import requests as R

from conftest import SMALL_SF, rows

REQUESTS = [(1, 1, 15, ["1"], None), (2, 2, 15, ["1", "a"], None), (3, 3, 15, ["A"], None), (4, 1, 11, ["1"], None),
            (5, 77, 15, ["1"], None), (6, 1, 15, ["9"], None), (7, 1, 99, ["1"], None), (8, 1, 13, ["10", "10"], None),
            (9, 1, 13, ["10", "2"], None)]
OUTCOMES = [(1, "accepted"), (2, "already_booked"), (3, "accepted"), (4, "already_booked"), (5, "already_booked"),
            (6, "seat_not_found"), (7, "showtime_not_found"), (8, "duplicate_seat"), (9, "accepted")]


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _shuffled(df) -> list[str]:
    """The output columns of every exchange in the plan that would run."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.initialPlan() if "Adaptive" in plan.getClass().getName() else plan]
    while todo:
        node = todo.pop()
        if "ShuffleExchange" in node.getClass().getName():
            found.append(node.output().mkString(","))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def _watched(monkeypatch, module) -> list:
    seen, real = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(_shuffled(df)) or real(df))
    return seen


def test_admission_shuffles_no_seat_lists_of_requests(spark, seed, no_broadcasts, monkeypatch):
    seen = _watched(monkeypatch, A)
    _, out = A.admit_bookings(seed, spark.createDataFrame(REQUESTS, BOOKING_REQUEST))
    assert rows(out, "request_id", "outcome") == OUTCOMES
    assert any("request_id" in x for plan in seen for x in plan)
    assert not [x for plan in seen for x in plan if "request_id" in x and "seat_map" in x]


def test_moves_shuffle_no_seat_lists_of_requests(spark, seed, no_broadcasts, monkeypatch):
    seen = _watched(monkeypatch, M)
    nxt, out = M.reassign_bookings(seed, spark.createDataFrame(
        [(1, 205, 2, 15, ["2"]), (2, 202, 2, 15, ["2"]), (3, 202, 2, 13, ["1"]), (4, 207, 1, None, ["a", "A"]),
         (5, 201, 1, 13, None), (6, 206, 3, None, ["1"])], BOOKING_MOVE))
    assert rows(out) == [(1, "moved"), (2, "already_booked"), (3, "duplicate_move"), (4, "duplicate_seat"),
                         (5, "seats_required"), (6, "moved")]
    assert any("request_id" in x for plan in seen for x in plan)
    assert not [x for plan in seen for x in plan if "request_id" in x and "seat_map" in x]
    assert {(r.booking_id, r.seat_number, r.showtime_id) for r in nxt.booking_seat.collect()} >= {(205, "2", 15), (206, "1", 14)}


def test_admission_derives_its_requests_once(spark, seed):
    derived = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            derived.add(len(batch))
            yield batch

    _, out = A.admit_bookings(seed, spark.createDataFrame(REQUESTS, BOOKING_REQUEST).mapInPandas(counted, BOOKING_REQUEST))
    assert rows(out, "request_id", "outcome") == OUTCOMES
    assert derived.value == len(REQUESTS)


def test_payloads_and_moves_read_stored_input(spark, monkeypatch):
    files = []
    real = R.parse_payloads
    monkeypatch.setattr(S, "parse_payloads", lambda lines, *a: files.extend(lines.inputFiles()) or real(lines, *a))
    S.payload_admission(spark, SMALL_SF)
    assert files and not [f for f in files if "lineitem" in f]
    for name in ("reassign_bookings_seats", "reassign_bookings_payment", "moves_two_payments"):
        assert not [f for f in queries()[name](spark, SMALL_SF).inputFiles() if "lineitem" in f]
