"""M2: apply many booking and payment events, in ``seq`` order per booking.

State of a booking while its events run: booking status B (4 values), payment
status P (none or 4 values), whether the amount was recomputed in the batch
(A), whether the payment row was created in the batch (I): 80 codes. Seats
and price are constant within a batch and ride along on each event. Checks per
action, in order (a failed check changes nothing):

=============== ======================================================= ==============================
action          checks -> outcome                                        change on ``ok``
=============== ======================================================= ==============================
cancel          not_found, unauthorized, already_cancelled, already_used B = Cancelled
pay             not_found (booking or its showtime), unauthorized,       P = Confirmed (insert if none),
                cancelled_booking, already_paid, amount_too_large        amount = seats x price,
                                                                         B = Confirmed
create_payment  not_found, unauthorized, payment_exists,                 insert P = Pending,
                no_seats (no seat or no showtime), amount_too_large      amount = seats x price,
                                                                         B = Confirmed
use             not_found, cancelled_booking, already_used               B = Used
checkin         not_found, cancelled_booking, already_used,              B = Used
                not_confirmed
set_status      status_required, invalid_status, not_found               B = new_status
refund          payment_not_found, already_refunded, not_confirmed,      P = Refunded, B = Cancelled
                not_found, used_booking
=============== ======================================================= ==============================

The per-booking fold runs through ``fold_scan`` (no booking's events are
ever gathered in one group). A booking is assumed to have at most one payment
(audit rule one_payment_per_booking); if it has more, the lowest payment_id is
the one read and written, as a single-row fetch would pick one; a refund sets
all payments of the booking to Refunded. Events without booking_id or seq are
refused as missing_fields; events of one booking that share a seq have no order
among themselves and are refused as duplicate_event. An amount that its column
cannot hold fails the event as amount_too_large, as the refused write would. A
payment made by an event without a time is dated now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BOOKING_EVENT, BOOKING_STATUSES, MONEY, PAYMENT_STATUSES
from ..sources.tables import Tables
from ..session import cut_lineage
from .ids import max_id, next_ids
from .scan import fold_scan

N_STATES = 80
P_VALUES = (None,) + PAYMENT_STATUSES   # code 0 = no payment


def encode(b: Column, p: Column, a: Column, i: Column) -> Column:
    return (((b * 5 + p) * 2 + a) * 2 + i).cast("int")


def decode(s: Column) -> tuple[Column, Column, Column, Column]:
    s = s.cast("int")
    return (F.floor(s / 20).cast("int"), (F.floor(s / 4) % 5).cast("int"),
            (F.floor(s / 2) % 2).cast("int"), (s % 2).cast("int"))


def _b(name: str) -> int:
    return BOOKING_STATUSES.index(name)


def _p(name: str | None) -> int:
    return P_VALUES.index(name)


def outcome_of(s: Column, e: Column) -> Column:
    """The outcome of event ``e`` (struct) in state ``s``."""
    b, p, _, _ = decode(s)
    act, exists, owner = e["action"], e["exists"], e["is_owner"]
    canc, used, conf = b == _b("Cancelled"), b == _b("Used"), b == _b("Confirmed")
    ns = e["new_status"]

    def chain(*checks: tuple[Column, str]) -> Column:
        out = None
        for cond, name in checks:
            out = F.when(cond, name) if out is None else out.when(cond, name)
        return out.otherwise("ok")

    return (F.when(~e["valid"], "invalid_state")
            .when(act == "cancel", chain((~exists, "not_found"), (~owner, "unauthorized"),
                                         (canc, "already_cancelled"), (used, "already_used")))
            .when(act == "pay", chain((~exists | ~e["show_ok"], "not_found"),
                                      (~owner, "unauthorized"), (canc, "cancelled_booking"),
                                      (p == _p("Confirmed"), "already_paid"),
                                      (~e["fits"], "amount_too_large")))
            .when(act == "create_payment", chain((~exists, "not_found"), (~owner, "unauthorized"),
                                                 (p != _p(None), "payment_exists"),
                                                 (~e["show_ok"] | ~e["has_seats"], "no_seats"),
                                                 (~e["fits"], "amount_too_large")))
            .when(act == "use", chain((~exists, "not_found"), (canc, "cancelled_booking"),
                                      (used, "already_used")))
            .when(act == "checkin", chain((~exists, "not_found"), (canc, "cancelled_booking"),
                                          (used, "already_used"), (~conf, "not_confirmed")))
            .when(act == "set_status", chain(
                (ns.isNull() | (ns == ""), "status_required"),
                (~ns.isin(*BOOKING_STATUSES), "invalid_status"), (~exists, "not_found")))
            .when(act == "refund", chain((p == _p(None), "payment_not_found"),
                                         (p == _p("Refunded"), "already_refunded"),
                                         (p != _p("Confirmed"), "not_confirmed"),
                                         (~exists, "not_found"), (used, "used_booking")))
            .otherwise("invalid_action"))


def next_state(s: Column, e: Column) -> Column:
    b, p, a, i = decode(s)
    act = e["action"]
    new_b = (F.when(act == "cancel", _b("Cancelled"))
             .when(act.isin("pay", "create_payment"), _b("Confirmed"))
             .when(act.isin("use", "checkin"), _b("Used"))
             .when(act == "set_status", F.array_position(
                 F.array(*[F.lit(x) for x in BOOKING_STATUSES]), e["new_status"]) - 1)
             .when(act == "refund", _b("Cancelled")))
    new_p = (F.when(act == "pay", _p("Confirmed"))
             .when(act == "create_payment", _p("Pending"))
             .when(act == "refund", _p("Refunded"))
             .otherwise(p))
    new_a = F.when(act.isin("pay", "create_payment"), 1).otherwise(a)
    new_i = F.when((act == "pay") & (p == _p(None)), 1).when(act == "create_payment", 1).otherwise(i)
    changed = encode(F.coalesce(new_b, b).cast("int"), new_p, new_a, new_i)
    return F.when(outcome_of(s, e) == "ok", changed).otherwise(s)


def apply_booking_events(t: Tables, events: DataFrame,
                         width: int = 1024) -> tuple[Tables, DataFrame]:
    """Apply a batch of events. Returns the next snapshot and per-event outcomes
    ``booking_id, seq, action, outcome``."""
    ev = events.select(*[F.col(f.name).try_cast(f.dataType) for f in BOOKING_EVENT.fields])
    incomplete = F.col("booking_id").isNull() | F.col("seq").isNull()
    given = ev.where(~incomplete)
    again = given.groupBy("booking_id", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refused = ev.where(incomplete).select("booking_id", "seq", "action", F.lit("missing_fields").alias("outcome")).unionByName(
        given.join(again, ["booking_id", "seq"], "left_semi").select(
            "booking_id", "seq", "action", F.lit("duplicate_event").alias("outcome")))
    ev = given.join(again, ["booking_id", "seq"], "left_anti")
    keys = ev.select("booking_id").distinct()
    seats = t.booking_seat.join(keys, "booking_id", "left_semi").groupBy("booking_id").agg(F.count("seat_number").alias("n_seats"))
    bk = (t.booking.select("booking_id", "user_id", "status", "showtime_id")
          .join(t.showtime.select("showtime_id", "price"), "showtime_id", "left")
          .join(seats, "booking_id", "left")
          .select("booking_id", F.col("user_id").alias("owner"),
                  F.col("status").alias("b0"), "price",
                  F.coalesce("n_seats", F.lit(0)).alias("n_seats"),
                  F.lit(True).alias("_exists")))
    # the payment a single-row fetch reads: lowest payment_id of the booking
    pay = (t.payment.join(keys, "booking_id", "left_semi").groupBy("booking_id")
           .agg(F.min_by(F.struct("payment_id", "status"), F.col("payment_id")).alias("pay"))
           .select("booking_id", F.col("pay.payment_id").alias("payment_id"),
                   F.col("pay.status").alias("p0")))
    ctx = cut_lineage(keys.join(bk, "booking_id", "left").join(pay, "booking_id", "left")
                     .select("booking_id", "owner", "b0", "price", "n_seats", "payment_id", "p0",
                             F.coalesce("_exists", F.lit(False)).alias("exists")))
    b0 = F.array_position(F.array(*[F.lit(x) for x in BOOKING_STATUSES]), F.col("b0")) - 1
    p0 = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in PAYMENT_STATUSES]), F.col("p0")),
                    F.lit(0))
    valid = ~F.col("exists") | (b0 >= 0)
    amount = (F.col("n_seats") * F.col("price")).try_cast(MONEY)
    start = ctx.select("booking_id",
                           encode(F.greatest(b0, F.lit(0)), p0, F.lit(0), F.lit(0)).alias("s"))
    rows = (ev.join(ctx, "booking_id", "left")
            .select("booking_id", "seq", "action", "at", "new_status", "exists",
                    valid.alias("valid"),
                    F.coalesce(F.col("actor_id") == F.col("owner"), F.lit(False)).alias("is_owner"),
                    F.col("price").isNotNull().alias("show_ok"),
                    (F.col("n_seats") > 0).alias("has_seats"),
                    amount.isNotNull().alias("fits")))
    fields = ["action", "at", "new_status", "exists", "valid", "is_owner", "show_ok", "has_seats", "fits"]
    # cut once: outcomes, bookings and payments all read it
    scanned = cut_lineage(fold_scan(rows, "booking_id", "seq", fields, start, next_state, N_STATES, width))

    out_col = outcome_of(F.col("state_before"), F.struct(*[F.col(c) for c in fields]))
    outcomes = scanned.select("booking_id", "seq", "action", out_col.alias("outcome")).unionByName(refused)

    last = (scanned.groupBy("booking_id")
            .agg(F.max_by("state_after", "seq").alias("s_end"),
                 F.bool_or((F.col("action") == "refund") & (out_col == "ok")).alias("refunded"),
                 F.max_by(F.struct("seq", "at"),
                          F.when(decode(F.col("state_after"))[3] > decode(F.col("state_before"))[3],
                                 F.col("seq"))).alias("ins")))
    final = last.join(ctx, "booking_id").where(F.col("exists") | F.col("payment_id").isNotNull())
    fb, fp, fa, fi = decode(F.col("s_end"))
    new_amount = amount
    statuses = F.array(*[F.lit(x) for x in BOOKING_STATUSES])
    pstatuses = F.array(F.lit(None).cast("string"), *[F.lit(x) for x in PAYMENT_STATUSES])

    changed_b = final.where(F.col("exists") & valid).select(
        "booking_id", F.element_at(statuses, fb + 1).alias("_status"))
    booking = (t.booking.join(changed_b, "booking_id", "left")
               .withColumn("status", F.coalesce("_status", "status")).drop("_status"))

    upd = final.where((fi == 0) & F.col("payment_id").isNotNull()).select(
        "booking_id", F.col("payment_id").alias("_first"), F.col("refunded").alias("_refunded"), F.element_at(pstatuses, fp + 1).alias("_st"),
        F.when(fa == 1, new_amount).alias("_amt"))
    is_first = F.col("payment_id") == F.col("_first")
    payment = (t.payment.join(upd, "booking_id", "left")
               .withColumn("status", F.when(is_first, F.col("_st"))
                           .when(F.col("_refunded"), "Refunded").otherwise(F.col("status")))
               .withColumn("amount", F.when(is_first, F.coalesce("_amt", "amount")).otherwise(F.col("amount")))
               .select(*t.payment.columns))
    inserts = final.where(fi == 1).select(
        "booking_id", F.col("ins.seq").alias("ins_seq"), F.coalesce("ins.at", F.localtimestamp()).alias("payment_date"),
        new_amount.alias("amount"), F.element_at(pstatuses, fp + 1).alias("status"))
    new_rows = next_ids(inserts, ["ins_seq"], max_id(t.payment, "payment_id"), "payment_id")
    payment = payment.unionByName(new_rows.select("payment_id", "booking_id", "amount", "status",
                                                   "payment_date"))
    return t.with_(booking=booking, payment=payment), outcomes
