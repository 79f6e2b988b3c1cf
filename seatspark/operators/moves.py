"""M3: move open bookings to other seats and/or another showtime, many at once.

Checks per move, in order (first failure wins):

    nothing_to_update, not_found, unauthorized, closed_booking (Cancelled/Used),
    seats_required (new showtime without seats), showtime_not_found,
    empty_seats, seat_not_found (not in the target theater),
    already_booked (held by another booking, or won by an earlier move),
    duplicate_seat (a seat repeated in the list: the insert would break the key)

On success the booking's held seats are replaced by the new ones, its showtime
changes, and an existing payment's amount becomes seats x the seats' showtime
price, whatever the payment's status.

Batch rule (a move touches two showtimes, so it cannot be split by showtime
the way admission is): seats held before the batch stay blocked for the whole
batch, even if a move of the batch gives them up; between moves of the batch,
the earliest request that can take all its seats gets them (the claim rounds
of admission); a booking gets at most one move per batch (later ones:
duplicate_move).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import BOOKING_MOVE, MONEY
from ..session import cut_lineage
from ..sources.tables import Tables
from .admit import _claims, first_come, seat_mask, theater_seat_maps, usable_ids


def reassign_bookings(t: Tables, moves: DataFrame) -> tuple[Tables, DataFrame]:
    mv, refused = usable_ids(moves.select(*[F.col(f.name).try_cast(f.dataType) for f in BOOKING_MOVE.fields]))
    first = mv.groupBy("booking_id").agg(F.min("request_id").alias("_first"))
    bk = t.booking.select("booking_id", F.col("user_id").alias("owner"),
                          F.col("status").alias("b_status"),
                          F.col("showtime_id").alias("cur_show"), F.lit(True).alias("_found"))
    st = t.showtime.select(F.col("showtime_id").alias("_sid"), F.col("theater_id").alias("_tid"),
                           F.col("price").alias("_price"))
    # a payment takes the new seats' price: too much for its column fails the move as a whole
    pays = t.payment.select("booking_id", F.lit(True).alias("_pays")).distinct()
    kept = t.booking_seat.groupBy("booking_id").agg(F.count("seat_number").alias("_kept"))
    # what a booking has joins first (one shuffle by booking), seat lists last, from a table of
    # known size: rows with a list cross no shuffle
    r = (mv.join(first, "booking_id", "left").join(bk, "booking_id", "left")
         .join(pays, "booking_id", "left").join(kept, "booking_id", "left")
         .withColumn("target", F.coalesce("showtime_id", "cur_show"))
         .join(st, F.col("target") == F.col("_sid"), "left")
         .join(cut_lineage(theater_seat_maps(t)), F.col("_tid") == F.col("theater_id"), "left")
         .withColumn("_amount", (F.coalesce(F.when(F.col("seats").isNotNull(), F.size("seats").cast("long")), "_kept", F.lit(0))
                                  * F.col("_price")).try_cast(MONEY)))
    seats = F.col("seats")
    seat_map = F.coalesce(F.col("seat_map"), F.create_map().cast("map<string,string>"))
    keys = F.transform(seats, lambda s: F.lower(s))
    pre = (F.when(F.col("showtime_id").isNull() & seats.isNull(), "nothing_to_update")
           .when(F.col("request_id") != F.col("_first"), "duplicate_move")
           .when(F.col("_found").isNull(), "not_found")
           .when(~F.coalesce(F.col("actor_id") == F.col("owner"), F.lit(False)), "unauthorized")
           .when(F.col("b_status").isin("Cancelled", "Used"), "closed_booking")
           .when(F.col("showtime_id").isNotNull() & (F.col("showtime_id") != F.col("cur_show"))
                 & seats.isNull(), "seats_required")
           .when(F.col("_sid").isNull(), "showtime_not_found")
           .when(seats.isNotNull() & (F.size(seats) == 0), "empty_seats")
           .when(seats.isNotNull() & F.exists(seats, lambda s: s.isNull()
                                              | ~F.map_contains_key(seat_map, F.lower(s))),
                 "seat_not_found"))
    checked = cut_lineage(r.select(
        "request_id", "booking_id", F.col("_tid").alias("target_theater"), keys.alias("keys"),
        F.transform(seats, lambda s: F.element_at(seat_map, F.lower(s))).alias("stored_seats"),
        F.col("target").alias("showtime_id"), pre.alias("pre"),
        F.when(pre.isNull() & seats.isNotNull(), seat_mask(keys, F.col("seat_keys"))).alias("mask"),
        F.when(F.size(F.array_distinct(keys)) < F.size(seats), "duplicate_seat")
         .when(F.col("_pays").isNotNull() & F.col("_amount").isNull(), "amount_too_large").alias("blocker")))

    # seats held in the target showtime by other bookings (any status)
    others = t.booking_seat.select("showtime_id", F.lower("seat_number").alias("key"), F.col("booking_id").alias("_hb"))
    asked = checked.select("request_id", "booking_id", "showtime_id", F.explode(F.array_distinct("keys")).alias("key"))
    held = (asked.join(others, (asked["showtime_id"] == others["showtime_id"]) & (asked["key"] == others["key"])
                       & (F.col("_hb") != F.col("booking_id")), "left_semi")
            .select("request_id").distinct().withColumn("_held", F.lit(True)))
    settled = checked.where(F.col("pre").isNotNull()).select("request_id", F.col("pre").alias("outcome"))
    clear = cut_lineage(checked.where(F.col("pre").isNull())
                        .select("request_id", "booking_id", "showtime_id", "keys", "mask", "blocker")
                        .join(held, "request_id", "left"))
    open_ = clear.where(F.col("_held").isNull())
    with_seats = open_.where(F.col("keys").isNotNull() & F.col("blocker").isNull())
    blocked = open_.where(F.col("keys").isNotNull() & F.col("blocker").isNotNull())
    first_ids = first_come(with_seats)
    seat_outcomes = (with_seats.select("request_id").join(first_ids.withColumn("_won", F.lit(True)), "request_id", "left")
                     .select("request_id", F.when(F.col("_won"), "moved").otherwise("already_booked").alias("outcome")))
    won = _claims(with_seats.join(first_ids, "request_id", "left_semi"))
    earlier = (_claims(blocked).join(won.withColumnRenamed("request_id", "holder"),
                                     ["showtime_id", "key"])
               .where(F.col("holder") < F.col("request_id"))
               .select("request_id").distinct().withColumn("_taken", F.lit(True)))
    decided = cut_lineage(
        settled
        .unionByName(clear.where(F.col("_held").isNotNull()).select("request_id", F.lit("already_booked").alias("outcome")))
        .unionByName(seat_outcomes)
        .unionByName(blocked.join(earlier, "request_id", "left").select(
            "request_id", F.when(F.col("_taken"), "already_booked")
            .otherwise(F.col("blocker")).alias("outcome")))
        .unionByName(open_.where(F.col("keys").isNull())
                     .select("request_id", F.coalesce("blocker", F.lit("moved")).alias("outcome")))
        .unionByName(refused))
    done = cut_lineage(checked.select("request_id", "booking_id", F.col("showtime_id").alias("target"), "target_theater", "stored_seats")
                       .join(decided.where(F.col("outcome") == "moved"), "request_id", "left_semi"))

    reseated = done.where(F.col("stored_seats").isNotNull())
    new_rows = reseated.select("booking_id", F.explode("stored_seats").alias("seat_number"),
                               F.col("target_theater").alias("theater_id"),
                               F.col("target").alias("showtime_id"))
    left_alone = t.booking_seat.join(reseated.select("booking_id"), "booking_id", "left_anti")
    booking_seat = left_alone.unionByName(new_rows)
    booking = (t.booking.join(done.select("booking_id", F.col("target").alias("_new_show")),
                              "booking_id", "left")
               .withColumn("showtime_id", F.coalesce("_new_show", "showtime_id")).drop("_new_show"))

    # new amount: seats now held x price of their showtime (first showtime group)
    moved_ids = done.select("booking_id")
    held_now = (left_alone.join(moved_ids, "booking_id", "left_semi")
                .groupBy("booking_id", "showtime_id").agg(F.count("seat_number").alias("n"))
                .unionByName(reseated.select("booking_id", F.col("target").alias("showtime_id"),
                                             F.size(F.array_compact("stored_seats")).cast("long").alias("n")))
                .groupBy("booking_id", "showtime_id").agg(F.sum("n").alias("n"))
                .join(t.showtime.select("showtime_id", "price"), "showtime_id")
                .groupBy("booking_id")
                .agg(F.min_by((F.col("n") * F.col("price")).try_cast(MONEY), F.col("showtime_id"))
                     .alias("_amount")))
    # one payment of the booking changes, the lowest payment_id
    first = (t.payment.join(moved_ids, "booking_id", "left_semi")
             .groupBy("booking_id").agg(F.min("payment_id").alias("payment_id"))
             .join(held_now, "booking_id").select("payment_id", "_amount"))
    payment = (t.payment.join(first, "payment_id", "left")
               .withColumn("amount", F.coalesce("_amount", "amount")).drop("_amount"))
    payment = payment.select(*t.payment.columns)
    booking = booking.select(*t.booking.columns)
    return (t.with_(booking=booking, booking_seat=booking_seat, payment=payment),
            decided.select("request_id", "outcome"))
