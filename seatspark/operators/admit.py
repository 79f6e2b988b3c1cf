"""M1: admit many booking requests at once, with no double booking.

Sequential meaning (one request at a time, in ``request_id`` order): a request
is refused with the first failing check, in this order

    missing_fields, empty_seats, showtime_not_found, seat_not_found,
    already_booked, unknown_user, duplicate_seat

and otherwise accepted, taking its seats. A refused request takes nothing.
``already_booked`` means some seat already has a Booking_Seat row in that
showtime (whatever the booking's status) or was taken by an earlier accepted
request of the batch.

Distributed plan:

1. Row-local checks. The showtime (theater) and user lookups are joins; each
   theater's seats are one small map row (lower-case seat -> stored spelling),
   so seat existence and repeated seats are array expressions, no explode.
   Existing holds are one bit mask per showtime, gathered with a partial
   aggregate. Seat lists join last, so rows that carry one cross no shuffle.
2. The order-dependent part is a fold per showtime. A request's seats are bit
   positions in its theater's sorted seat list; a fold over the showtime's
   requests in order keeps the mask of seats taken, and a request is accepted
   if its mask and that one share no bit. A fold takes the ``width`` lowest
   requests of a showtime (the row limit works map-side, so a showtime with a
   third of all requests sends ``width`` rows a map task). What is left of
   larger showtimes is first thinned by the mask, in parallel: requests that
   want a taken seat are refused. Only survivors take part in the next fold,
   which starts from that mask. Every fold but a showtime's last one settles
   ``width`` requests that could still get seats, so few folds are needed, and
   all sizes have the one-by-one result.
3. Requests that pass the checks but cannot take seats (unknown user, a seat
   repeated in the list) are refused as already_booked if an earlier accepted
   request holds one of their seats, else with their own reason: one join.
4. Accepted requests get booking ids max+1.. in request order (M4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BOOKING_REQUEST
from ..session import cut_lineage
from ..sources.tables import Tables
from .ids import max_id, next_ids

# Fixed outcome names, in check order.
OUTCOMES = ("duplicate_request", "missing_fields", "empty_seats", "showtime_not_found", "seat_not_found",
            "already_booked", "unknown_user", "duplicate_seat", "accepted")


#: Requests of a showtime that one fold takes.
WIDTH = 4096


def theater_seat_maps(t: Tables) -> DataFrame:
    """theater_id, map(lower(seat_number) -> seat_number), sorted lower-case seats; one small row per theater."""
    spelled = (t.seat.where(F.col("seat_number").isNotNull())
               .groupBy("theater_id", F.lower("seat_number").alias("k")).agg(F.min("seat_number").alias("seat_number")))
    return (spelled.groupBy("theater_id").agg(F.array_sort(F.collect_list(F.struct("k", "seat_number"))).alias("_s"))
            .select("theater_id", F.map_from_entries("_s").alias("seat_map"), F.col("_s.k").alias("seat_keys")))


def seat_mask(keys: Column, seat_keys: Column) -> Column:
    """The seats ``keys`` as bits of 64-bit words, by their places in the theater's ``seat_keys``."""
    places = F.transform(keys, lambda k: F.array_position(seat_keys, k) - 1)
    words = F.sequence(F.lit(0).cast("long"), F.floor((F.size(seat_keys) - 1) / 64))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))
    return F.transform(words, lambda w: F.aggregate(
        places, F.lit(0).cast("long"),
        lambda acc, p: F.when(F.floor(p / 64) == w, acc.bitwiseOR(bit(p))).otherwise(acc)))


def holds_by_showtime(t: Tables, requests: DataFrame, seat_maps: DataFrame) -> DataFrame:
    """The batch's showtimes: showtime_id, theater_id and the mask of the seats with any Booking_Seat row there."""
    wanted = requests.select("showtime_id").distinct()
    held = (t.booking_seat.join(wanted, "showtime_id", "left_semi")
            .groupBy("showtime_id")
            .agg(F.collect_set(F.lower("seat_number")).alias("held")))
    # a held seat that the theater has not is no bit: a request for it is seat_not_found before
    return (t.showtime.select("showtime_id", "theater_id").join(wanted, "showtime_id", "left_semi")
            .join(held, "showtime_id", "left").join(seat_maps.select("theater_id", "seat_keys"), "theater_id", "left")
            .select("showtime_id", "theater_id", F.lit(True).alias("_show"),
                    seat_mask(F.col("held"), F.col("seat_keys")).alias("held")))


def _checked(t: Tables, requests: DataFrame) -> DataFrame:
    # seat lists join last, from a table of known size: rows with a list cross no shuffle
    seat_maps = cut_lineage(theater_seat_maps(t))
    users = t.users.select("user_id", F.lit(True).alias("_user")).distinct()
    r = (requests.join(users, "user_id", "left")
         # stored, so that gathering the holds and sorting the requests do not add up in one task
         .join(cut_lineage(holds_by_showtime(t, requests, seat_maps)), "showtime_id", "left")
         .join(seat_maps, "theater_id", "left"))
    seats = F.col("seats")
    seat_map = F.coalesce(F.col("seat_map"), F.create_map().cast("map<string,string>"))
    unknown_seat = F.exists(seats, lambda s: s.isNull() | ~F.map_contains_key(seat_map, F.lower(s)))
    keys = F.transform(seats, lambda s: F.lower(s))
    outcome = (F.when(F.col("user_id").isNull() | F.col("showtime_id").isNull() | seats.isNull(),
                      "missing_fields")
               .when(F.size(seats) == 0, "empty_seats")
               .when(F.col("_show").isNull(), "showtime_not_found")
               .when(unknown_seat, "seat_not_found"))
    r = r.select(
        "request_id", "user_id", "showtime_id", "theater_id", "requested_at", "held",
        outcome.alias("pre"),
        # a request that cannot insert its rows: FK on user, or PK on a repeated seat
        F.when(F.col("_user").isNull(), "unknown_user")
         .when(F.size(F.array_distinct(keys)) < F.size(seats), "duplicate_seat").alias("blocker"),
        keys.alias("keys"),
        F.when(outcome.isNull(), seat_mask(keys, F.col("seat_keys"))).alias("mask"),
        F.transform(seats, lambda s: F.element_at(seat_map, F.lower(s))).alias("stored_seats"))
    return r.withColumn("pre", F.when(_shares(F.col("mask"), F.col("held")), "already_booked")
                        .otherwise(F.col("pre"))).drop("held")


def _claims(df: DataFrame) -> DataFrame:
    return df.select("request_id", "showtime_id", F.explode(F.array_distinct("keys")).alias("key"))


def _shares(mask: Column, taken: Column) -> Column:
    return F.exists(F.zip_with(mask, taken, lambda a, b: a.bitwiseAND(b)), lambda w: w != 0)


def first_come(claims: DataFrame, width: int = WIDTH) -> DataFrame:
    """request_ids accepted when ``claims`` (request_id, showtime_id, mask) are served one by one, in request order.

    request_ids are unique, masks of one showtime have equal lengths. A fold
    holds ``width`` requests of a showtime at most; see the module text.
    """
    accepted: list[DataFrame] = []
    rest, state = claims.select("request_id", "showtime_id", "mask"), None
    while True:
        order = Window.partitionBy("showtime_id").orderBy("request_id")
        groups = (rest.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= width)
                  .groupBy("showtime_id")
                  .agg(F.array_sort(F.collect_list(F.struct("request_id", "mask"))).alias("asked")))
        free = F.transform(F.element_at("asked", 1)["mask"], lambda w: F.lit(0).cast("long"))
        if state is not None:
            groups, free = groups.join(state.select("showtime_id", "taken"), "showtime_id"), F.col("taken")
        start = F.struct(free.alias("taken"), F.array().cast("array<bigint>").alias("won"))
        folded = F.aggregate("asked", start, lambda acc, r: F.when(
            _shares(r["mask"], acc["taken"]), acc).otherwise(F.struct(
                F.zip_with(r["mask"], acc["taken"], lambda a, b: a.bitwiseOR(b)).alias("taken"),
                F.array_append(acc["won"], r["request_id"]).alias("won"))))
        state = cut_lineage(groups.select("showtime_id", F.element_at("asked", -1)["request_id"].alias("cut"),
                                          F.size("asked").alias("n"), folded.alias("x"))
                            .select("showtime_id", "cut", "n", "x.taken", "x.won"))
        accepted.append(state.select(F.explode("won").alias("request_id")))
        full = state.where(F.col("n") == width).select("showtime_id", "cut", "taken")
        if full.isEmpty():
            break
        rest = cut_lineage(rest.join(full, "showtime_id")
                           .where((F.col("request_id") > F.col("cut")) & ~_shares(F.col("mask"), F.col("taken")))
                           .select("request_id", "showtime_id", "mask"))
        if rest.isEmpty():
            break
    out = accepted[0]
    for more in accepted[1:]:
        out = out.unionByName(more)
    return out


def usable_ids(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose request_id is given once, and the outcomes of all others.

    Without an id a request has no place in the order (missing_fields); rows
    that share one have no order among themselves (duplicate_request).
    """
    given = requests.where(F.col("request_id").isNotNull())
    # stored, so that the joins know that it is small: no shuffle of the requests then
    repeated = cut_lineage(given.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("request_id"))
    refused = requests.where(F.col("request_id").isNull()).select(
        "request_id", F.lit("missing_fields").alias("outcome")).unionByName(
        given.join(repeated, "request_id", "left_semi").select(
            "request_id", F.lit("duplicate_request").alias("outcome")))
    return given.join(repeated, "request_id", "left_anti"), refused


def admitted(t: Tables, requests: DataFrame, as_of: Column | None = None,
             width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Admit a batch of booking requests: the rows that it adds, and what became of each request.

    Returns the new rows of booking, those of booking_seat, and the outcomes
    ``request_id, outcome, booking_id`` (booking_id only if accepted).
    Accepted bookings are Pending, dated ``requested_at`` (else ``as_of``,
    else the current timestamp). ``width`` bounds the requests of a showtime
    that one task holds; it does not change the result.
    """
    # stored once: reading or deriving the requests may cost more than what follows
    req, refused = usable_ids(cut_lineage(requests.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in BOOKING_REQUEST.fields])))
    checked = cut_lineage(_checked(t, req))
    open_ = checked.where(F.col("pre").isNull())
    takers = open_.where(F.col("blocker").isNull())
    blocked = open_.where(F.col("blocker").isNotNull())

    won = first_come(takers, width)
    taker_outcomes = (takers.select("request_id").join(won.withColumn("_won", F.lit(True)), "request_id", "left")
                      .select("request_id", F.when(F.col("_won"), "accepted").otherwise("already_booked").alias("outcome")))
    accepted_claims = _claims(takers.join(won, "request_id", "left_semi"))

    # blocked requests: already_booked if an earlier accepted request holds a seat
    earlier = (_claims(blocked)
               .join(accepted_claims.withColumnRenamed("request_id", "holder"),
                     ["showtime_id", "key"])
               .where(F.col("holder") < F.col("request_id"))
               .select("request_id").distinct().withColumn("_taken", F.lit(True)))
    blocked_outcomes = (blocked.join(earlier, "request_id", "left")
                        .select("request_id",
                                F.when(F.col("_taken"), "already_booked")
                                 .otherwise(F.col("blocker")).alias("outcome")))

    decided = (checked.where(F.col("pre").isNotNull())
               .select("request_id", F.col("pre").alias("outcome"))
               .unionByName(taker_outcomes).unionByName(blocked_outcomes).unionByName(refused))

    accepted = (checked.select("request_id", "user_id", "showtime_id", "theater_id", "requested_at", "stored_seats")
                .join(won, "request_id", "left_semi"))
    with_ids = next_ids(accepted, ["request_id"], max_id(t.booking, "booking_id"), "booking_id")
    when = F.coalesce(F.col("requested_at"), as_of if as_of is not None
                      else F.localtimestamp())
    new_booking = with_ids.select("booking_id", "user_id", "showtime_id",
                                  F.lit("Pending").alias("status"),
                                  when.cast("timestamp_ntz").alias("booking_date"))
    new_seats = with_ids.select("booking_id", F.explode("stored_seats").alias("seat_number"),
                                "theater_id", "showtime_id")
    outcomes = (decided.join(with_ids.select("request_id", "booking_id"), "request_id", "left")
                .select("request_id", "outcome", "booking_id"))
    return new_booking, new_seats, outcomes


def admit_bookings(t: Tables, requests: DataFrame, as_of: Column | None = None,
                   width: int = WIDTH) -> tuple[Tables, DataFrame]:
    """The next snapshot (booking and booking_seat extended) and the outcomes of :func:`admitted`."""
    new_booking, new_seats, outcomes = admitted(t, requests, as_of, width)
    return t.with_(booking=t.booking.unionByName(new_booking),
                   booking_seat=t.booking_seat.unionByName(new_seats)), outcomes
