"""Reports over a hotel (room, guest, reservation, guestreservation, roomreservation) and over a
table of hotel bookings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.operators.hotel import room_cost as cost_of
from lakemill.operators.joins import keep_all
from lakemill.operators.relational import on_days, row_count

C = F.col


def stays(t) -> DataFrame:
    """Reservations with their guest and room."""
    return (
        t.reservation.join(t.guestreservation, "reservationid")
        .join(t.guest, "guestid")
        .join(t.roomreservation, "reservationid")
        .join(t.room, "roomnumber")
    )


SHOWN = ("firstname", "lastname", "roomnumber", "checkindate", "checkoutdate")


def ending_in(t, first: str, last: str) -> DataFrame:
    return stays(t).filter(on_days("checkoutdate", first, last)).select(*SHOWN)


def with_jacuzzi(t) -> DataFrame:
    return stays(t).filter(C("hasjacuzzi") == 1).select(*SHOWN)


def guest_rooms(t, guest_id: int) -> DataFrame:
    return stays(t).filter(C("guestid") == guest_id).select(
        *SHOWN, (C("adults") + C("children")).alias("totalpeople")
    )


def room_cost(t, fixed: bool = False) -> DataFrame:
    """Every room with the cost of each stay, NULL without a stay."""
    booked = t.roomreservation.select(
        C("roomnumber").alias("booked_room"), "reservationid"
    ).join(t.reservation, "reservationid")
    rows = keep_all(t.room, booked, ["roomnumber"], ["booked_room"])
    cost = cost_of(
        C("roomnumber"), C("baseprice"), C("standardoccupancy"), C("adults"), C("checkindate"),
        C("checkoutdate"), fixed,
    )
    return rows.select("roomnumber", "reservationid", cost.alias("total"))


def large_parties(t, first: str, last: str, people: int = 2) -> DataFrame:
    """Rooms of stays with more people that begin or end in the range."""
    near = on_days("checkindate", first, last) | on_days("checkoutdate", first, last)
    return (
        t.reservation.filter((C("adults") + C("children") > people) & near)
        .join(t.roomreservation, "reservationid")
        .join(t.room, "roomnumber")
        .select("roomnumber")
    )


def reservations_per_guest(t) -> DataFrame:
    counts = (
        t.guestreservation.join(t.reservation, "reservationid", "left_semi")
        .groupBy("guestid")
        .agg(row_count().alias("totalreservations"))
    )
    return (
        counts.join(t.guest, "guestid")
        .orderBy(F.desc("totalreservations"), "lastname", "guestid")
        .select("firstname", "lastname", "totalreservations")
    )


def guests_by_phone(t, text: str) -> DataFrame:
    return t.guest.filter(C("phone").contains(text))


def booking_counts(bookings: DataFrame, column: str) -> DataFrame:
    """Bookings per value of a column, most first: month, hotel, room type or market segment."""
    return (
        bookings.groupBy(column).agg(row_count().alias("count")).orderBy(F.desc("count"), column)
    )


def night_totals(bookings: DataFrame) -> DataFrame:
    return (
        bookings.groupBy("hotel")
        .agg(
            F.sum("stays_in_week_nights").alias("week_nights"),
            F.sum("stays_in_weekend_nights").alias("weekend_nights"),
        )
        .orderBy(F.desc("hotel"))
    )


def family_stays(bookings: DataFrame) -> DataFrame:
    return (
        bookings.filter("children > 0 OR babies > 0")
        .groupBy("children", "babies")
        .agg(row_count().alias("stays_with_children_babies"))
        .orderBy(F.desc("stays_with_children_babies"), "children", "babies")
    )
