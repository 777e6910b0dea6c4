"""Hotel reports against rows written down by hand."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lakemill.operators.changes import delete_cascade
from lakemill.plans import stays

# Rooms (number, standard occupancy, price, jacuzzi).
ROOMS = [
    (201, 2, 199.99, True), (202, 2, 174.99, False), (203, 2, 199.99, True),
    (204, 2, 174.99, False), (205, 2, 174.99, True), (206, 2, 149.99, False),
    (207, 2, 174.99, True), (208, 2, 149.99, False), (301, 2, 199.99, True),
    (302, 2, 174.99, False), (303, 2, 199.99, True), (304, 2, 174.99, False),
    (305, 2, 174.99, True), (306, 2, 149.99, False), (307, 2, 174.99, True),
    (308, 2, 149.99, False), (401, 3, 399.99, False), (402, 3, 399.99, False),
]
# Stays (id, guest, room, adults, children, in, out, stored total).
STAYS = [
    (1, 2, 308, 1, 0, "2023-02-02", "2023-02-04", 299.98),
    (2, 3, 203, 2, 1, "2023-02-05", "2023-02-10", 999.95),
    (3, 4, 305, 2, 0, "2023-02-22", "2023-02-24", 349.98),
    (4, 5, 201, 2, 2, "2023-03-06", "2023-03-07", 199.99),
    (5, 1, 307, 1, 1, "2023-03-17", "2023-03-20", 524.97),
    (6, 6, 302, 3, 0, "2023-03-18", "2023-03-23", 924.95),
    (7, 7, 202, 2, 2, "2023-03-29", "2023-03-31", 349.98),
    (8, 8, 304, 2, 0, "2023-03-31", "2023-04-05", 874.95),
    (9, 9, 301, 1, 0, "2023-04-09", "2023-04-13", 799.96),
    (10, 10, 207, 1, 1, "2023-04-23", "2023-04-24", 174.99),
    (11, 11, 401, 2, 4, "2023-05-30", "2023-06-02", 1199.97),
    (12, 12, 206, 2, 0, "2023-06-10", "2023-06-14", 599.96),
    (13, 12, 208, 1, 0, "2023-06-10", "2023-06-14", 599.96),
    (14, 6, 304, 3, 0, "2023-06-17", "2023-06-18", 184.99),
    (15, 1, 205, 2, 0, "2023-06-28", "2023-07-02", 699.96),
    (16, 9, 204, 3, 1, "2023-07-13", "2023-07-14", 184.99),
    (17, 10, 401, 4, 2, "2023-07-18", "2023-07-21", 1259.97),
    (18, 3, 303, 2, 1, "2023-07-28", "2023-07-29", 199.99),
    (19, 3, 305, 1, 0, "2023-08-30", "2023-09-01", 349.98),
    (20, 2, 208, 2, 0, "2023-09-16", "2023-09-17", 149.99),
    (21, 5, 203, 2, 2, "2023-09-13", "2023-09-15", 399.98),
    (22, 4, 401, 2, 2, "2023-11-22", "2023-11-25", 1199.97),
    (23, 2, 206, 2, 0, "2023-11-22", "2023-11-25", 449.97),
    (24, 2, 301, 2, 2, "2023-11-22", "2023-11-25", 599.97),
    (25, 11, 302, 2, 0, "2023-12-24", "2023-12-28", 699.96),
]
# Expected (room, stay, cost) with the surcharge rule as written.
COSTS = [
    (201, 4, 199.99), (202, 7, 349.98), (203, 2, 999.95), (203, 21, 399.98), (204, 16, 184.99),
    (205, 15, 699.96), (206, 12, 599.96), (206, 23, 449.97), (207, 10, 174.99), (208, 13, 599.96),
    (208, 20, 149.99), (301, 9, 799.96), (301, 24, 599.97), (302, 6, 224.99), (302, 25, 699.96),
    (303, 18, 199.99), (304, 14, 184.99), (305, 3, 349.98), (305, 19, 349.98), (306, None, None),
    (307, 5, 524.97), (308, 1, 299.98), (401, 11, 1199.97), (401, 17, 459.99), (401, 22, 1199.97),
    (402, None, None),
]




@pytest.fixture(scope="module")
def hotel(spark):
    """The hotel's tables; guest 8 and all that refers to that guest is deleted."""
    rooms = spark.createDataFrame(
        ROOMS, "roomnumber int, standardoccupancy int, price double, hasjacuzzi boolean"
    ).select(
        "roomnumber", "standardoccupancy", F.col("price").cast("decimal(10,2)").alias("baseprice"),
        F.col("hasjacuzzi").cast("int").alias("hasjacuzzi"),
    )
    rows = spark.createDataFrame(
        STAYS,
        "reservationid int, guestid int, roomnumber int, adults int, children int, cin string,"
        " cout string, total double",
    )
    stay = rows.select(
        "reservationid", "adults", "children",
        F.col("cin").cast("timestamp_ntz").alias("checkindate"),
        F.col("cout").cast("timestamp_ntz").alias("checkoutdate"),
        F.col("total").cast("decimal(10,2)").alias("total"),
    )
    guests = rows.select("guestid").distinct().select(
        "guestid",
        F.concat(F.lit("First"), "guestid").alias("firstname"),
        F.concat(F.lit("Last"), F.lpad(F.col("guestid").cast("string"), 2, "0")).alias("lastname"),
        F.format_string("(291) 55%02d", "guestid").alias("phone"),
    )
    link = rows.select(F.col("guestid").alias("g"), F.col("reservationid").alias("r"))
    placed = rows.select(F.col("roomnumber").alias("n"), F.col("reservationid").alias("p"))
    left = delete_cascade(
        {"guest": guests, "link": link, "stay": stay, "placed": placed},
        "guest",
        F.col("guestid") == 8,
        [
            ("link", "g", "guest", "guestid"), ("stay", "reservationid", "link", "r"),
            ("placed", "p", "stay", "reservationid"),
        ],
    )
    return SimpleNamespace(
        room=rooms,
        guest=left["guest"],
        reservation=left["stay"],
        guestreservation=left["link"].toDF("guestid", "reservationid"),
        roomreservation=left["placed"].toDF("roomnumber", "reservationid"),
    )


def test_room_cost_as_written(hotel):
    rows = stays.room_cost(hotel).withColumn("total", F.col("total").cast("double"))
    key = lambda r: (r[0], r[1] or 0)
    assert sorted((tuple(r) for r in rows.collect()), key=key) == sorted(COSTS, key=key)


def test_fixed_cost_is_the_stored_total(hotel):
    rows = stays.room_cost(hotel, fixed=True).filter("reservationid IS NOT NULL")
    stored = hotel.reservation.select("reservationid", F.col("total").alias("stored"))
    joined = rows.join(stored, "reservationid")
    assert joined.count() == 24
    assert joined.filter("total <> stored").count() == 0


def test_stays_ending_in_july(hotel):
    got = stays.ending_in(hotel, "2023-07-01", "2023-07-31").collect()
    assert {(r.firstname, r.roomnumber, r.checkindate.date()) for r in got} == {
        ("First1", 205, dt.date(2023, 6, 28)), ("First9", 204, dt.date(2023, 7, 13)),
        ("First10", 401, dt.date(2023, 7, 18)), ("First3", 303, dt.date(2023, 7, 28)),
    }


def test_jacuzzi(hotel):
    assert sorted(r.roomnumber for r in stays.with_jacuzzi(hotel).collect()) == [
        201, 203, 203, 205, 207, 301, 301, 303, 305, 305, 307
    ]


def test_guest_rooms(hotel):
    rows = stays.guest_rooms(hotel, 2).select("roomnumber", "totalpeople")
    assert sorted(tuple(r) for r in rows.collect()) == [(206, 2), (208, 2), (301, 4), (308, 1)]


def test_large_parties_in_april(hotel):
    assert stays.large_parties(hotel, "2023-04-01", "2023-04-30").count() == 0
    assert stays.large_parties(hotel, "2023-03-01", "2023-03-31").count() == 3


def test_reservations_per_guest(hotel):
    rows = [tuple(r) for r in stays.reservations_per_guest(hotel).collect()]
    assert [r[2] for r in rows] == [4, 3, 2, 2, 2, 2, 2, 2, 2, 2, 1]
    assert rows[0] == ("First2", "Last02", 4) and rows[-1] == ("First7", "Last07", 1)


def test_guest_by_phone(hotel):
    assert [r.guestid for r in stays.guests_by_phone(hotel, "(291) 5502").collect()] == [2]
