"""Price of a hotel stay per room."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def room_cost(
    room: Column,
    base_price: Column,
    standard: Column,
    adults: Column,
    check_in: Column,
    check_out: Column,
    fixed: bool = False,
) -> Column:
    """Cost of a stay; NULL where there is no stay.

    Rooms x01-x04 charge 10 and rooms 401-402 charge 20 per adult above the standard, rooms
    x05-x08 charge no extra. The written rule multiplies only the surcharge by the nights when
    there are extra adults; `fixed=True` multiplies the base price too.
    """
    nights = F.datediff(check_out, check_in)
    plain = base_price * nights

    def extra(fee):
        surcharge = (adults - standard) * fee * nights
        return plain + surcharge if fixed else base_price + surcharge

    family = room.between(201, 204) | room.between(301, 304)
    single = room.between(205, 208) | room.between(305, 308)
    suite = room.between(401, 402)
    return (
        F.when(family & (adults <= 2), plain)
        .when(family & (adults > 2), extra(10))
        .when(single, plain)
        .when(suite & (adults <= 3), plain)
        .when(suite & (adults > 3), extra(20))
    )
