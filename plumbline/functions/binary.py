"""Bytes and little-endian integers as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` with a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), of)[0]


def byte_at(data: Column | str, at: int | Column) -> Column:
    """The unsigned byte at a place counted from 0, null beyond the end."""
    place = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(F.nullif(F.hex(F.substring(_column(data), place, F.lit(1))), F.lit("")), 16, 10).cast("int")


def u16(data: Column | str, at: int | Column) -> Column:
    low, high = byte_at(data, at), byte_at(data, at + 1)
    return low + high * 256


def u16_array(data: Column | str, at: int | Column, n: Column) -> Column:
    """n little-endian 16-bit integers from place `at`."""
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: u16(data, F.lit(at) + 2 * i))


def encode_u8(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.bitwiseAND(255)), 2, "0"))


def encode_u16(value: Column) -> Column:
    return F.concat(encode_u8(value), encode_u8(F.shiftright(value, 8)))


def checksum16(data: Column | str) -> Column:
    """Sum of all bytes modulo 65536. Native, seven bytes at a time; the scan uses numpy on the bytes that it holds
    anyway."""

    def seven(own: Column, i: Column) -> Column:
        value = F.conv(F.hex(F.substring(own, 7 * i + 1, F.lit(7))), 16, 10).cast("long")
        # bytes two by two in lanes of 16 bits
        lanes = let(value, lambda v: v.bitwiseAND(0x00FF00FF00FF00FF) + F.shiftright(v, 8).bitwiseAND(0x00FF00FF00FF00FF))
        return let(lanes, lambda s: sum((F.shiftright(s, 16 * k).bitwiseAND(0xFFFF) for k in range(1, 4)), s.bitwiseAND(0xFFFF)))

    def total(own: Column) -> Column:
        parts = F.ceil(F.length(own) / 7).cast("int")
        places = F.when(parts > 0, F.sequence(F.lit(0), parts - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.lit(0).cast("long"), lambda sum_, i: sum_ + seven(own, i)).bitwiseAND(65535).cast("int")

    return let(_column(data), total)


def counter24(lsb: Column, msb: Column) -> Column:
    return F.shiftleft(msb, 16).bitwiseOR(lsb)


def lower_hex(data: Column | str) -> Column:
    return F.lower(F.hex(_column(data)))
