"""Records as bytes from columns, by native expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import CELL_BLOCKS
from .binary import checksum16, encode_u8, encode_u16, let


def fill(first: Column, n: int) -> Column:
    """n bytes that count up from `first`, modulo 256."""
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex((first + i) % 256), 2, "0")), ""))


def variable_leader(number: Column, clock: Column) -> Column:
    """21 bytes; clock: seven bytes."""
    return F.concat(F.unhex(F.lit("8000")), encode_u16(number.bitwiseAND(65535)), clock, encode_u8(F.shiftright(number, 16)), F.unhex(F.lit("00" * 9)))


def clock_bytes(stamp: Column) -> Column:
    """Seven clock bytes of a timestamp_ntz from 2000 to 2050."""
    hundredths = F.floor((F.extract(F.lit("SECOND"), stamp) * 100) % 100)
    parts = [F.year(stamp) - 2000, F.month(stamp), F.dayofmonth(stamp), F.hour(stamp), F.minute(stamp), F.second(stamp), hundredths]
    return F.concat(*[encode_u8(p.cast("int")) for p in parts])


def assemble(blocks: list[tuple[Column, int]]) -> Column:
    """A record of blocks, each with its length in bytes; the header, offsets and checksum follow from them."""
    starts, at = [], 6 + 2 * len(blocks)
    for _, n in blocks:
        starts.append(at)
        at += n
    head = "7f7f" + at.to_bytes(2, "little").hex() + f"00{len(blocks):02x}" + "".join(s.to_bytes(2, "little").hex() for s in starts)
    body = F.concat(F.unhex(F.lit(head)), *[b for b, _ in blocks])
    return let(body, lambda b: F.concat(b, let(checksum16(b), encode_u16)))


def profile_record(number: Column, clock: Column, seed: Column, cells: int = 4, beams: int = 4, cell_cm: int = 800) -> Column:
    """A standard profile: leaders, the four blocks of cells, and bottom track."""
    fixed = bytearray(40)
    fixed[8:10], fixed[12:14] = bytes([beams, cells]), cell_cm.to_bytes(2, "little")
    blocks = [(F.unhex(F.lit(bytes(fixed).hex())), 40), (variable_leader(number, clock), 21)]
    for k, (ident, (_, width)) in enumerate(CELL_BLOCKS.items()):
        n = cells * beams * width
        blocks.append((F.concat(F.unhex(F.lit(ident)), fill(seed + 20 * k, n)), 2 + n))
    return assemble([*blocks, (F.concat(F.unhex(F.lit("0006")), fill(seed, 68)), 70)])


def plain_record(number: Column, clock: Column, fixed: Column, payload: Column) -> Column:
    """Leaders and one opaque block of six bytes: 83 bytes. fixed: the byte that fills the fixed leader."""
    leader = F.concat(F.unhex(F.lit("0000")), F.unhex(F.repeat(F.lpad(F.hex(fixed), 2, "0"), 38)))
    return assemble([(leader, 40), (variable_leader(number, clock), 21), (F.concat(F.unhex(F.lit("0100")), payload), 8)])
