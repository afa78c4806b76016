"""Records and files built byte by byte, independently of the library's own encoders."""

import struct
from datetime import datetime, timedelta

T0 = datetime(2024, 3, 1, 12, 0, 0)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def leader(number, clock):
    raw = clock if isinstance(clock, bytes) else bytes([clock.year - 2000, clock.month, clock.day, clock.hour, clock.minute, clock.second, clock.microsecond // 10_000])
    return b"\x80\x00" + struct.pack("<H", number & 0xFFFF) + raw + bytes([number >> 16]) + bytes(9)


def assemble(blocks):
    head = 6 + 2 * len(blocks)
    offsets, where = [], head
    for b in blocks:
        offsets.append(where)
        where += len(b)
    body = b"\x7f\x7f" + struct.pack("<H", where) + b"\x00" + bytes([len(blocks)]) + b"".join(struct.pack("<H", o) for o in offsets) + b"".join(blocks)
    return body + struct.pack("<H", sum(body) % 65536)


def record(number, clock, payload=b"\x01\x02\x03\x04\x05\x06", fixed=1):
    """The smallest layout: two leaders and one opaque block, 83 bytes."""
    return assemble([b"\x00\x00" + bytes((fixed + i) % 256 for i in range(2, 40)), leader(number, clock), b"\x01\x00" + payload])


def profile(number, clock, cells=4, beams=4, cm=800, seed=0):
    """A standard profile: both leaders, four blocks that grow with the cells, and bottom track."""
    fixed = bytearray(40)
    fixed[8], fixed[9] = beams, cells
    fixed[12:14] = struct.pack("<H", cm)
    grown = [bytes([0, k + 1]) + bytes((seed + 20 * k + i) % 256 for i in range(cells * beams * w)) for k, w in enumerate((2, 1, 1, 1))]
    return assemble([bytes(fixed), leader(number, clock), *grown, b"\x00\x06" + bytes((seed + i) % 256 for i in range(68))])
