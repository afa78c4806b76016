"""Scalar functions: native column expressions only."""

from .binary import byte_at, checksum16, counter24, encode_u8, encode_u16, lower_hex, u16, u16_array
from .rtc import full_year, rtc_stamp, rtc_text, to_millis
from .status import common_value, counter_transition, in_order, primary_status

__all__ = [
    "byte_at", "checksum16", "common_value", "counter24", "counter_transition", "encode_u16", "encode_u8", "full_year", "in_order",
    "lower_hex", "primary_status", "rtc_stamp", "rtc_text", "to_millis", "u16", "u16_array",
]
