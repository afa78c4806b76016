"""Statuses and choices as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import BOUNDARY_ORDER


def in_order(facts: Column) -> Column:
    """The facts in the order of importance."""
    order = F.array(*map(F.lit, BOUNDARY_ORDER))
    return F.filter(order, lambda s: F.array_contains(facts, s))


def primary_status(facts: Column) -> Column:
    return F.coalesce(F.try_element_at(in_order(facts), F.lit(1)), F.lit("AMBIGUOUS"))


def counter_transition(prev: Column, curr: Column) -> Column:
    """How a counter goes on from one record (struct number, number_lsb, number_msb, rtc) to the next."""
    a, b = prev["number"], curr["number"]
    wraps = (prev["number_lsb"] == 65535) & (curr["number_lsb"] == 0) & (curr["number_msb"] == (prev["number_msb"] + 1) % 256)
    later = F.coalesce(curr["rtc"] > prev["rtc"], F.lit(False))
    return (
        F.when(prev.isNull() | curr.isNull(), "unknown")
        .when(wraps, "counter_rollover")
        .when(b == a + 1, "normal_increment")
        .when(later & (b < a), F.concat(F.lit("counter_reset_to_"), b.cast("string")))
        .when(b < a, "backward_jump")
        .when(b > a + 1, "forward_jump")
        .otherwise("nonstandard_transition")
    )


def common_value(values: Column) -> Column:
    """The most frequent of up to three numbers; ties go to the one nearest the median, then to the smaller. Nulls don't
    count; null without any."""
    own = F.array_sort(F.array_compact(values))
    n = F.size(own)
    pick = lambda i: F.try_element_at(own, i)
    median = (pick(F.floor((n + 1) / 2).cast("int")) + pick((F.floor(n / 2) + 1).cast("int"))) / 2.0
    scored = F.transform(own, lambda v: F.struct((-F.size(F.filter(own, lambda w: w == v))).alias("rare"), F.abs(v - median).alias("far"), v.alias("v")))
    return F.array_min(scored)["v"]
