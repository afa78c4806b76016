"""Operators where the tables hold no case."""

import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.functions import common_value, full_year, in_order, primary_status
from plumbline.operators import cadence, recovery
from plumbline.operators.ordered import _parts, global_lag, global_running_total
from plumbline.plans.reports import _elements, write_csv, write_json
from pyspark.sql import functions as F

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@given(st.lists(st.tuples(st.none() | st.integers(-5, 5), st.integers(0, 9)), min_size=1, max_size=30), st.integers(1, 6))
@SLOW
def test_global_windows_are_those_of_one_task(spark, rows, buckets):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "id long, k long, v long")
    order = [F.col("k"), F.col("id")]
    plain = sorted(((k is None, k or 0, i), v) for i, (k, v) in enumerate(rows))
    values = [v for _, v in plain]
    got = {r.id: r.b for r in global_lag(df, order, F.col("v"), "b", buckets).collect()}
    assert [got[key[2]] for key, _ in plain] == [None, *values[:-1]]
    got = {r.id: r.t for r in global_running_total(df, order, F.col("v"), "t", buckets).collect()}
    assert [got[key[2]] for key, _ in plain] == [sum(values[:i]) for i in range(len(values))]


@pytest.mark.parametrize(
    "values,want",
    [([], None), ([5], 5), ([5, 7], 5), ([7, 5], 5), ([1, 9, 9], 9), ([1, 5, 9], 5), ([None, 9, 1], 1), ([None, None, None], None), ([3, 3, 1], 3)],
)
def test_common_value(spark, values, want):
    array = F.array(*[F.lit(v).cast("long") for v in values]).cast("array<long>")
    assert spark.range(1).select(common_value(array)).first()[0] == want


@pytest.mark.parametrize("deltas,want", [([], None), ([10, 10, 20], 10), ([10, 20], 10), ([10, 20, 30], 20), ([1, 1, 5, 5, 6], 5)])
def test_mode_ties(spark, deltas, want):
    assert cadence.mode_interval(spark.createDataFrame([(d,) for d in deltas], "delta long")).first()[0] == want


def test_half_estimates_round_to_even(spark):
    rows = [("f", "f", s, datetime(2024, 1, 1, 0, 0, s), f"t{s}", s) for s in (0, 2, 7, 11)]
    kept = spark.createDataFrame(rows, "file string, file_name string, start long, rtc timestamp_ntz, rtc_text string, number int")
    got = recovery.gaps(kept, F.lit(2000).cast("long")).orderBy("elapsed_ms").collect()
    assert [(r.missing_acquisition_ms, r.estimated_missing_ensembles) for r in got] == [(2000, 1), (3000, 2)]
    assert recovery.gaps(kept, F.lit(None).cast("long")).count() == 0
    assert recovery.gaps(kept.limit(0), F.lit(1).cast("long")).count() == 0


def test_status_order(spark):
    facts = F.array(*map(F.lit, ["GAP", "CONFLICT", "OTHER"]))
    row = spark.range(1).select(in_order(facts).alias("o"), primary_status(facts).alias("p"), full_year(F.lit(50)).alias("a"), full_year(F.lit(51)).alias("b"), full_year(F.lit(255)).alias("c")).first()
    assert (row.o, row.p, row.a, row.b, row.c) == (["CONFLICT", "GAP"], "CONFLICT", 2050, 1951, 2155)


def test_verdict_order(spark):
    t, f = F.lit(True), F.lit(False)
    cases = [((t, f, t, t, t), "MANUAL_REVIEW_REQUIRED"), ((f, t, t, f, f), "MANUAL_REVIEW_REQUIRED"), ((f, f, t, t, t), "FAIL"), ((f, f, f, t, t), "PASS_WITH_UNRECOVERABLE_FRAGMENTS"), ((f, f, f, f, t), "PASS_WITH_GAPS"), ((f,) * 5, "PASS")]
    got = spark.range(1).select(*[recovery.verdict(*c) for c, _ in cases]).first()
    assert list(got) == [w for _, w in cases]


def test_json_is_written_row_by_row(tmp_path):
    rows = ({"n": i, "x": None} for i in range(1000))
    value = {"a": 1, "none": None, "rows": (json.dumps(r) for r in rows), "nothing": iter([]), "in": {"t": "é\"", "l": [1, "b"]}, "empty": {}}
    write_json(tmp_path / "x.json", value)
    told = json.loads((tmp_path / "x.json").read_text(encoding="utf-8"))
    assert told == {"a": 1, "none": None, "rows": [{"n": i, "x": None} for i in range(1000)], "nothing": [], "in": {"t": "é\"", "l": [1, "b"]}, "empty": {}}


def test_equal_and_missing_keys_lie_in_several_parts(spark):
    """One clock on all rows, then none at all: the order's other columns deal the rows."""
    for k in (7, None):
        rows = _parts(spark.createDataFrame([(i, k) for i in range(400)], "id long, k long").repartition(4), [F.col("k"), F.col("id")], 4)
        sizes = [r["count"] for r in rows.groupBy("__part").count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 250


def test_provenance_problems(spark):
    mapped = spark.createDataFrame([(0, 3, "a"), (3, 2, "b")], "output_byte_offset long, total_bytes long, digest string")
    output = spark.createDataFrame([(0, 3, "a"), (3, 2, "x")], "start long, total_bytes long, digest string")
    assert sorted((r.place, r.digest, r.problem) for r in recovery.verify_provenance(mapped, output).collect()) == [(3, "b", "missing in output"), (3, "x", "not in map")]


def test_steps_cross_stretches(spark, monkeypatch):
    monkeypatch.setattr(cadence, "STRETCH", 100)
    ms = [0, 10, 30, None, 70, 75, 75, 60, 200]
    rows = [(f, 40 * i if f == "a" else 700 * i, ms[i]) for f in "ab" for i in range(len(ms))]
    made = spark.createDataFrame(rows, "file string, start long, ms long").select("file", "start", F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, ms / 1000.0)").alias("rtc"))
    found = sorted((r.file, r.delta) for r in cadence.steps(made).collect())
    assert found == [(f, d) for f in "ab" for d in (5, 10, 20, 140)]


def test_large_reports_are_written_on_executors(spark, tmp_path, monkeypatch):
    import csv
    import io

    values = [(i, None if i % 3 else f'a,"{i}"\n\u00e9', i % 2 == 0) for i in range(5_000)]
    rows = spark.createDataFrame(values, "n long, t string, b boolean").repartition(5).orderBy("n")
    monkeypatch.setattr(type(rows), "toLocalIterator", None)
    want = io.StringIO(newline="")
    csv.writer(want).writerows([["n", "t", "b"], *values])
    for some, text in ((rows, want.getvalue()), (rows.limit(0), "n,t,b\r\n")):
        write_csv(some, tmp_path / "a.csv")
        assert (tmp_path / "a.csv").read_bytes() == text.encode()
        write_json(tmp_path / "a.json", {"rows": _elements(some, tmp_path / "e"), "n": 1})
        told = json.loads((tmp_path / "a.json").read_text(encoding="utf-8"))
        assert told == {"rows": [dict(zip("ntb", v, strict=True)) for v in (values if some is rows else [])], "n": 1}
