"""Scan, recovery, slices and trims of files, from the bytes up."""

import csv
import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.cli import main
from plumbline.operators.files import merge_regions
from plumbline.plans import actions
from plumbline.plans.dataset import Dataset, find_groups, only_group, validate_file
from plumbline.sources.pd0 import Fault, Frame, checksum, frame_at, walk, walk_strict
from plumbline.sources.sink import register
from pyspark.sql import functions as F

from .fixtures import at, leader, profile, record


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in files.items():
        (folder / f"{name}.000").write_bytes(data)
    return [str(folder / f"{n}.000") for n in files]


def recovered(spark, tmp_path, **files):
    paths = put(tmp_path / "in", **files)
    return actions.recover(spark, paths, str(tmp_path / "out")), tmp_path / "out"


def boundaries(out):
    with (out / "boundary_analysis.csv").open() as f:
        return list(csv.DictReader(f))


def two(a, b):
    return record(a, at(a)) + record(b, at(b))


# parsing


def spoil(data, place, value):
    return data[:place] + bytes([value]) + data[place + 1 :]


GOOD = record(1, at(0))
FAULTS = [
    (GOOD[:5], "TRUNCATED_ENSEMBLE: incomplete header"),
    (b"xx" + GOOD[2:], "NON_PD0_DATA: missing sync"),
    (spoil(GOOD, 2, 5), "NON_PD0_DATA: implausible byte count 5"),
    (GOOD[:-1], "TRUNCATED_ENSEMBLE: declared 83 bytes beyond EOF"),
    (spoil(GOOD, 5, 1), "NON_PD0_DATA: implausible data type count 1"),
    (spoil(GOOD, 5, 65), "NON_PD0_DATA: implausible data type count 65"),
    (spoil(GOOD, 5, 64), "POSSIBLE_FRAGMENT: header length exceeds ensemble byte count"),
    (spoil(GOOD, 6, 13), "POSSIBLE_FRAGMENT: first offset 13 != header length 12"),
    (spoil(GOOD, 10, 90), "POSSIBLE_FRAGMENT: data-type offset beyond checksum coverage"),
    (spoil(GOOD, 10, 52), "POSSIBLE_FRAGMENT: data-type offsets not strictly increasing"),
    (spoil(GOOD, 12, 9), "POSSIBLE_FRAGMENT: missing fixed leader at first offset"),
    (spoil(GOOD, 52, 9), "POSSIBLE_FRAGMENT: missing variable leader at second offset"),
    (spoil(GOOD, 10, 60), "POSSIBLE_FRAGMENT: short variable leader length 8"),
    (spoil(GOOD, 40, GOOD[40] ^ 1), f"BAD_CHECKSUM: stored 0x{checksum(GOOD[:-2]):04x} != calculated 0x{checksum(spoil(GOOD, 40, GOOD[40] ^ 1)[:-2]):04x}"),
]


@pytest.mark.parametrize("data,status", FAULTS, ids=[s.split(":")[1][:25] for _, s in FAULTS])
def test_first_failing_test_is_reported(data, status):
    assert str(frame_at(data, 0)) == status


def test_short_fixed_leader():
    short = spoil(spoil(GOOD, 8, 51), 51, 0x80)
    assert str(frame_at(spoil(short, 52, 0), 0)) == "POSSIBLE_FRAGMENT: short fixed leader length 39"


@given(st.lists(st.sampled_from([GOOD, GOOD[:40], b"\x7f", b"\x7f\x7f", b"noise", profile(2, at(1)), spoil(GOOD, 50, 7)]), max_size=8))
@settings(max_examples=150, deadline=None)
def test_walks_cover_the_bytes(parts):
    data = b"".join(parts)
    seen, last = set(), 0
    for begin, end, found in walk(data):
        assert 0 <= begin < end <= len(data)
        seen |= set(range(begin, end))
        if isinstance(found, Frame):
            assert begin >= last and data[begin:end] in (GOOD, profile(2, at(1))) or checksum(data[begin : end - 2]) == found.stored
            last = end
    assert seen == set(range(len(data)))
    strict = list(walk_strict(data))
    assert all(isinstance(f, Frame) for _, _, f in strict[:-1])


def test_sync_inside_a_valid_record_is_skipped():
    assert [type(f) for _, _, f in walk(record(1, at(0), b"\x7f\x7f\x00\x01\x02\x03"))] == [Frame]


def test_regions_after_a_failed_candidate_overlap():
    bad = spoil(GOOD, len(GOOD) - 1, GOOD[-1] ^ 0xFF)
    got = [(b, e, f.classification) for b, e, f in walk(bad) if isinstance(f, Fault)]
    assert got == [(0, 2, "BAD_CHECKSUM"), (1, 83, "NON_PD0_DATA")]


def test_record_columns(spark, tmp_path):
    paths = put(tmp_path, a=record(70_000, at(1.25)) + record(5, bytes([51, 13, 1, 2, 3, 60, 100])))
    first, second = Dataset(spark, paths).with_bytes.orderBy("start").collect()
    data = record(70_000, at(1.25))
    assert (first.number, first.number_lsb, first.number_msb, first.rtc, first.rtc_text) == (70_000, 70_000 - 65_536, 1, at(1.25), "2024-03-01T12:00:01.250")
    assert (first.digest, first.config) == (hashlib.sha256(data).hexdigest(), hashlib.sha256(data[12:52]).hexdigest())
    assert (first.offsets, first.ids, first.total_bytes, first.byte_count) == ([12, 52, 73], ["0000", "8000", "0100"], 83, 81)
    assert first.stored_checksum == first.calculated_checksum == sum(data[:-2]) % 65536
    assert (second.rtc, second.rtc_valid, second.rtc_text) == (None, False, "raw:51-13-01T02:03:60.100")
    assert bytes(second.payload) == record(5, bytes([51, 13, 1, 2, 3, 60, 100]))


def test_only_like_neighbours_are_merged(spark):
    """Three regions side by side that differ in candidacy and declared length stay three; alike ones become one, and
    another region between two of them keeps them apart."""
    rows = [
        ("f", 0, 2, "TRUNCATED_ENSEMBLE", "r", True, 83), ("f", 2, 4, "TRUNCATED_ENSEMBLE", "r", False, 83), ("f", 4, 6, "TRUNCATED_ENSEMBLE", "r", False, None),
        ("f", 6, 8, "TRUNCATED_ENSEMBLE", "r", False, None), ("g", 0, 5, "NON_PD0_DATA", "s", False, None), ("g", 2, 3, "BAD_CHECKSUM", "t", True, None), ("g", 5, 6, "NON_PD0_DATA", "s", False, None),
        ("h", 0, 2, "VALID_ENSEMBLE", "v", True, 2), ("h", 2, 4, "VALID_ENSEMBLE", "v", True, 2),
    ]
    regions = spark.createDataFrame(rows, "file string, start long, end long, classification string, reason string, is_candidate boolean, declared long")
    got = sorted((r.file, r.start, r.end) for r in merge_regions(regions).collect())
    assert got == [("f", 0, 2), ("f", 2, 4), ("f", 4, 8), ("g", 0, 5), ("g", 2, 3), ("g", 5, 6), ("h", 0, 2), ("h", 2, 4)]


# recovery


def test_clean_files_in_order_of_time(spark, tmp_path):
    got, out = recovered(spark, tmp_path, a=two(3, 4), b=two(1, 2))
    assert (got.verdict, got.accepted, got.removed, got.conflicts) == ("PASS", 4, 0, [])
    assert (out / "recovered.000").read_bytes() == two(1, 2) + two(3, 4)
    (b,) = boundaries(out)
    assert (b["previous_file"], b["primary_status"], b["facts"], b["counter_transition"], b["fixed_leader_match"]) == ("b.000", "CLEAN_CONTIGUOUS", "CLEAN_CONTIGUOUS", "normal_increment", "True")
    told = json.loads((out / "recovery_manifest.json").read_text())
    assert told["chronological_order"] == ["b.000", "a.000"] and told["validation"]["issues"] == [] and len(told["accepted_records"]) == 4
    with (out / "recovered_ensemble_map.csv").open() as f:
        rows = list(csv.DictReader(f))
    assert [(r["output_byte_offset"], r["source_file"], r["source_offset"], r["continuation_file"]) for r in rows] == [("0", "b.000", "0", ""), ("83", "b.000", "83", ""), ("166", "a.000", "0", ""), ("249", "a.000", "83", "")]
    assert "| b.000 |" in (out / "recovery_report.md").read_text()


@pytest.mark.parametrize("numbers,transition,status", [((10, 11, 1, 2), "counter_reset_to_1", "CLEAN_WITH_COUNTER_RESET"), ((65_534, 65_535, 65_536, 65_537), "counter_rollover", "CLEAN_WITH_COUNTER_RESET")])
def test_counters(spark, tmp_path, numbers, transition, status):
    r = [record(n, at(i)) for i, n in enumerate(numbers)]
    got, out = recovered(spark, tmp_path, a=r[0] + r[1], b=r[2] + r[3])
    (b,) = boundaries(out)
    assert (b["counter_transition"], b["primary_status"], got.verdict) == (transition, status, "PASS")


def test_gap(spark, tmp_path):
    got, out = recovered(spark, tmp_path, a=record(1, at(0)) + record(2, at(1)) + record(3, at(4)))
    with (out / "recovered_gaps.csv").open() as f:
        (g,) = csv.DictReader(f)
    assert got.verdict == "PASS_WITH_GAPS"
    assert (g["elapsed_seconds"], g["missing_acquisition_seconds"], g["estimated_missing_ensembles"], g["location"]) == ("3.000", "2.000", "2", "within_file")


def test_copies_and_conflicts(spark, tmp_path):
    got, out = recovered(spark, tmp_path / "1", a=two(1, 2), b=two(2, 3))
    assert (got.verdict, got.accepted, got.removed) == ("PASS", 3, 1)
    assert boundaries(out)[0]["exact_duplicate_overlap"] == "1" and "PARTIAL_OVERLAP" in boundaries(out)[0]["facts"]
    got, out = recovered(spark, tmp_path / "2", a=two(1, 2), b=record(9, at(2), b"\x09" * 6) + record(3, at(3)))
    assert (got.verdict, got.output, len(got.conflicts)) == ("MANUAL_REVIEW_REQUIRED", None, 1)
    assert not (out / "recovered.000").exists() and boundaries(out)[0]["primary_status"] == "CONFLICT"
    assert got.conflicts[0].startswith("conflicting valid overlap at RTC 2024-03-01T12:00:02.000: b.000 offset 0")


def test_truncated_tail_and_leading_noise(spark, tmp_path):
    got, out = recovered(spark, tmp_path / "1", a=GOOD + record(2, at(1))[:-10])
    assert (got.verdict, got.accepted) == ("PASS_WITH_UNRECOVERABLE_FRAGMENTS", 1)
    (edge,) = json.loads((out / "recovery_manifest.json").read_text())["source_files"][0]["fragments"]
    assert (edge["side"], edge["byte_offset"], edge["available"], edge["declared"], edge["number"], edge["checksum_present"]) == ("trailing", 83, 73, 83, 2, False)
    got, out = recovered(spark, tmp_path / "2", a=b"noise" + GOOD)
    assert got.verdict == "PASS_WITH_UNRECOVERABLE_FRAGMENTS"
    with (out / "source_inventory.csv").open() as f:
        (row,) = csv.DictReader(f)
    assert (row["leading_fragment_bytes"], row["fragments"]) == ("5", "leading:0:5:NON_PD0_DATA")


def test_split_record(spark, tmp_path):
    whole = record(2, at(1))
    got, out = recovered(spark, tmp_path / "safe", a=GOOD + whole[:-12], b=whole[-12:] + record(3, at(2)))
    assert got.accepted == 3 and (out / "recovered.000").read_bytes() == GOOD + whole + record(3, at(2))
    (split,) = json.loads((out / "recovery_manifest.json").read_text())["split_candidates"]
    assert (split["status"], split["next_consumed_bytes"], split["candidate_ensemble_number"]) == ("SAFE_RECONSTRUCTION", 12, 2)
    assert got.verdict == "PASS_WITH_UNRECOVERABLE_FRAGMENTS"  # an edge fragment stays one
    with (out / "recovered_ensemble_map.csv").open() as f:
        row = list(csv.DictReader(f))[1]
    assert (row["reconstructed"], row["continuation_file"], row["continuation_length"], row["source_length"]) == ("True", "b.000", "12", "71")
    got, out = recovered(spark, tmp_path / "clean", a=GOOD + whole[:-8], b=record(3, at(2)))
    assert got.accepted == 2 and json.loads((out / "recovery_manifest.json").read_text())["split_candidates"] == []
    late = record(2, at(9))
    got, out = recovered(spark, tmp_path / "late", a=GOOD + late[:-12], b=late[-12:] + record(3, at(2)))
    (split,) = json.loads((out / "recovery_manifest.json").read_text())["split_candidates"]
    assert (split["status"], split["stored_checksum_validates"]) == ("REJECTED", True) and "RTC" in split["reason"]


def test_configuration_change(spark, tmp_path):
    _, out = recovered(spark, tmp_path, a=two(1, 2), b=record(3, at(3), fixed=40) + record(4, at(4), fixed=40))
    assert boundaries(out)[0]["primary_status"] == "CONFIGURATION_CHANGE" and boundaries(out)[0]["configuration_changed"] == "True"


def test_odd_files(spark, tmp_path):
    got, out = recovered(spark, tmp_path / "empty", a=b"")
    assert (got.verdict, got.accepted, (out / "recovered.000").read_bytes()) == ("PASS", 0, b"")
    got, out = recovered(spark, tmp_path / "junk", a=b"junk", b=GOOD)
    assert got.verdict == "PASS_WITH_UNRECOVERABLE_FRAGMENTS" and got.accepted == 1
    paths = put(tmp_path / "same/x", a=two(1, 2)) + put(tmp_path / "same/y", a=two(3, 4))
    got = actions.recover(spark, paths, str(tmp_path / "same/out"))
    assert (got.verdict, got.accepted) == ("PASS", 4)  # equal names in two folders stay apart
    path = tmp_path / "spoiled.000"
    path.write_bytes(two(1, 2)[:-1] + b"\xaa")
    checked = validate_file(spark, str(path))
    assert checked.records == 1 and len(checked.issues) == 2 and checked.issues[0].startswith("parsing stopped at byte 83: BAD_CHECKSUM")


# inputs and command line


def test_groups(spark, tmp_path):
    put(tmp_path / "x", a=GOOD)
    put(tmp_path / "x/sub", b=GOOD)
    put(tmp_path / "x/output", c=GOOD)
    (tmp_path / "x/recovered.000").write_bytes(GOOD)
    assert [[f.rsplit("/", 1)[1] for f in g.files] for g in find_groups(spark, [str(tmp_path / "x")])] == [["a.000"]]
    several = find_groups(spark, [str(tmp_path / "x")], recursive=True)
    assert [len(g.files) for g in several] == [1, 1] and only_group(several) == "MULTIPLE_CANDIDATE_DATASETS"
    assert only_group(find_groups(spark, [str(tmp_path / "none")])) == "NO_INPUT_FILES_FOUND"
    named = find_groups(spark, [str(tmp_path / "x/recovered.000"), str(tmp_path / "x/a.000"), "nothing.txt"])
    assert len(named) == 1 and named[0].basis == "explicit_files" and len(named[0].files) == 2


def test_command_line(spark, tmp_path, capsys):
    put(tmp_path / "x", a=two(1, 2), b=two(3, 4))
    assert main(["inspect", str(tmp_path / "x")], spark) == 0
    text = capsys.readouterr().out
    assert "CLEAN_CONTIGUOUS" in text and "a.000, b.000" in text
    assert main(["recover", str(tmp_path / "x"), "--output-dir", str(tmp_path / "x/out")], spark) == 0
    assert capsys.readouterr().out.startswith("PASS\n")
    assert main(["inspect", str(tmp_path / "gone")], spark) == 1
    put(tmp_path / "x/y", c=GOOD)
    assert main(["recover", str(tmp_path / "x"), "--recursive", "--output-dir", str(tmp_path / "z")], spark) == 1
    assert main(["inspect", str(tmp_path / "x"), "--recursive"], spark) == 0


# slices and trims


@pytest.mark.parametrize("kept,options", [((2, 3, 4), {"first": 2}), ((0, 1, 2), {"last": 2}), ((0, 4), {"range_spec": "2:4"}), ((), {"last": 5})])
def test_slices(spark, tmp_path, kept, options):
    parts = [record(n, at(0)) for n in (65_535, 65_536, 65_537, 1, 1)]
    (path,) = put(tmp_path, a=b"".join(parts))
    plan = actions.plan_slice(spark, path, **options)
    assert f"Retained: {len(kept)}" in plan.text()
    assert actions.write_slice(plan, str(tmp_path / "o/b.000")) == len(kept)
    assert (tmp_path / "o/b.000").read_bytes() == b"".join(parts[i] for i in kept)


def test_version(capsys):
    with pytest.raises(SystemExit) as done:
        main(["--version"])
    assert done.value.code == 0 and capsys.readouterr().out.startswith("plumbline 0.")


def test_slice_refusals(spark, tmp_path, capsys):
    (path,) = put(tmp_path, a=two(1, 2))
    for options in ({"first": 0}, {"first": 3}, {"last": -1}, {"range_spec": "2:1"}, {"range_spec": "1:3"}, {"range_spec": "1"}, {"range_spec": "a:b"}, {}, {"first": 1, "last": 1}):
        with pytest.raises(ValueError):
            actions.plan_slice(spark, path, **options)
    plan = actions.plan_slice(spark, path, first=1)
    (tmp_path / "there.000").write_bytes(b"x")
    for target in (path, str(tmp_path / "there.000")):
        with pytest.raises(ValueError):
            actions.write_slice(plan, target)
    (junk,) = put(tmp_path, j=two(1, 2) + b"truncated")
    assert main(["slice", junk, "--first", "1", "--dry-run"], spark) == 0
    assert "Unparsed bytes: 9" in capsys.readouterr().out
    assert main(["slice", junk, "--first", "1", "--output", str(tmp_path / "n.000")], spark) == 1
    assert not (tmp_path / "n.000").exists() and "9 bytes belong to no record" in capsys.readouterr().err


def test_bin_trim(spark, tmp_path, capsys):
    source = [profile(n, at(n), seed=n) for n in range(1, 4)]
    (path,) = put(tmp_path, a=b"".join(source))
    plan = actions.plan_bin_trim(spark, path, 2)
    assert "241, 40 fewer, 201 after" in plan.text() and "16.00 m" in plan.text()
    assert actions.write_bin_trim(plan, str(tmp_path / "b.000")) == 3
    data = (tmp_path / "b.000").read_bytes()
    assert len(data) == 603 and [e - b for b, e, f in walk(data) if isinstance(f, Frame)] == [201] * 3
    assert data[:201][20 + 9] == 2 and data[81 : 81 + 18] == source[0][81 : 81 + 18] and data[201 - 2 - 70 : 201 - 2] == source[0][169 : 169 + 70]
    assert main(["slice-bins", path, "--last", "1", "--output", str(tmp_path / "c.000")], spark) == 0
    assert main(["slice-bins", path, "--last", "1", "--dry-run"], spark) == 0
    for n in ("0", "-1", "4", "5"):
        assert main(["slice-bins", path, "--last", n, "--dry-run"], spark) == 1
    capsys.readouterr()


def test_bin_trim_refusals(spark, tmp_path):
    wrong = {
        "unknown": record(1, at(0)),
        "noise": profile(1, at(0)) + b"x",
        "mixed": profile(1, at(0)) + profile(2, at(1), cells=5),
        "size": profile(1, at(0)) + profile(2, at(1), cm=400),
        "none": b"",
    }
    for name, data in wrong.items():
        (path,) = put(tmp_path, **{name: data})
        with pytest.raises(ValueError):
            actions.plan_bin_trim(spark, path, 1)


def test_data_source_reads_and_writes(spark, tmp_path):
    register(spark)
    paths = put(tmp_path / "d", a=two(1, 2), b=b"x" + GOOD)
    found = spark.read.format("pd0").load(str(tmp_path / "d"))
    assert found.where("kind = 'record'").count() == 3
    assert {r.path for r in found.where("kind = 'file'").collect()} == set(paths)
    assert spark.read.format("pd0").option("mode", "strict").load(paths[1]).where("kind = 'record'").count() == 0
    rows = Dataset(spark, paths).with_bytes.orderBy(F.desc("start"), "file")
    rows.select("payload").write.format("pd0").mode("append").save(str(tmp_path / "o.000"))
    assert len((tmp_path / "o.000").read_bytes()) == 249 and not (tmp_path / "o.000.parts").exists()


def test_framing_mode_ignores_checksums(spark, tmp_path):
    (path,) = put(tmp_path, a=spoil(GOOD, 40, GOOD[40] ^ 1) + GOOD)
    rows = Dataset(spark, [path], "framing").records.orderBy("start").collect()
    assert [r.stored_checksum == r.calculated_checksum for r in rows] == [False, True]
    assert leader(1, at(0))[:2] == b"\x80\x00"
