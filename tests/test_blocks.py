"""Files that are scanned in blocks."""

import random

import pytest

from plumbline.sources import pd0

from .fixtures import at, record


def plain(rows):
    return sorted((tuple((k, str(v)) for k, v in sorted(r.items()) if v is not None and k not in ("path", "size")) for r in rows))


def in_blocks(path, mode, payloads):
    out, blocks = [], list(pd0._blocks(f"file:{path}", mode))
    for b in blocks:
        with path.open("rb") as f:
            source = pd0.Stretch(f, path.stat().st_size)
            ends = [(side, (a, e, pd0.Fault(*fault))) for side, a, e, *fault in pd0.json.loads(b["ends"])]
            for batch in pd0._batches(pd0._scan(source, "x", mode, payloads, b["begin"], b["stop"], ends), "x", source.size, payloads):
                out += batch.to_pylist()
    return out, len(blocks)


@pytest.mark.parametrize("mode", ["resync", "strict"])
def test_blocks_find_what_one_scan_finds(tmp_path, monkeypatch, mode):
    monkeypatch.setattr(pd0, "BLOCK", 100_000)
    chance = random.Random(5)
    for case in range(4):
        parts = [record(k % 60_000, at(k % 50), bytes(6 + 2 * (k // 700 % 3))) for k in range(6_000)]
        for k in chance.sample(range(6_000), 0 if case == 0 else 40 * case):
            parts[k] = chance.choice([b"noise" + parts[k], parts[k][:-1] + b"\xee", parts[k][:30], b"\x7f\x7f\xff\xff", b"\x7f" * 9, bytes(70_000)])
        data = b"".join(parts) + (b"", parts[-1][:50], b"\x7f\x7f" * 40, bytes(150_000))[case]
        path = tmp_path / f"{case}.000"
        path.write_bytes(data)
        want = plain(pd0.scan_rows(data, mode, True))
        found, blocks = in_blocks(path, mode, True)
        assert plain(found) == want
        assert blocks > 3 or mode == "strict"
        whole = [r for b in pd0._batches(pd0._scan(pd0.Whole(data), "x", mode, True), "x", len(data), True) for r in b.to_pylist()]
        assert plain(whole) == want


def test_small_files_share_tasks(spark, tmp_path):
    whole = {}
    for k in range(120):
        data = b"".join(record(100 * k + i, at(i % 50), bytes(6)) for i in range(k % 12)) + (b"", b"noise", b"\x7f\x7f\x30")[k % 3]
        (tmp_path / f"{k}.000").write_bytes(data)
        whole[f"file:{tmp_path}/{k}.000"] = data
    (tmp_path / "_no.000").write_bytes(b"not listed")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "4m")
        found = pd0.scan_files(spark, sorted(whole))
        assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism + 1
        got = [r.asDict() for r in found.collect()]
        assert {r["path"] for r in got} == set(whole)
        for path, data in whole.items():
            assert plain([r for r in got if r["path"] == path]) == plain(pd0.scan_rows(data)), path
        hidden = pd0.scan_files(spark, [str(tmp_path / "_no.000"), str(tmp_path / "3.000")])
        assert {r.path for r in hidden.select("path").distinct().collect()} == {f"file:{tmp_path}/3.000"}
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
