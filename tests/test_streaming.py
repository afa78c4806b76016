from plumbline.streaming.records import gap_stream, landing_records, without_copies

from .fixtures import at, record


def drain(df, spark, name):
    stream = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    return spark.table(name).collect()


def test_records_copies_and_gaps(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.000").write_bytes(record(1, at(0)) + record(2, at(1)) + record(2, at(1)))
    (folder / "b.000").write_bytes(b"noise" + record(2, at(1)) + record(5, at(4)))
    (folder / "c.txt").write_bytes(record(9, at(9)))
    rows = landing_records(spark, str(folder))
    got = drain(without_copies(rows, "10 minutes").select("number", "rtc_text"), spark, "once")
    assert sorted(r.number for r in got) == [1, 2, 5]
    (gap,) = drain(gap_stream(landing_records(spark, str(folder)), 1000), spark, "gaps")
    assert (gap.before_rtc, gap.after_rtc, gap.elapsed_ms, gap.missing_ms, gap.estimated) == ("2024-03-01T12:00:01.000", "2024-03-01T12:00:04.000", 3000, 2000, 2)
