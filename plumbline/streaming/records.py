"""Streams of record files: an addition of this library, made of the same scan.

Files that land in a folder are scanned as they come; copies are dropped within a watermark on the records' clocks; and
each station's state remembers its last record, so that a gap is told when the record behind it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import to_millis
from ..sources.pd0 import records, scan_contents

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
GAP = "station string, before_rtc string, after_rtc string, elapsed_ms long, missing_ms long, estimated long"


def landing_records(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Records of .000 files as they land in `folder`; each must appear whole."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.000").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return records(scan_contents(files.select("path", "content"), payloads=True)).drop("payload")


def without_copies(rows: DataFrame, delay: str) -> DataFrame:
    """Each digest once, as long as its copies come within `delay` of the newest clock. Records without a clock carry
    the epoch, and so are late as soon as there is a watermark."""
    stamp = F.coalesce(F.col("rtc").cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    return rows.withColumn("event_time", stamp).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["digest"])


def gap_stream(rows: DataFrame, nominal_ms: int, station: str = "config") -> DataFrame:
    """Gaps between records of a station (any column), in the order in which its clocks advance; a record older than the
    last one is late and changes nothing. State: one clock for each station."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        found = []
        for row in pd.concat(list(batches)).sort_values("ms").itertuples():
            if last is not None and row.ms > last[0] + nominal_ms:
                missing = row.ms - last[0] - nominal_ms
                found.append((key[0], last[1], row.rtc_text, row.ms - last[0], missing, round(missing / nominal_ms)))
            if last is None or row.ms > last[0]:
                last = (int(row.ms), row.rtc_text)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(found, columns=[f.split()[0] for f in GAP.split(", ")])

    timed = rows.where("rtc IS NOT NULL").select(F.col(station).cast("string").alias("station"), to_millis("rtc").alias("ms"), "rtc_text")
    return timed.groupBy("station").applyInPandasWithState(step, GAP, "ms long, rtc_text string", "append", GroupStateTimeout.NoTimeout)
