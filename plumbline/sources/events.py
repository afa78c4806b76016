"""The events table as an archive of record files, with the faults that recovery deals with.

A file is a day. Every 31st event is missing; every 97th comes again, unchanged, in the next day's file, and one in 113
comes again there with other bytes; the counter wraps and starts over; one clock in 211 is no date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import to_millis
from ..functions.rtc import ISO

EPOCH = "1970-01-01 00:00:00"


def at_millis(ms: F.Column) -> F.Column:
    """timestamp_ntz of milliseconds since 1970."""
    zero = F.lit(0)
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, (ms / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,6)"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the columns that operators use: file, file_name, start, end, total_bytes, number, number_lsb,
    number_msb, rtc, rtc_valid, rtc_text, config, digest."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "props")
    ident = F.col("event_id")
    kinds = F.array_compact(F.array(*[F.when(w, F.lit(k)) for k, w in enumerate((ident % 31 != 0, ident % 97 == 0, ident % 113 == 1))]))
    rows = events.select("*", F.explode(kinds).alias("kind"))
    ms = (to_millis("ts") / 10).cast("long") * 10
    number = (ident + 65000) % 70000
    valid = ident % 211 != 0
    day = F.date_format(F.when(F.col("kind") == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL '1' DAY")), "yyyyMMdd")
    length = (F.length("props") + 83).cast("int")
    start = ident * 4 + F.col("kind")
    rtc = at_millis(ms)
    return rows.select(
        day.alias("file"), day.alias("file_name"), start.alias("start"), (start + 3).alias("end"), length.alias("total_bytes"),
        number.cast("int").alias("number"), number.bitwiseAND(65535).cast("int").alias("number_lsb"), F.shiftright(number, 16).cast("int").alias("number_msb"),
        F.when(valid, rtc).alias("rtc"), valid.alias("rtc_valid"),
        F.when(valid, F.date_format(rtc, ISO)).otherwise(F.concat(F.lit("raw:"), (ident % 7).cast("string"))).alias("rtc_text"),
        F.sha2(F.concat(F.lit("layout "), F.floor(F.dayofmonth("ts") / 4).cast("string")).cast("binary"), 256).alias("config"),
        F.sha2(F.concat_ws("|", ident.cast("string"), "props", F.when(F.col("kind") == 2, "changed")).cast("binary"), 256).alias("digest"),
    )


#: The same records in DuckDB; ms is the clock in milliseconds.
ARCHIVE_SQL = """
    kinds AS (
        SELECT event_id, ts, props, unnest(list_filter([CASE WHEN event_id % 31 <> 0 THEN 0 END, CASE WHEN event_id % 97 = 0 THEN 1 END, CASE WHEN event_id % 113 = 1 THEN 2 END], lambda x: x IS NOT NULL)) AS kind
        FROM events
    ),
    timed AS (SELECT *, epoch_us(ts) // 10000 * 10 AS clock, (event_id + 65000) % 70000 AS number FROM kinds),
    archive AS (
        SELECT strftime(CASE WHEN kind = 0 THEN ts ELSE ts + INTERVAL 1 DAY END, '%Y%m%d') AS file,
            event_id * 4 + kind AS start, event_id * 4 + kind + 3 AS stop, length(props) + 83 AS total_bytes,
            number, number & 65535 AS number_lsb, number >> 16 AS number_msb,
            CASE WHEN event_id % 211 <> 0 THEN clock END AS ms, event_id % 211 <> 0 AS rtc_valid,
            CASE WHEN event_id % 211 <> 0 THEN strftime(make_timestamp(clock * 1000), '%Y-%m-%dT%H:%M:%S.%g') ELSE 'raw:' || (event_id % 7) END AS rtc_text,
            sha256('layout ' || (day(ts) // 4)) AS config,
            sha256(event_id || '|' || props || CASE WHEN kind = 2 THEN '|changed' ELSE '' END) AS digest
        FROM timed
    )"""
