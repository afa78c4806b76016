"""Queries for the operators over the given tables, each with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import byte_at, checksum16, counter24, counter_transition, encode_u16, primary_status, u16, u16_array
from .operators import boundaries as B
from .operators import cadence, files, recovery
from .sources.events import ARCHIVE_SQL, archive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parts of the SQL, by name; each may use those before it.
PARTS = {
    "archive": ARCHIVE_SQL,
    "steps": "steps AS (SELECT file, delta FROM (SELECT file, ms - lag(ms) OVER (PARTITION BY file ORDER BY start) AS delta FROM archive) WHERE delta > 0)",
    "medians": "medians AS (SELECT file, floor(median(delta))::BIGINT AS nominal_ms FROM steps GROUP BY file)",
    "nominal": """nominal AS (SELECT delta AS nominal_ms FROM (SELECT delta, count(*) AS n FROM steps GROUP BY delta)
        ORDER BY n DESC, abs(delta - (SELECT median(delta) FROM steps)), delta LIMIT 1)""",
    "facts": """facts AS (SELECT file, count(*) AS valid, arg_min(x, start) AS first, arg_max(x, start) AS last, any_value(nominal_ms) AS nominal_ms
        FROM (SELECT archive.file, start, {'number': number, 'number_lsb': number_lsb, 'number_msb': number_msb, 'ms': ms, 'rtc_text': rtc_text, 'config': config} AS x, nominal_ms
              FROM archive LEFT JOIN medians USING (file)) GROUP BY file)""",
    "placed": """placed AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN first.ms IS NULL THEN 1 ELSE 0 END, first.ms NULLS LAST,
        CASE WHEN first.ms IS NULL THEN first.rtc_text END, file) AS place FROM facts)""",
    "pairs": "pairs AS (SELECT a.place AS boundary, a.file AS a, b.file AS b FROM placed a JOIN placed b ON b.place = a.place + 1)",
    "kept": "kept AS (SELECT * FROM archive QUALIFY row_number() OVER (PARTITION BY digest ORDER BY ms NULLS LAST, file, start) = 1)",
    "gaps": """gaps AS (SELECT *, elapsed_ms - nominal_ms AS missing, round_even((elapsed_ms - nominal_ms) / nominal_ms, 0)::BIGINT AS estimated FROM (
        SELECT lag(rtc_text) OVER w AS before_rtc, rtc_text AS after_rtc, ms - lag(ms) OVER w AS elapsed_ms, lag(number) OVER w AS before_ensemble, number AS after_ensemble,
            lag(file) OVER w AS before_source, file AS after_source FROM kept WINDOW w AS (ORDER BY ms NULLS LAST, file, start)), nominal WHERE elapsed_ms > nominal_ms)""",
    "shared": """shared AS (SELECT boundary, count(*) AS n FROM archive JOIN pairs ON file = a
        WHERE EXISTS (SELECT 1 FROM archive o WHERE o.file = pairs.b AND o.digest = archive.digest) GROUP BY boundary)""",
    "clashes": """clashes AS (SELECT boundary, count(*) AS n FROM pairs JOIN archive x ON x.file = a JOIN archive y ON y.file = b AND y.rtc_text = x.rtc_text
        WHERE x.rtc_valid AND y.rtc_valid AND x.digest <> y.digest GROUP BY boundary)""",
    "edged": """edged AS (SELECT p.boundary, a.file AS previous_file, b.file AS next_file, a.last AS prev, b.first AS curr, coalesce(o.n, 0) AS duplicates, coalesce(c.n, 0) AS conflicts,
            b.first.ms - a.last.ms AS elapsed, least(a.valid, b.valid) AS smaller, list_sort(list_filter([a.nominal_ms, b.nominal_ms, (SELECT nominal_ms FROM nominal)], lambda v: v IS NOT NULL)) AS steps
        FROM pairs p JOIN placed a ON a.file = p.a JOIN placed b ON b.file = p.b LEFT JOIN shared o USING (boundary) LEFT JOIN clashes c USING (boundary))""",
    "bounded": """bounded AS (SELECT *, list_sort(list_transform(steps, lambda v: {'rare': -len(list_filter(steps, lambda w: w = v)), 'far': abs(v - list_aggregate(steps, 'median')), 'v': v}))[1].v AS nominal,
            prev.config = curr.config AS match, CASE
                WHEN prev.number_lsb = 65535 AND curr.number_lsb = 0 AND curr.number_msb = (prev.number_msb + 1) % 256 THEN 'counter_rollover'
                WHEN curr.number = prev.number + 1 THEN 'normal_increment'
                WHEN curr.ms > prev.ms AND curr.number < prev.number THEN 'counter_reset_to_' || curr.number
                WHEN curr.number < prev.number THEN 'backward_jump' WHEN curr.number > prev.number + 1 THEN 'forward_jump' ELSE 'nonstandard_transition' END AS counter FROM edged)""",
    "judged": """judged AS (SELECT *, CASE WHEN elapsed IS NOT NULL THEN greatest(0, elapsed - nominal) END AS missing, list_filter([
            CASE WHEN conflicts > 0 THEN 'CONFLICT' END, CASE WHEN NOT match THEN 'CONFIGURATION_CHANGE' END,
            CASE WHEN duplicates > 0 AND duplicates = smaller THEN 'EXACT_OVERLAP' END, CASE WHEN duplicates > 0 AND duplicates <> smaller THEN 'PARTIAL_OVERLAP' END,
            CASE WHEN elapsed > nominal AND NOT coalesce(abs(elapsed - nominal) <= 20 AND match, false) THEN 'GAP' END,
            CASE WHEN counter LIKE 'counter_reset%' OR counter = 'counter_rollover' THEN 'CLEAN_WITH_COUNTER_RESET' END,
            CASE WHEN abs(elapsed - nominal) <= 20 AND match THEN 'CLEAN_CONTIGUOUS' END], lambda f: f IS NOT NULL) AS facts FROM bounded)""",
}


def sql(select: str, *parts: str) -> str:
    """A query over the named parts and all before the last of them that it needs."""
    names = list(PARTS)
    last = max((names.index(p) for p in parts), default=0)
    return "WITH " + ", ".join(PARTS[n] for n in names[: last + 1]) + " " + select


def query(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


def placed(records: DataFrame) -> DataFrame:
    return files.chronological(files.record_facts(records))


def nominal(records: DataFrame) -> F.Column:
    return cadence.global_interval(records).scalar()


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.keep_first(archive(spark, sf_dir))


GAP_COLUMNS = ["before_rtc", "after_rtc", "elapsed_ms", "expected_interval_ms", "missing_acquisition_ms", "estimated_missing_ensembles", "before_ensemble", "after_ensemble", "before_source", "after_source", "location"]
LOCATION = "CASE WHEN before_source = after_source THEN 'within_file' ELSE 'file_boundary' END AS location"


@query("gap_detection", sql(f"SELECT before_rtc, after_rtc, elapsed_ms, nominal_ms AS expected_interval_ms, missing AS missing_acquisition_ms, estimated AS estimated_missing_ensembles, before_ensemble::BIGINT AS before_ensemble, after_ensemble::BIGINT AS after_ensemble, before_source, after_source, {LOCATION} FROM gaps", "gaps"))
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recovery.gaps(kept(spark, sf_dir), nominal(archive(spark, sf_dir)))
    return found.select(*GAP_COLUMNS).withColumns({c: F.col(c).cast("long") for c in ("before_ensemble", "after_ensemble")})


@query("gap_totals", sql("SELECT count(*) AS gaps, sum(missing)::BIGINT AS missing_ms, sum(estimated)::BIGINT AS estimated FROM gaps", "gaps"))
def gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recovery.gaps(kept(spark, sf_dir), nominal(archive(spark, sf_dir)))
    return found.agg(F.count("*").alias("gaps"), F.sum("missing_acquisition_ms").alias("missing_ms"), F.sum("estimated_missing_ensembles").alias("estimated"))


@query("gap_csv_projection", sql(f"SELECT before_rtc, after_rtc, printf('%.3f', elapsed_ms / 1000) AS elapsed_seconds, printf('%.3f', nominal_ms / 1000) AS expected_interval_seconds, printf('%.3f', missing / 1000) AS missing_acquisition_seconds, estimated AS estimated_missing_ensembles, before_ensemble::BIGINT AS before_ensemble, after_ensemble::BIGINT AS after_ensemble, before_source, after_source, {LOCATION} FROM gaps", "gaps"))
def gap_csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 11 columns of the gap report."""
    found = recovery.gap_seconds(recovery.gaps(kept(spark, sf_dir), nominal(archive(spark, sf_dir))))
    return found.withColumns({c: F.col(c).cast("long") for c in ("before_ensemble", "after_ensemble")})


@query("median_step", sql("SELECT * FROM medians", "medians"))
def median_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.median_steps(archive(spark, sf_dir))


@query("mode_interval", sql("SELECT * FROM nominal", "nominal"))
def mode_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.global_interval(archive(spark, sf_dir))


@query("choose_interval", sql("SELECT boundary, nominal FROM bounded", "bounded"))
def choose_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive(spark, sf_dir)
    pairs = files.adjacent(placed(rows)).withColumn("overall", nominal(rows))
    return pairs.select(F.col("boundary").cast("long").alias("boundary"), cadence.chosen_interval("a.nominal_ms", "b.nominal_ms", F.col("overall")).alias("nominal"))


@query("chronological_files", sql("SELECT file, place FROM placed", "placed"))
def chronological_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(archive(spark, sf_dir)).select("file", F.col("place").cast("long").alias("place"))


@query("file_inventory", sql("SELECT file, valid, first.number::BIGINT AS first_number, last.number::BIGINT AS last_number, first.rtc_text AS first_rtc, last.rtc_text AS last_rtc, first.config AS first_config, nominal_ms FROM facts", "facts"))
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.col("first"), F.col("last")
    return files.record_facts(archive(spark, sf_dir)).select(
        "file", "valid", first["number"].cast("long").alias("first_number"), last["number"].cast("long").alias("last_number"),
        first["rtc_text"].alias("first_rtc"), last["rtc_text"].alias("last_rtc"), first["config"].alias("first_config"), "nominal_ms",
    )


@query("config_histogram", sql("SELECT file, config, count(*) AS n FROM archive GROUP BY ALL", "archive"))
def config_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.config_histogram(archive(spark, sf_dir)).select("file", F.explode("configs").alias("config", "n"))


@query("counter_transitions", sql("""SELECT file, start, CASE WHEN p IS NULL THEN 'unknown'
        WHEN pl = 65535 AND number_lsb = 0 AND number_msb = (pm + 1) % 256 THEN 'counter_rollover' WHEN number = p + 1 THEN 'normal_increment'
        WHEN ms > pms AND number < p THEN 'counter_reset_to_' || number WHEN number < p THEN 'backward_jump' WHEN number > p + 1 THEN 'forward_jump' ELSE 'nonstandard_transition' END AS transition
    FROM (SELECT *, lag(number) OVER w AS p, lag(number_lsb) OVER w AS pl, lag(number_msb) OVER w AS pm, lag(ms) OVER w AS pms FROM archive WINDOW w AS (PARTITION BY file ORDER BY start))""", "archive"))
def counter_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.struct("number", "number_lsb", "number_msb", "rtc")
    before = F.lag(now).over(Window.partitionBy("file").orderBy("start"))
    return archive(spark, sf_dir).select("file", "start", counter_transition(before, now).alias("transition"))


@query("exact_overlap", sql("SELECT * FROM shared", "shared"))
def exact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive(spark, sf_dir)
    return B.exact_overlaps(rows, files.adjacent(placed(rows))).select(F.col("boundary").cast("long").alias("boundary"), "n")


@query("time_conflict", sql("SELECT * FROM clashes", "clashes"))
def time_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive(spark, sf_dir)
    return B.time_conflicts(rows, files.adjacent(placed(rows))).select(F.col("boundary").cast("long").alias("boundary"), "n")


@query("asof_last_complete", sql("SELECT p.file, p.start + 2 AS at, r.start AS before FROM archive p ASOF LEFT JOIN archive r ON r.file = p.file AND r.stop <= p.start + 2", "archive"))
def asof_last_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive(spark, sf_dir)
    return B.last_complete_before(rows, rows.select("file", (F.col("start") + 2).alias("at")))


@query("boundary_facts", sql("""SELECT boundary, previous_file, next_file, CASE WHEN len(facts) = 0 THEN 'AMBIGUOUS' ELSE facts[1] END AS primary_status,
        CASE WHEN len(facts) = 0 THEN 'AMBIGUOUS' ELSE array_to_string(facts, ';') END AS facts, elapsed AS elapsed_ms, nominal AS nominal_interval_ms, missing AS missing_acquisition_ms,
        round_even(missing / nominal, 0)::BIGINT AS estimated_missing_ensembles, counter AS counter_transition, match AS fixed_leader_match,
        duplicates AS exact_duplicate_overlap, conflicts AS conflicting_time_overlap FROM judged""", "judged"))
def boundary_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive(spark, sf_dir)
    found = B.boundaries(rows, placed(rows), nominal(rows))
    return found.select(
        F.col("boundary").cast("long").alias("boundary"), "previous_file", "next_file", "primary_status", F.array_join("facts", ";").alias("facts"), "elapsed_ms", "nominal_interval_ms",
        "missing_acquisition_ms", "estimated_missing_ensembles", "counter_transition", "fixed_leader_match", "exact_duplicate_overlap", "conflicting_time_overlap",
    )


STATUS_SETS = [["GAP", "CONFLICT"], ["UNRECOVERABLE_FRAGMENT", "CLEAN_CONTIGUOUS"], [], ["TRUNCATED_NEXT_FILE", "EXACT_OVERLAP", "CLEAN_WITH_COUNTER_RESET"], ["UNKNOWN"]]
FIRST_STATUS = ["CONFLICT", "CLEAN_CONTIGUOUS", "AMBIGUOUS", "EXACT_OVERLAP", "AMBIGUOUS"]


@query("primary_status", "SELECT event_type, ['" + "','".join(FIRST_STATUS) + "'][event_id % 5 + 1] AS status, count(*) AS n FROM events GROUP BY ALL")
def primary_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for s in STATUS_SETS])
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", primary_status(sets[F.col("event_id") % 5]).alias("status"))
    return rows.groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query("dedupe_first", sql("SELECT digest, file, start FROM kept", "kept"))
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("digest", "file", "start")


@query("conflict_rows", sql("SELECT file, start, rtc_text FROM kept QUALIFY row_number() OVER (PARTITION BY rtc_text ORDER BY ms NULLS LAST, file, start) > 1", "kept"))
def conflict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.conflicts(kept(spark, sf_dir)).select("file", "start", "rtc_text")


@query("provenance_map", sql("SELECT coalesce(sum(total_bytes) OVER (ORDER BY ms NULLS LAST, file, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS output_byte_offset, file, start, digest FROM kept", "kept"))
def provenance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.provenance(kept(spark, sf_dir)).select("output_byte_offset", "file", "start", "digest")


MAPPED = "mapped AS (SELECT coalesce(sum(total_bytes) OVER (ORDER BY ms NULLS LAST, file, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place, total_bytes, digest, start FROM kept)"


@query("provenance_verify", sql(f", {MAPPED} SELECT place, digest, 'missing in output' AS problem FROM mapped WHERE start % 1000 < 4 UNION ALL SELECT place, sha256(digest), 'not in map' FROM mapped WHERE start % 1000 < 4", "kept").replace(") ,", "),"))
def provenance_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = recovery.provenance(kept(spark, sf_dir))
    spoiled = F.when(F.col("start") % 1000 < 4, F.sha2(F.col("digest").cast("binary"), 256)).otherwise(F.col("digest"))
    output = mapped.select(F.col("output_byte_offset").alias("start"), "total_bytes", spoiled.alias("digest"))
    return recovery.verify_provenance(mapped, output).select("place", "digest", "problem")


@query("duplicate_hashes", sql("SELECT digest, count(*) AS n FROM archive GROUP BY digest HAVING count(*) > 1", "archive"))
def duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.duplicate_digests(archive(spark, sf_dir))


INDEXED = "SELECT file, start, row_number() OVER (PARTITION BY file ORDER BY start) AS physical_index, count(*) OVER (PARTITION BY file) AS total FROM archive"
INDEX_COLUMNS = ["file", "start", "CAST(physical_index AS BIGINT) AS physical_index"]


@query("slice_first", sql(f"SELECT file, start, physical_index FROM ({INDEXED}) WHERE physical_index > 20", "archive"))
def slice_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.physical_index(archive(spark, sf_dir)).where(~recovery.removed_by(first=20)).selectExpr(*INDEX_COLUMNS)


@query("slice_last", sql(f"SELECT file, start, physical_index FROM ({INDEXED}) WHERE physical_index <= total - 15", "archive"))
def slice_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.physical_index(archive(spark, sf_dir)).where(~recovery.removed_by(last=15)).selectExpr(*INDEX_COLUMNS)


@query("slice_range", sql(f"SELECT file, start, physical_index FROM ({INDEXED}) WHERE physical_index NOT BETWEEN 7 AND 31", "archive"))
def slice_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.physical_index(archive(spark, sf_dir)).where(~recovery.removed_by(between=(7, 31))).selectExpr(*INDEX_COLUMNS)


@query("retained_except", sql(f"SELECT file, start FROM archive EXCEPT SELECT file, start FROM ({INDEXED}) WHERE physical_index BETWEEN 7 AND 31", "archive"))
def retained_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recovery.physical_index(archive(spark, sf_dir))
    return rows.join(rows.where(recovery.removed_by(between=(7, 31))), ["file", "start"], "left_anti").select("file", "start")


@query("index_ranges_text", sql(f""", chosen AS (SELECT file, physical_index AS i FROM ({INDEXED}) JOIN (SELECT file, start FROM kept) USING (file, start)),
    runs AS (SELECT file, min(i) AS a, max(i) AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY file ORDER BY i) AS g FROM chosen) GROUP BY file, g)
    SELECT file, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM runs GROUP BY file""", "kept").replace(") ,", "),"))
def index_ranges_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each file's records that stay when copies go."""
    rows = archive(spark, sf_dir)
    return recovery.index_ranges(recovery.physical_index(rows).join(recovery.keep_first(rows).select("file", "start"), ["file", "start"], "left_semi"))


# Regions laid out from events: a run of bytes for each event, kinds and reasons by its id.
REGION_SQL = """laid AS (
    SELECT strftime(ts, '%Y%m%d') AS file, event_id,
        CASE event_id % 7 WHEN 0 THEN 'VALID_ENSEMBLE' WHEN 1 THEN 'NON_PD0_DATA' WHEN 2 THEN 'NON_PD0_DATA' WHEN 3 THEN 'TRUNCATED_ENSEMBLE' WHEN 4 THEN 'TRUNCATED_ENSEMBLE' ELSE 'BAD_CHECKSUM' END AS classification,
        length(props) AS n FROM events),
  regions AS (SELECT file, classification, 'r' || (event_id % 7 > 4) AS reason, event_id,
        (sum(n) OVER (PARTITION BY file ORDER BY event_id) - n)::BIGINT AS start, (sum(n) OVER (PARTITION BY file ORDER BY event_id))::BIGINT AS stop, (sum(n) OVER (PARTITION BY file))::BIGINT AS size FROM laid)"""


def laid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 7
    day = Window.partitionBy("file")
    rows = events.select(
        F.date_format("ts", "yyyyMMdd").alias("file"), "event_id", F.length("props").cast("long").alias("n"),
        F.when(kind == 0, "VALID_ENSEMBLE").when(kind < 3, "NON_PD0_DATA").when(kind < 5, "TRUNCATED_ENSEMBLE").otherwise("BAD_CHECKSUM").alias("classification"),
        F.concat(F.lit("r"), (kind > 4).cast("string")).alias("reason"), (kind != 1).alias("is_candidate"),
    )
    rows = rows.withColumns({"end": F.sum("n").over(day.orderBy("event_id")), "size": F.sum("n").over(day)})
    return rows.withColumns({"start": F.col("end") - F.col("n"), "length": F.col("n")})


@query("merge_regions_islands", f"""WITH {REGION_SQL}, flagged AS (SELECT *, event_id % 7 <> 1 AS is_candidate, CASE WHEN event_id % 7 IN (3, 4) AND event_id % 3 > 0 THEN 83 END::BIGINT AS declared FROM regions),
    marked AS (SELECT *, CASE WHEN classification <> 'VALID_ENSEMBLE' AND start = lag(stop) OVER w AND classification = lag(classification) OVER w AND reason = lag(reason) OVER w
            AND is_candidate = lag(is_candidate) OVER w AND declared IS NOT DISTINCT FROM lag(declared) OVER w THEN 0 ELSE 1 END AS fresh FROM flagged WINDOW w AS (PARTITION BY file ORDER BY start, stop)),
    grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY start, stop) AS g FROM marked)
    SELECT file, classification, reason, is_candidate, declared, min(start) AS start, max(stop) AS "end" FROM grouped GROUP BY file, classification, reason, is_candidate, declared, g""")
def merge_regions_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = laid_regions(spark, sf_dir)
    declared = F.when((F.col("event_id") % 7).isin(3, 4) & (F.col("event_id") % 3 > 0), F.lit(83)).cast("long")
    return files.merge_regions(rows.withColumn("declared", declared))


@query("edge_fragments", f"""WITH {REGION_SQL}, bad AS (SELECT * FROM regions WHERE classification <> 'VALID_ENSEMBLE')
    SELECT file, 'leading' AS side, start, stop AS "end", classification FROM bad WHERE start = 0 QUALIFY row_number() OVER (PARTITION BY file ORDER BY classification <> 'TRUNCATED_ENSEMBLE', stop) = 1
    UNION ALL SELECT file, 'trailing', start, stop, classification FROM bad WHERE stop = size QUALIFY row_number() OVER (PARTITION BY file ORDER BY classification <> 'TRUNCATED_ENSEMBLE', start DESC) = 1""")
def edge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.edge_fragments(laid_regions(spark, sf_dir)).select("file", "side", "start", "end", "classification")


@query("region_inventory", f"""WITH {REGION_SQL}, ends AS (SELECT file, count(*) FILTER (classification = 'BAD_CHECKSUM') AS checksum_error_regions, count(*) FILTER (classification = 'NON_PD0_DATA') AS non_pd0_regions,
        count(*) FILTER (classification = 'TRUNCATED_ENSEMBLE') AS truncated_regions, sum(CASE WHEN classification <> 'VALID_ENSEMBLE' THEN stop - start ELSE 0 END)::BIGINT AS unparsed_bytes,
        arg_min({{'c': classification, 'r': reason, 'n': stop - start, 'e': stop}}, start) AS l, arg_max({{'c': classification, 'r': reason, 'n': stop - start}}, start) AS t,
        min(start) FILTER (classification = 'VALID_ENSEMBLE') AS v FROM regions GROUP BY file)
    SELECT file, checksum_error_regions, non_pd0_regions, truncated_regions, unparsed_bytes, CASE WHEN l.c = 'VALID_ENSEMBLE' THEN 0 ELSE l.n END::BIGINT AS leading_bytes,
        CASE WHEN l.c = 'VALID_ENSEMBLE' THEN 'NONE' ELSE l.c || ':' || l.r END AS leading_region, CASE WHEN t.c = 'VALID_ENSEMBLE' THEN 0 ELSE t.n END::BIGINT AS trailing_bytes,
        CASE WHEN t.c = 'VALID_ENSEMBLE' THEN 'NONE' ELSE t.c || ':' || t.r END AS trailing_region, CASE WHEN l.c = 'VALID_ENSEMBLE' THEN 0 ELSE coalesce(v, l.e) END::BIGINT AS prefix_limit FROM ends""")
def region_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.region_facts(laid_regions(spark, sf_dir)).drop("size")


FOLDERS = ["data/a", "data/output", "b/recovered_output/x", "b", "deep/output_multi/y/z", "out put"]
FOLDER_SQL = "(['" + "','".join(FOLDERS) + "'])[event_id % 6 + 1]"
PATH_SQL = f"'/' || {FOLDER_SQL} || '/' || CASE WHEN event_id % 5 = 0 THEN 'recovered.000' ELSE 'f' || (event_id % 11) || '.000' END"


def laid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id")
    name = F.when(at % 5 == 0, "recovered.000").otherwise(F.concat(F.lit("f"), (at % 11).cast("string"), F.lit(".000")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("/"), F.array(*map(F.lit, FOLDERS))[at % 6], F.lit("/"), name).alias("path")).distinct()


@query("path_exclusion", f"SELECT DISTINCT {PATH_SQL} AS path FROM events WHERE event_id % 6 IN (0, 3, 5) AND event_id % 5 <> 0 AND event_id % 6 <> 3")
def path_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid_paths(spark, sf_dir).where(~files.excluded_path(F.col("path"), output_dir="/b"))


@query("candidate_groups", f"""WITH p AS (SELECT DISTINCT {PATH_SQL} AS path, '/' || {FOLDER_SQL} AS parent FROM events),
    g AS (SELECT parent, string_agg(path, ' ' ORDER BY path) AS files FROM p GROUP BY parent) SELECT row_number() OVER (ORDER BY parent) AS group_id, files, 'directory_recursive_parent' AS basis FROM g""")
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.candidate_groups(laid_paths(spark, sf_dir), "directory_recursive_parent")
    return found.select(F.col("group_id").cast("long").alias("group_id"), F.array_join("files", " ").alias("files"), "basis")


@query("verdict", sql("""SELECT CASE WHEN (SELECT count(*) FROM (SELECT 1 FROM kept QUALIFY row_number() OVER (PARTITION BY rtc_text ORDER BY ms NULLS LAST, file, start) > 1)) > 0
        OR (SELECT count(*) FROM judged WHERE len(facts) = 0) > 0 THEN 'MANUAL_REVIEW_REQUIRED' WHEN (SELECT count(*) FROM gaps) > 0 THEN 'PASS_WITH_GAPS' ELSE 'PASS' END AS verdict""", "judged"))
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive(spark, sf_dir)
    mode = nominal(rows)
    some = lambda df: df.agg(F.count("*") > 0).scalar()
    own = recovery.keep_first(rows)
    ambiguous = B.boundaries(rows, placed(rows), mode).where("primary_status = 'AMBIGUOUS'")
    judged = recovery.verdict(some(recovery.conflicts(own)), some(ambiguous), F.lit(False), F.lit(False), some(recovery.gaps(own, mode)))
    return spark.range(1).select(judged.alias("verdict"))


@query("manifest_json", sql("""SELECT file, '{"file":"' || file || '","valid_ensembles":' || valid || ',"first_ensemble_number":' || first.number || ',"last_ensemble_number":' || last.number
        || ',"first_rtc":"' || first.rtc_text || '","last_rtc":"' || last.rtc_text || '"}' AS manifest FROM facts""", "facts"))
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.col("first"), F.col("last")
    return files.record_facts(archive(spark, sf_dir)).select("file", F.to_json(F.struct(
        "file", F.col("valid").alias("valid_ensembles"), first["number"].alias("first_ensemble_number"), last["number"].alias("last_ensemble_number"),
        first["rtc_text"].alias("first_rtc"), last["rtc_text"].alias("last_rtc"),
    )).alias("manifest"))


def with_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("props").cast("binary").alias("data"))


BYTE = "ascii(substr(props, {}, 1))"


@query("le_decode", f"SELECT event_id, ({BYTE.format(1)} + 256 * {BYTE.format(2)})::BIGINT AS head, array_to_string([{', '.join(BYTE.format(2 * i + 1) + ' + 256 * ' + BYTE.format(2 * i + 2) for i in range(3))}], ',') AS offsets, {BYTE.format(3)}::BIGINT AS third FROM events")
def le_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bytes(spark, sf_dir).select(
        "event_id", u16("data", 0).cast("long").alias("head"), F.array_join(u16_array("data", 0, F.lit(3)).cast("array<string>"), ",").alias("offsets"), byte_at("data", 2).cast("long").alias("third")
    )


@query("le_encode", "SELECT event_id, printf('%02x%02x', (event_id * 37 % 65536) & 255, (event_id * 37 % 65536) >> 8) AS encoded, ((event_id % 256) << 16 | (event_id * 37 % 65536))::BIGINT AS counter FROM events")
def le_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (F.col("event_id") * 37 % 65536).cast("int")
    return with_bytes(spark, sf_dir).select("event_id", F.lower(F.hex(encode_u16(value))).alias("encoded"), counter24(value, (F.col("event_id") % 256).cast("int")).cast("long").alias("counter"))


@query("checksum16", "SELECT event_id, (list_sum(list_transform(range(1, length(props) + 1), lambda i: ascii(substr(props, i, 1)))) % 65536)::BIGINT AS checksum FROM events")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bytes(spark, sf_dir).select("event_id", checksum16("data").cast("long").alias("checksum"))


@query("sha256_fingerprint", "SELECT event_id, sha256(props) AS digest, lower(hex(props)) AS bytes FROM events")
def sha256_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bytes(spark, sf_dir).select("event_id", F.sha2("data", 256).alias("digest"), F.lower(F.hex("data")).alias("bytes"))


CLOCK = ["event_id % 256", "event_id % 14", "event_id % 33", "event_id % 25", "event_id % 61", "event_id % 62", "event_id % 101"]


@query("rtc_decode", "WITH c AS (SELECT event_id, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(CLOCK)) + """ FROM events),
    y AS (SELECT *, CASE WHEN c0 > 50 THEN 1900 + c0 ELSE 2000 + c0 END AS year, CASE WHEN c3 <= 23 AND c4 <= 59 AND c5 <= 59 AND c6 <= 99 AND c1 BETWEEN 1 AND 12 AND c2 BETWEEN 1 AND 31
        THEN try_cast(printf('%04d-%02d-%02d', CASE WHEN c0 > 50 THEN 1900 + c0 ELSE 2000 + c0 END, c1, c2) AS DATE) END AS d FROM c)
    SELECT event_id, d IS NOT NULL AS rtc_valid, CASE WHEN d IS NOT NULL THEN printf('%04d-%02d-%02dT%02d:%02d:%02d.%03d', year, c1, c2, c3, c4, c5, c6 * 10)
        ELSE printf('raw:%02d-%02d-%02dT%02d:%02d:%02d.%02d', c0, c1, c2, c3, c4, c5, c6) END AS rtc_text FROM y""")
def rtc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import encode_u8, rtc_stamp, rtc_text

    clock = F.concat(*[encode_u8(F.expr(e).cast("int")) for e in CLOCK])
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", clock.alias("clock")).withColumn("rtc", rtc_stamp(F.col("clock")))
    return rows.select("event_id", F.col("rtc").isNotNull().alias("rtc_valid"), rtc_text(F.col("clock"), F.col("rtc")).alias("rtc_text"))


# Events as bytes. The SQL builds its own hex text, layouts written out.
HEX = "printf('%02x%02x', ({0}) & 255, ({0}) >> 8)"
LEADER_SQL = "'8000' || " + HEX.format("number & 65535") + " || printf('%02x%02x%02x%02x%02x%02x%02x', year(t) - 2000, month(t), day(t), hour(t), minute(t), second(t), (epoch_us(t) // 10000) % 100) || printf('%02x', number >> 16) || repeat('00', 9)"
SUM_SQL = "(list_sum(list_transform(range(0, length({0}) // 2), lambda i: ('0x' || substr({0}, (2 * i + 1)::INT, 2))::INT)) % 65536)::INT"
PLAIN_SQL = f"""stamped AS (SELECT event_id, user_id, strftime(ts, '%Y%m%d') AS file, (event_id + 65000) % 70000 AS number, make_timestamp(epoch_us(ts) // 10000 * 10000) AS t FROM events),
    bodies AS (SELECT *, '7f7f5100' || '0003' || '0c0034004900' || '0000' || repeat('0b', 38) || {LEADER_SQL} || '0100' || {HEX.format("event_id % 65536")} || {HEX.format("user_id % 65536")} || '0102' AS body FROM stamped),
    sums AS (SELECT *, {SUM_SQL.format("body")} AS total FROM bodies),
    plain AS (SELECT *, body || {HEX.format("total")} AS bytes, strftime(t, '%Y-%m-%dT%H:%M:%S.%g') AS rtc_text FROM sums)"""


def stamped(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    from .functions import to_millis
    from .functions.encode import clock_bytes
    from .sources.events import at_millis

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.date_format("ts", "yyyyMMdd").alias("file"), ((to_millis("ts") / 10).cast("long") * 10).alias("ms"))
    # a small file is one split, but encoding is work
    events = events.orderBy("event_id") if ordered else events.repartition(spark.sparkContext.defaultParallelism)
    return events.select("event_id", "user_id", "file", "ms", ((F.col("event_id") + 65000) % 70000).cast("int").alias("number"), clock_bytes(at_millis(F.col("ms"))).alias("clock"))


def plain_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.encode import plain_record

    low = lambda c: encode_u16((F.col(c) % 65536).cast("int"))
    payload = F.concat(low("event_id"), low("user_id"), F.unhex(F.lit("0102")))
    return stamped(spark, sf_dir).withColumn("bytes", plain_record(F.col("number"), F.col("clock"), F.lit(11), payload))


@query("pd0_encode", f"WITH {PLAIN_SQL} SELECT event_id, sha256(unhex(bytes)) AS digest, (length(bytes) // 2)::BIGINT AS n FROM plain")
def pd0_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_bytes(spark, sf_dir).select("event_id", F.sha2("bytes", 256).alias("digest"), F.length("bytes").cast("long").alias("n"))


@query("scan_records", f"""WITH {PLAIN_SQL}, laid AS (SELECT *, event_id % 23 = 0 AS bad, 83 + CASE WHEN event_id % 10 = 0 THEN 5 ELSE 0 END AS n FROM plain),
    seated AS (SELECT *, (sum(n) OVER (PARTITION BY file ORDER BY event_id) - 83)::BIGINT AS start FROM laid)
    SELECT file, CASE WHEN bad THEN 'BAD_CHECKSUM' ELSE 'VALID_ENSEMBLE' END AS classification, start, start + CASE WHEN bad THEN 2 ELSE 83 END AS "end",
        CASE WHEN NOT bad THEN number END::BIGINT AS number, CASE WHEN NOT bad THEN rtc_text END AS rtc_text, CASE WHEN NOT bad THEN sha256(unhex(bytes)) END AS digest FROM seated""")
def scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of events, with noise before one in ten and a wrong checksum in one of 23, put together and scanned once."""
    from .sources import pd0
    from .sources.shared import keep

    noise = F.when(F.col("event_id") % 10 == 0, F.lit(b"noise")).otherwise(F.lit(b""))
    flipped = F.concat(F.expr("substring(bytes, 1, 81)"), encode_u16((u16("bytes", 81) + 1) % 65536))
    piece = F.concat(noise, F.when(F.col("event_id") % 23 == 0, flipped).otherwise(F.col("bytes")))
    laid = plain_bytes(spark, sf_dir).select("file", "event_id", piece.alias("piece"))
    content = laid.groupBy(F.col("file").alias("path")).agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY event_id)").alias("content"))
    scanned = keep(pd0.scan_contents(content, payloads=False), "scan")
    good = pd0.records(scanned).select("file", F.lit("VALID_ENSEMBLE").alias("classification"), "start", "end", F.col("number").cast("long").alias("number"), "rtc_text", "digest")
    bad = pd0.regions(scanned).where("classification = 'BAD_CHECKSUM'").select("file", "classification", "start", "end")
    return good.unionByName(bad, allowMissingColumns=True)


# (what is done to a record, what the parser says), by event_id: each of its tests, in their order's terms
SPOILED = [
    ("bytes", "VALID_ENSEMBLE"),
    ("concat(X'0000', substring(bytes, 3))", "NON_PD0_DATA: missing sync"),
    ("overlay(bytes PLACING X'0500' FROM 3)", "NON_PD0_DATA: implausible byte count 5"),
    ("substring(bytes, 1, 60)", "TRUNCATED_ENSEMBLE: declared 83 bytes beyond EOF"),
    ("overlay(bytes PLACING X'41' FROM 6)", "NON_PD0_DATA: implausible data type count 65"),
    ("overlay(bytes PLACING X'0d' FROM 7)", "POSSIBLE_FRAGMENT: first offset 13 != header length 12"),
    ("overlay(bytes PLACING X'34' FROM 11)", "POSSIBLE_FRAGMENT: data-type offsets not strictly increasing"),
    ("substring(bytes, 1, 5)", "TRUNCATED_ENSEMBLE: incomplete header"),
    ("overlay(bytes PLACING X'40' FROM 6)", "POSSIBLE_FRAGMENT: header length exceeds ensemble byte count"),
    ("overlay(bytes PLACING X'51' FROM 11)", "POSSIBLE_FRAGMENT: data-type offset beyond checksum coverage"),
    ("overlay(bytes PLACING X'01' FROM 13)", "POSSIBLE_FRAGMENT: missing fixed leader at first offset"),
    ("overlay(bytes PLACING X'81' FROM 53)", "POSSIBLE_FRAGMENT: missing variable leader at second offset"),
    ("overlay(overlay(bytes PLACING X'32' FROM 9) PLACING X'8000' FROM 51)", "POSSIBLE_FRAGMENT: short fixed leader length 38"),
    ("overlay(bytes PLACING X'45' FROM 11)", "POSSIBLE_FRAGMENT: short variable leader length 17"),
    ("overlay(bytes PLACING X'ffff' FROM 82)", "BAD_CHECKSUM: stored 0xffff"),
]


@query("parse_status_chain", "SELECT event_id::VARCHAR AS path, ['" + "','".join(s for _, s in SPOILED) + "'][event_id % " + str(len(SPOILED)) + " + 1] AS status FROM events")
def parse_status_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import pd0

    spoiled = F.expr(f"CASE event_id % {len(SPOILED)} " + " ".join(f"WHEN {i} THEN {how}" for i, (how, _) in enumerate(SPOILED)) + " END")
    each = plain_bytes(spark, sf_dir).select(F.col("event_id").cast("string").alias("path"), spoiled.alias("content"))
    found = pd0.regions(pd0.scan_contents(each, "strict", payloads=False)).where("start = 0")
    status = F.when(F.col("classification") == "VALID_ENSEMBLE", F.col("classification")).otherwise(F.concat_ws(": ", "classification", F.regexp_replace("reason", " != calculated .*$", "")))
    return found.select(F.col("file").alias("path"), status.alias("status"))


@query("split_reconstruction", f"""WITH {PLAIN_SQL}, days AS (SELECT file, row_number() OVER (ORDER BY file) AS place, count(*) AS n FROM plain GROUP BY file),
    cuts AS (SELECT d.place AS boundary, d.file AS previous_file, lead(d.file) OVER (ORDER BY d.place) AS next_file, 83 * d.n + CASE WHEN d.place > 1 THEN 12 ELSE 0 END AS previous_offset FROM days d)
    SELECT boundary, previous_file, next_file, previous_offset::BIGINT AS previous_offset, 71::BIGINT AS previous_available_bytes, 12::BIGINT AS next_consumed_bytes,
        CASE WHEN boundary % 5 = 0 THEN 'REJECTED' ELSE 'SAFE_RECONSTRUCTION' END AS status FROM cuts WHERE next_file IS NOT NULL""")
def split_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day files, each of which ends with a record whose last twelve bytes begin the next; every fifth is spoiled."""
    from .functions.encode import plain_record
    from .operators import splits
    from .sources import pd0
    from .sources.shared import keep

    rows = plain_bytes(spark, sf_dir)
    days = rows.groupBy("file").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY event_id)").alias("body"), F.max_by("clock", "event_id").alias("clock"), F.max("number").alias("number"))
    order = Window.orderBy("file")  # one row for each file
    days = days.withColumn("place", F.row_number().over(order)).withColumn("cut", plain_record(F.col("number") + 1, F.col("clock"), F.lit(11), F.lit(bytes(range(6)))))
    tail = F.when(F.col("place") % 5 == 0, F.expr("overlay(cut PLACING X'55' FROM 60)")).otherwise(F.col("cut"))
    days = days.withColumn("tail", tail).withColumn("head", F.expr("substring(lag(tail) OVER (ORDER BY file), 72)"))
    contents = days.select(F.col("file").alias("path"), F.concat(F.coalesce("head", F.lit(b"")), "body", F.expr("substring(tail, 1, 71)")).alias("content"))
    contents = keep(contents, "contents")
    scanned = keep(pd0.scan_contents(contents, payloads=False), "scan")  # once, without bytes, for records and regions
    records, regions = pd0.records(scanned), pd0.regions(scanned)
    facts = files.chronological(files.record_facts(records).join(files.region_facts(regions), "file", "left"))
    found = splits.split_candidates(records, regions, contents, files.adjacent(facts))
    return found.select(
        F.col("boundary").cast("long").alias("boundary"), "previous_file", "next_file", "previous_offset", "previous_available_bytes", "next_consumed_bytes", "status"
    )


def pattern(k: int, n: int) -> str:
    return f"array_to_string(list_transform(range({n}), lambda i: printf('%02x', (event_id % 256 + {20 * k} + i) % 256)), '')"


def profile_sql(cells: int) -> str:
    """Hex of a standard profile of 4 beams, 8 m cells."""
    sizes = [40, 21, 2 + 8 * cells, *[2 + 4 * cells] * 3, 70]
    starts = [20 + sum(sizes[:i]) for i in range(7)]
    le = lambda v: v.to_bytes(2, "little").hex()
    head = "7f7f" + le(20 + sum(sizes)) + "0007" + "".join(map(le, starts))
    fixed = "0000" + "00" * 6 + f"04{cells:02x}" + "0000" + le(800) + "00" * 26
    blocks = " || ".join(f"'{i}' || {pattern(k, n)}" for k, (i, n) in enumerate([("0001", 8 * cells), ("0002", 4 * cells), ("0003", 4 * cells), ("0004", 4 * cells)]))
    return f"'{head}{fixed}' || {LEADER_SQL} || {blocks} || '0006' || {pattern(0, 68)}"


STAMPED_SQL = PLAIN_SQL.split(",\n    bodies")[0]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one file of standard profiles, as the scan gives them."""
    from .functions.encode import profile_record
    from .sources import pd0

    each = stamped(spark, sf_dir).select(F.col("event_id").cast("string").alias("path"), profile_record(F.col("number"), F.col("clock"), (F.col("event_id") % 256).cast("int")).alias("content"))
    return pd0.records(pd0.scan_contents(each, "strict")).withColumn("start", F.col("file").cast("long"))


@query("block_layout", """SELECT unnest(['0000','8000','0001','0002','0003','0004','0006']) AS id, unnest([20,60,81,115,133,151,169])::BIGINT AS "offset", unnest([40,21,34,18,18,18,70])::BIGINT AS length, (SELECT count(*) FROM events) AS n""")
def block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import bins

    rows = bins.blocks(profiles(spark, sf_dir)).select(F.explode("blocks").alias("b")).select("b.id", F.col("b.offset").cast("long").alias("offset"), F.col("b.length").cast("long").alias("length"))
    return rows.groupBy("id", "offset", "length").agg(F.count("*").alias("n"))


@query("layout_uniform", "SELECT 1::BIGINT AS layouts, 4::BIGINT AS beams, 4::BIGINT AS cells, 800::BIGINT AS cell_cm, count(*) AS records FROM events")
def layout_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import bins

    found = bins.layouts(profiles(spark, sf_dir))
    top = [F.max(c).cast("long").alias(c) for c in ("beams", "cells", "cell_cm")]
    return found.agg(F.count("*").alias("layouts"), *top, F.sum("records").alias("records"))


def trim_plan():  # noqa: ANN201
    from .operators.bins import TrimPlan

    return TrimPlan(("0000", "8000", "0001", "0002", "0003", "0004", "0006"), (20, 60, 81, 115, 133, 151, 169), (40, 21, 34, 18, 18, 18, 70), 4, 4, 800, 1, 0, 241)


@query("bin_trim", f"WITH {STAMPED_SQL}, bodies AS (SELECT event_id, {profile_sql(3)} AS body FROM stamped), sums AS (SELECT *, {SUM_SQL.format('body')} AS total FROM bodies) SELECT event_id AS start, sha256(unhex(body || {HEX.format('total')})) AS digest, (length(body) // 2 + 2)::BIGINT AS n FROM sums")
def bin_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import bins

    made = bins.trim_cells(profiles(spark, sf_dir), trim_plan())
    return made.select("start", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("n"))


@query("bin_trim_verify", "SELECT event_id AS physical_index, 'block 0002 changed' AS fault FROM events WHERE event_id % 50 = 7")
def bin_trim_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed records checked against their sources, one in fifty spoiled in its second block of cells."""
    from .operators import bins
    from .sources import pd0

    source = profiles(spark, sf_dir)
    spoiled = F.when(F.col("start") % 50 == 7, F.expr("overlay(payload PLACING unhex(lpad(hex((CAST(conv(hex(substring(payload, 115, 1)), 16, 10) AS INT) + 1) % 256), 2, '0')) FROM 115)")).otherwise(F.col("payload"))
    made = bins.trim_cells(source, trim_plan()).select(F.col("start").cast("string").alias("path"), spoiled.alias("content"))
    output = pd0.records(pd0.scan_contents(made, "framing"))
    indexed = lambda df: df.withColumn("physical_index", F.col("file").cast("long"))
    return bins.trim_faults(indexed(source), indexed(output), trim_plan())
