"""Readers for line files, exports and line sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.plans.ordering import row_index, scan
from duskwatch.sources.parsers import parse, parse_jsonl, parse_txt


def read_logs(spark: SparkSession, path: str, log_type: str, mode: str = "PERMISSIVE", year: int = 2024) -> DataFrame:
    """Line files of one log type as typed rows."""
    return parse(spark.read.text(path).withColumnRenamed("value", "line"), log_type, mode, year)


def stream_logs(spark: SparkSession, folder: str, log_type: str, mode: str = "PERMISSIVE", year: int = 2024) -> DataFrame:
    """The same over a folder that keeps receiving files."""
    return parse(spark.readStream.text(folder).withColumnRenamed("value", "line"), log_type, mode, year)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV exports with header; ``ip`` and ``event`` stand for source_ip and event_type."""
    rows = spark.read.option("header", True).csv(path)
    have = set(rows.columns)

    def first(*names: str) -> Column:
        present = [F.nullif(F.col(n), F.lit("")) for n in names if n in have]
        return F.coalesce(*present, F.lit(""))

    return rows.select(
        first("timestamp").alias("timestamp"),
        first("ip", "source_ip").alias("source_ip"),
        first("event", "event_type").alias("event_type"),
        first("message").alias("message"),
        F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("raw_log"),
    )


_EXPORT = ["timestamp", "source_ip", "event_type", "message", "raw_log"]


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    return parse_txt(spark.read.text(path).withColumnRenamed("value", "line")).select(_EXPORT)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_jsonl(spark.read.text(path).withColumnRenamed("value", "line")).select(_EXPORT)


def parse_labelled(lines: DataFrame, column: str = "line") -> DataFrame:
    """``{text, label}`` records; without a single JSON line all lines become text with label 0.

    Raises when JSON records lack a field.
    """
    schema = "text STRING, label INT, _corrupt STRING"
    record = F.from_json(F.col(column), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    opened = lines.withColumn("_r", record)
    good = F.col("_r").isNotNull() & F.col("_r._corrupt").isNull()
    counts = opened.agg(
        F.count_if(good).alias("valid"),
        F.count_if(good & (F.col("_r.text").isNull() | F.col("_r.label").isNull())).alias("incomplete"),
    ).first()
    others = [c for c in lines.columns if c != column]
    if counts["valid"] == 0:
        return lines.select(*others, stripped(F.col(column)).alias("text"), F.lit(0).alias("label"))
    if counts["incomplete"]:
        raise ValueError(f"{counts['incomplete']} records lack text or label")
    return opened.filter(good).select(*others, F.col("_r.text").alias("text"), F.col("_r.label").alias("label"))


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def read_sequence(spark: SparkSession, path: str, keep_blank: bool = True) -> DataFrame:
    """Lines with their position: ``file, idx, line``.

    Files that are not valid UTF-8 throughout are read as Latin-1. The text
    source keeps the raw bytes, so files stay splittable and nothing leaves the
    JVM. The order is file, split offset, then reading order within the split.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_read"),
    )
    codecs = raw.groupBy("file").agg(F.min(F.is_valid_utf8("value")).alias("_utf8"))
    decoded = raw.join(codecs, "file").select(
        "file",
        "_start",
        "_read",
        stripped(
            F.when(F.col("_utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
        ).alias("line"),
    )
    if not keep_blank:
        decoded = decoded.filter(F.col("line") != "")
    return row_index(decoded, ["_start", "_read"], ["file"]).select("file", "idx", "line")


def non_blank(lines: DataFrame, column: str = "line") -> DataFrame:
    """Trimmed lines without the empty ones."""
    return lines.withColumn(column, stripped(F.col(column))).filter(F.col(column) != "")


def _read_time(text: Column, kind: Column) -> Column:
    patterns = dict(fixed.LINE_TIMESTAMPS)

    def found(name: str) -> Column:
        return F.regexp_extract(text, patterns[name], 1)

    def ntz(value: Column, fmt: str) -> Column:
        return F.try_to_timestamp(value, F.lit(fmt)).cast("timestamp_ntz")

    def utc(value: Column) -> Column:
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), value)

    iso = found("iso")
    zoned = iso.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    iso_value = F.when(zoned, utc(F.try_to_timestamp(iso).cast("timestamp_ntz"))).otherwise(
        F.try_to_timestamp(iso).cast("timestamp_ntz")
    )
    return (
        F.when(kind == "iso", iso_value)
        .when(kind == "standard", F.try_to_timestamp(found("standard")).cast("timestamp_ntz"))
        .when(kind == "bracketed", utc(ntz(found("bracketed"), "dd/MMM/yyyy:HH:mm:ss Z")))
        .when(kind == "slashes", ntz(found("slashes"), "yyyy/MM/dd"))
        .when(kind == "american", ntz(found("american"), "MMM dd, yyyy hh:mm:ss a"))
    )


def detect_timestamps(lines: DataFrame, fill: bool = True) -> DataFrame:
    """Add ``ts`` to ``(seq_id, idx, line)``, detecting the format of each sequence.

    The first of five patterns found in at least half of all its lines is
    used for the whole sequence. A sequence keeps null times when no pattern
    qualifies or when fewer than half of its lines can be read. Gaps take the
    last time before them, else the next one after.
    """
    counts = lines.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("line").rlike(p)).alias(f"_{name}") for name, p in fixed.LINE_TIMESTAMPS],
    )
    choice = F.coalesce(
        *[F.when(F.col(f"_{name}") >= F.col("_n") / 2, F.lit(name)) for name, _ in fixed.LINE_TIMESTAMPS]
    )
    voted = lines.join(counts.select("seq_id", choice.alias("_kind")), "seq_id", "left")
    read = voted.withColumn("ts", _read_time(F.col("line"), F.col("_kind"))).drop("_kind")
    enough = read.groupBy("seq_id").agg((F.count("ts") >= F.count(F.lit(1)) * 0.5).alias("_enough"))
    kept = read.join(enough, "seq_id").withColumn("ts", F.when(F.col("_enough"), F.col("ts"))).drop("_enough")
    return fill_times(kept) if fill else kept


def fill_times(rows: DataFrame, keys=("seq_id",), order: str = "idx", ts: str = "ts") -> DataFrame:
    """Fill null times from the last time before, else from the next time after."""
    keys = list(keys)
    forward = scan(rows, [order], keys, lasts={"_before": ts})
    backward = scan(forward.withColumn("_down", -F.col(order)), ["_down"], keys, lasts={"_after": ts})
    return backward.withColumn(ts, F.coalesce(ts, "_before", "_after")).drop("_before", "_after", "_down")
