"""CSV sources: meter traces in two layouts, label matrices and diaries.

Everything is read as text and coerced, so a bad field is a null, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.signal import epoch_seconds
from ..operators.trace import merge_readings, regularise, shift_timezone


def text_csv(spark: SparkSession, paths: list[str], columns: tuple[str, ...] | None, header: bool) -> DataFrame:
    reader = spark.read.option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if columns and not header:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(paths)


def stamp(column: Column, fmt: str | None = None) -> Column:
    found = F.try_to_timestamp(column, F.lit(fmt)) if fmt else F.try_to_timestamp(column)
    return found.cast("timestamp_ntz")


def read_trace(spark: SparkSession, paths: list[str], config: Config) -> DataFrame:
    """A regular trace from one or many files: means per file, then over files; shifted, regularised."""
    if not paths:
        raise ValueError("no trace files are given")
    if config.layout not in ("paired_rows", "flat"):
        raise ValueError(f"unknown layout {config.layout!r}")
    header = config.has_header if config.has_header is not None else config.layout == "flat"
    raw = text_csv(spark, paths, config.columns, header)
    missing = {"timestamp", config.flow_column} - set(raw.columns)
    if missing:
        raise ValueError(f"the trace lacks the columns {sorted(missing)}")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), stamp(F.trim("timestamp"), config.time_format if config.layout == "paired_rows" else None).alias("ts"), F.trim(config.flow_column).try_cast("double").alias("flow"))
    merged = merge_readings(rows.filter("ts IS NOT NULL"), ["flow"], "file")
    return regularise(shift_timezone(merged, config.tz_shift_hours), config.period_s)


def read_trace_dir(spark: SparkSession, folder: str, config: Config, pattern: str = "*.csv") -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"{folder}/{pattern}")
    return read_trace(spark, sorted(str(x.getPath()) for x in found), config)


def read_label_matrix(spark: SparkSession, paths: list[str], trace: DataFrame, config: Config, date_column: str = "Date", time_column: str = "Time") -> DataFrame:
    """Long labels aligned on the trace; of repeated stamps the first row holds; absent fixtures and samples are 0."""
    raw = text_csv(spark, paths, None, True)
    raw = raw.drop(*[c for c in raw.columns if c.startswith("Unnamed") or c.startswith("_c")])
    found = [f for f in config.codes if f in raw.columns]
    if not found:
        raise ValueError("no column of the label matrix is a configured fixture")
    text = F.concat_ws(" ", date_column, time_column) if time_column in raw.columns else F.col(date_column)
    rows = raw.select(stamp(text).alias("ts"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("r"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in found))
    first = Window.partitionBy("ts").orderBy("f", "r")
    rows = rows.filter("ts IS NOT NULL").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "f", "r")
    aligned = trace.select("idx", "ts").join(rows, "ts", "left")
    for c in config.codes:
        aligned = aligned.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)) if c in found else F.lit(0.0))
    return aligned.unpivot(["idx", "ts"], config.codes, "fixture", "flow")


def outside_rows(matrix: DataFrame, trace: DataFrame) -> int:
    """How many stamped rows (``ts``) of a label matrix lie on no sample of the trace."""
    return matrix.filter("ts IS NOT NULL").join(trace.select("ts"), "ts", "left_anti").count()


def diary_times(diary: DataFrame, which: str, date_column: str = "date", fmt: str | None = None) -> Column:
    """Start or end stamp: a full stamp column, else the time column dated by the entry's date, else null."""
    if f"{which}_datetime" in diary.columns:
        return stamp(F.col(f"{which}_datetime"), fmt)
    if f"{which}_time" not in diary.columns:
        return F.lit(None).cast("timestamp_ntz")
    if date_column not in diary.columns:
        raise ValueError("a diary with times needs a date column")
    return stamp(F.concat_ws(" ", date_column, f"{which}_time"), fmt or "yyyy-MM-dd h:mm:ss a")


def resolve_diary(diary: DataFrame, config: Config, fmt: str | None = None) -> DataFrame:
    """entry, fixture, page, symbol, start, end, duration_known, excluded, start_idx, duration_s of entries with a start."""
    spark = diary.sparkSession
    out = {f.code for f in config.excluded}
    if "fixture" in diary.columns:
        named = diary.withColumn("page", F.lit(None).cast("string")).withColumn("symbol", F.lit(None).cast("string"))
        named = named.withColumn("excluded", F.col("fixture").isin(*out) if out else F.lit(False))
    elif {"page", "symbol"} <= set(diary.columns):
        rows = {(f.page, f.symbol): (f.code, False) for f in config.fixtures if f.page} | {(f.page, f.symbol): (f.code, True) for f in config.excluded if f.page}
        lookup = spark.createDataFrame([(p, s, c, x) for (p, s), (c, x) in rows.items()], "page string, symbol string, fixture string, excluded boolean")
        named = diary.withColumn("page", F.trim("page")).withColumn("symbol", F.trim("symbol")).join(F.broadcast(lookup), ["page", "symbol"], "left")
        named = named.withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    else:
        raise ValueError("a diary needs a fixture column or page and symbol")
    timed = named.withColumn("start", diary_times(diary, "start", fmt=fmt)).withColumn("end", diary_times(diary, "end", fmt=fmt)).filter("start IS NOT NULL")
    known = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    timed = timed.withColumn("duration_known", known).withColumn("start_idx", epoch_seconds("start")).withColumn("duration_s", F.when(known, epoch_seconds("end") - epoch_seconds("start")))
    order = Window.orderBy("start", "fixture", "page", "symbol", "end")  # a hand-kept diary is small
    return timed.withColumn("entry", (F.row_number().over(order) - 1).cast("long")).orderBy("entry").select("entry", "fixture", "page", "symbol", "start", "end", "duration_known", "excluded", "start_idx", "duration_s")


def read_diary(spark: SparkSession, path: str, config: Config) -> DataFrame:
    return resolve_diary(text_csv(spark, [path], None, True), config)
