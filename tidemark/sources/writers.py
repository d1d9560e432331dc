"""Sinks: simulated meter files and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired_lines(trace: DataFrame, period_s: float) -> DataFrame:
    """day, ord, value: two CSV lines a valid sample, the running volume (anew each day) on the first, the flow on the second."""
    valid = trace.filter("valid").withColumn("day", F.col("ts").cast("date"))
    total = F.sum("flow").over(Window.partitionBy("day").orderBy("idx")) * period_s / 60
    valid = valid.withColumn("total", total)
    stamp = F.date_format("ts", "yyyy-MM-dd hh:mm:ss a")
    first = F.concat(stamp, F.lit(",,,,"), F.format_string("%.4f", "total"))
    second = F.concat(stamp, F.lit(",63.0,292.0,"), F.format_string("%.4f", "flow"), F.lit(","))
    both = F.explode(F.array(F.struct(F.lit(0).alias("o"), first.alias("v")), F.struct(F.lit(1).alias("o"), second.alias("v"))))
    return valid.select("day", "idx", both.alias("l")).select("day", (F.col("idx") * 2 + F.col("l.o")).alias("ord"), F.col("l.v").alias("value"))


def write_paired(trace: DataFrame, folder: str, period_s: float = 1.0) -> None:
    """A folder per day of CRLF files without header; dropped samples have no lines."""
    lines = paired_lines(trace, period_s).repartition("day").sortWithinPartitions("day", "ord")
    lines.select("day", "value").write.mode("overwrite").option("lineSep", "\r\n").partitionBy("day").text(folder)


def write_events(events: DataFrame, folder: str) -> None:
    events.write.mode("overwrite").option("header", True).csv(folder)


def write_long(flows: DataFrame, folder: str) -> None:
    """Flows as Parquet by day, so that day filters prune."""
    flows.withColumn("day", F.col("ts").cast("date")).write.mode("overwrite").partitionBy("day").parquet(folder)
