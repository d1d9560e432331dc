"""Tables in the folder that driver and executors share: durable cuts of the lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; a local folder is made
    only where that setting is absent and all work is done in one process, as
    in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's settings while a table is written: shuffle files go when the execution that made them ends, and the text of
#: the plan, which is made anew at every adaptive step and kept for each execution, is short
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.ui.explainMode": "simple",
    "spark.sql.maxPlanStringLength": "2000",
}
#: Share of the driver's heap above which finished executions are let go at a write's end
HEAP_SHARE = 0.4


def release(spark: SparkSession, share: float = HEAP_SHARE) -> None:
    """Let the driver drop what finished executions hold.

    Broadcasts, shuffles and plans go only when the driver's garbage is
    collected; a driver with room left puts that off until its heap is full.
    """
    jvm = spark.sparkContext._jvm
    now = jvm.java.lang.Runtime.getRuntime()
    if now.totalMemory() > share * now.maxMemory():
        gc.collect()  # proxies of JVM objects in cycles
        jvm.java.lang.System.gc()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = work_path(spark, name)
    before = {key: spark.conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    release(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`staged` that no later plan reads."""
    path = getattr(df, "staged_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
