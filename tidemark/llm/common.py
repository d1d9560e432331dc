"""Shared helpers: table access, staged tables in the shared folder, word rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import discard, remove, shared_dir, staged, work_path

__all__ = ["SPACE_CLASS", "arrow_rows", "discard", "fresh", "load", "remove", "shared_dir", "shielded", "staged", "words_of", "work_path"]

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of a batch that crosses to Python: texts are long, and a batch is held several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def shielded(df: DataFrame, prefix: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with other names for its columns that start with ``prefix``, and what gives a result the columns of ``df`` back."""
    own = [c for c in df.columns if c.lower().startswith(prefix)]
    moved = dict(zip(own, fresh(df, *(f"own_{i}" for i in range(len(own))))))
    columns = list(df.columns)
    return df.withColumnsRenamed(moved), lambda out: out.select(*(F.col(moved.get(c, c)).alias(c) for c in columns))


def words_of(text):
    """Column: the words of a text as an array (null and blank texts: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")
