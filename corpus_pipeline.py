"""A training corpus in five stages, each applied to all that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``docs`` has the columns of ``documents``, and all stages
but the last return these. :func:`run` writes each stage's rows as Parquet in
the shared folder and reads them back for the next one. Null texts and ids,
repeated rows and empty tables follow the rules of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, near_join, packing, pii, toxicity
from tidemark.llm.common import load, staged
from tidemark.llm.queries import tokenizer_file

#: Shares of the mixture's words by domain, and its size against its input: with a size above 1 clean documents
#: come once or more, while junk is thinned out.
WEIGHTS = {"clean": 0.94, "junk": 0.05, "toxic": 0.01}
SCALE = 1.15


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, whatever its id."""
    return near_join.one_of_each_class(docs)


def remove_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data generalised."""
    return pii.sanitise(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    return mixing.mixed_rows(docs, load(spark, sf_dir, "labels"), WEIGHTS, SCALE)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, ids included."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_join", keep_one_of_near),
    ("pii", remove_private),
    ("mixing", mix_domains),
    ("packing", pack_windows),
]

#: SQL cannot express models, signatures and tokenizers; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
