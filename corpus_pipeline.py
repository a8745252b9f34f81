"""The corpus pipeline: stages over ``documents``, each reading all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``. A stage that
drops rows by a decision gives each a key of its own first, so rows without ``doc_id`` and rows
that repeat one are decided each on its own; what the decision needed is deleted before the stage ends. Columns
beside ``doc_id`` and ``text``, whatever their names, pass through all stages but the last. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import decontaminate, jaccard_join, packing, pii, queries, toxicity
from keyfold.llm._rows import keyed, without
from keyfold.llm._store import stored, working

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``TOXIC_FROM``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.below(docs, model, TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: that with the smallest ``doc_id``, a row without one last.

    Texts without words are in no group, so all of their rows stay.
    """
    rows, key = keyed(docs)
    with working(spark) as kept:
        gone = kept(jaccard_join.components(rows, key=key).where("not is_first").select(key), "gone")
    return without(rows, key, gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows, key = keyed(docs)
    with working(spark) as kept:
        found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
        gone = kept(found.where("contaminated").select(key), "gone")
    return without(rows, key, gone)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return pii.masked(docs, pii.train(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Models and tokens can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
