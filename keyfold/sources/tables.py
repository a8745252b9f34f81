"""Reading tables with the declared schema."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, types as T

from keyfold.model import TableSpec


def table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """One Parquet table of a data folder."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(os.path.join(folder, f"{name}.parquet"))


def scan(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Full scan with the current definition.

    Fields added since a file was written read as NULL and removed ones are pruned,
    so a definition changes without rewriting records.
    """
    return spark.read.schema(spec.schema()).parquet(path)
