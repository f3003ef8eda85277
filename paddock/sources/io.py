"""Readers and writers for the stages of the pipeline.

The raw panel arrives as CSV (read with an explicit schema, never inferred);
between stages everything is Parquet, the cleaned panel partitioned by split
so a split filter becomes partition pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_PANEL_SCHEMA = T.StructType([
    T.StructField("race_id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("horse", T.StringType()),
    T.StructField("sp", T.StringType()),
    T.StructField("pos", T.StringType()),
    T.StructField("comment", T.StringType()),
])


def read_raw_panel(spark: SparkSession, path: str, schema: T.StructType = RAW_PANEL_SCHEMA) -> DataFrame:
    """CSV scan, nothing inferred: every field is read as text under its header
    name, the declared columns are picked by name (other columns are pruned
    by the CSV parser) and cast to their declared types (bad values -> null)."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("multiLine", True).option("escape", '"').csv(path))
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    return raw.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
                        for f in schema.fields])


def write_panel(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Small result tables (coefficients, tests, strategy stats) as one CSV with header."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)
