"""Readers of time series: delimited text with a detected profile, and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .delimited import read_delimited

TEXT, PARQUET = {"csv", "txt", "tsv"}, {"parquet"}


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` by its extension; formats without a reader here are an error, never guessed."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in PARQUET:
        return spark.read.parquet(path)
    if kind in TEXT:
        return read_delimited(spark, path)
    raise ValueError(f"no reader for .{kind} files")
