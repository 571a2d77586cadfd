"""Column trees that pandas leaves in the footer of Parquet files."""

from __future__ import annotations

import ast
import json

from pyspark.sql import SparkSession


def _path(label, depth: int) -> list[str] | None:
    if isinstance(label, str):
        try:
            label = ast.literal_eval(label)
        except (ValueError, SyntaxError):
            return None
    if not isinstance(label, (list, tuple)) or len(label) != depth:
        return None
    return [str(part) for part in label]


def column_paths(metadata: dict | None) -> dict[str, list[str]]:
    """Name of a stored column -> its path in a column index of two levels or more; columns without one are left out."""
    metadata = metadata or {}
    depth = len(metadata.get("column_indexes") or [])
    found = {c["field_name"]: _path(c.get("name"), depth) for c in metadata.get("columns") or [] if c.get("field_name")} if depth > 1 else {}
    return {name: path for name, path in found.items() if path}


def read_column_paths(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """``column_paths`` of the first Parquet file at ``path``, read through Spark's file systems: one footer, no rows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    first = sorted(spark.read.parquet(path).inputFiles())[0]
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(first))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
    try:
        text = reader.getFileMetaData().getKeyValueMetaData().get("pandas")
    finally:
        reader.close()
    return column_paths(json.loads(text)) if text else {}
