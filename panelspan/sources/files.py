"""CSV, TSV and Parquet in; result tables out."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_SHAPE = r"^\d{4}[-/]\d{2}[-/]\d{2}"
DATE_SHARE = 0.8
SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".parquet": "parquet", ".pq": "parquet"}


def detect_format(path: str) -> str:
    """Format by suffix; a folder or pattern counts by its own name, then by the files in it."""
    clean = path.rstrip("/*")
    for candidate in (path, clean):
        kind = SUFFIXES.get(os.path.splitext(candidate)[1].lower())
        if kind:
            return kind
    return "unknown"


def sniff_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn text columns into timestamps when at least 80% of their values start like a date.

    The share comes from one aggregate over all text columns. Values that cannot be read become NULL.
    """
    texts = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    if not texts:
        return df
    shares = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), F.col(c).rlike(DATE_SHAPE).cast("double"))).alias(c) for c in texts]).first()
    dated = [c for c in texts if (shares[c] or 0.0) >= DATE_SHARE]
    return df.withColumns({c: F.try_to_timestamp(F.replace(F.col(c), F.lit("/"), F.lit("-"))) for c in dated})


def _read_text(spark: SparkSession, path, sep: str, schema, dates: bool, **options) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).options(**options)
    if schema is not None:
        return reader.schema(schema).csv(path)
    # Dates are left as text here, so that the rule of ``sniff_dates`` decides.
    df = reader.option("inferSchema", True).option("preferDate", False).option("timestampFormat", "'unused'").csv(path)
    return sniff_dates(df) if dates else df


def read_csv(spark: SparkSession, path, schema=None, sep: str = ",", dates: bool = True, **options) -> DataFrame:
    """CSV with header. Give a schema on large inputs: inferring types reads the files twice."""
    return _read_text(spark, path, sep, schema, dates, **options)


def read_tsv(spark: SparkSession, path, schema=None, dates: bool = True, **options) -> DataFrame:
    return _read_text(spark, path, "\t", schema, dates, **options)


def read_parquet(spark: SparkSession, path, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """By the file system that Spark reads the path from, also without a scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by suffix: .csv, .tsv, .tab, .parquet, .pq; files, folders and patterns."""
    if not _exists(spark, path):
        raise ValueError(f"nothing to read at {path}")
    kind = detect_format(path)
    if kind == "unknown":
        raise ValueError(f"no reader for '{os.path.splitext(path)[1].lower()}' files; there are readers for .csv, .tsv and .parquet")
    return {"csv": read_csv, "tsv": read_tsv, "parquet": read_parquet}[kind](spark, path, **options)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write a result table as parquet, json, csv or text lines. Maps and arrays become JSON text in CSV."""
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    if fmt == "text":
        df = df.orderBy("line_no").select("line").coalesce(1)      # a table of a few lines
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
