"""Root facts from whatever Spark reads: files, tables, databases, streams."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.compiler import root_facts


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column that tells its rows apart, equal ones too: (hash of the row, which of its copies)."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    row = df.withColumn(name, F.xxhash64(*columns))
    copy = F.row_number().over(Window.partitionBy(name).orderBy(name)).cast("long")
    return row.withColumn(name, F.struct(F.col(name).alias("row"), copy.alias("copy")))


def read_facts(spark: SparkSession, path: str, seq: str | None = None, key: str | None = None, value: Column | None = None, format: str = "parquet", schema: str | T.StructType | None = None, **options: Any) -> DataFrame:
    """Root facts of a file source. Without a seq column the order, and the id, is the place of the row: (hash of the
    file's path, row in it) for Parquet, which costs nothing; for other formats the rows are numbered by numbered()."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if seq is not None:
        return root_facts(df, seq, key, value)
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)) if value is None else value
    place = "__place"
    while place in df.columns:
        place += "_"
    if format == "parquet":
        df = df.withColumn(place, F.struct(F.xxhash64("_metadata.file_path").alias("row"), F.col("_metadata.row_index").alias("copy")))
    else:
        df = numbered(df, place)
    return root_facts(df, place, key, whole)


def table_facts(spark: SparkSession, name: str, seq: str, key: str | None = None) -> DataFrame:
    """Root facts of a catalog table or view."""
    return root_facts(spark.table(name), seq, key)


def jdbc_facts(spark: SparkSession, url: str, table: str, seq: str, key: str | None = None, partitions: int = 8, low: int = 0, high: int = 1 << 31, **options: str) -> DataFrame:
    """Root facts of a database table, read in ranges of seq by several tasks."""
    df = spark.read.jdbc(url, table, column=seq, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options)
    return root_facts(df, seq, key)


def value_facts(spark: SparkSession, values: list[Any], schema: str) -> DataFrame:
    """Root facts of a few values at hand, in their order; schema is the type of one."""
    rows = spark.createDataFrame(list(enumerate(values)), f"seq long, value {schema}")
    return root_facts(rows, "seq", value=F.col("value"))


def stream_facts(spark: SparkSession, path: str, schema: str | T.StructType, seq: str, key: str | None = None, format: str = "parquet", files_per_trigger: int | None = None, **options: Any) -> DataFrame:
    """Root facts of a growing folder; files_per_trigger bounds a micro-batch."""
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return root_facts(reader.load(path), seq, key)
