"""Helpers that the training-data operators share."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters of ``[\x20\x09-\x0D]``; exactly those that ``bytes.split()`` splits at.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named tables below sf_dir, through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame, name: str) -> Column:
    """All columns of df as one struct, so that no other column can clash with theirs; unpacked() undoes it."""
    return F.struct(*map(column, df.columns)).alias(name)


def unpacked(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The named columns of the struct that whole() made."""
    return df.select(*(F.col(name).getField(c).alias(c) for c in columns))


def one_of_each(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each value of the keys, null included, with the named columns of its struct `row`."""
    order = Window.partitionBy(*keys).orderBy(*keys)
    return unpacked(df.withColumn("turn", F.row_number().over(order)).filter("turn = 1"), "row", columns)


def kind_of(df: DataFrame, name: str) -> str:
    """A column's type in DDL."""
    return df.schema[name].dataType.simpleString()


def without_spaces(text: Column) -> Column:
    """The text with every character of SPACES deleted; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in SPACES:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one in local mode if none is set."""
    if (shared := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="factloom-checkpoint-")
    return shared.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: later jobs do not repeat
    its plan, and an executor that is lost takes nothing of it along."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stable(df: DataFrame) -> DataFrame:
    """df, written first unless it only reads files: its rows then come in the same order whenever a task runs."""
    nodes, open_ = set(), [df._jdf.queryExecution().optimizedPlan()]
    while open_:
        node = open_.pop()
        nodes.add(node.nodeName())
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return df if nodes <= {"Project", "Filter", "LogicalRelation"} and "LogicalRelation" in nodes else cut(df)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, null as empty."""
    for value in batch.column(column):
        yield value.as_py() or ""


def ship(sc: SparkContext, model: object) -> Broadcast[bytes]:
    """Broadcast a model of bounded size, its code included."""
    return sc.broadcast(cloudpickle.dumps(model))


def shipped(model: Broadcast[bytes]) -> object:
    """What ship() was given, on an executor: unpickled once for all tasks of a Python worker, and its pickled form
    is not kept beside it."""
    held = vars(model)
    if "_loaded" not in held:
        held["_loaded"] = pickle.loads(model.value)
        held.pop("_value", None)
    return held["_loaded"]
