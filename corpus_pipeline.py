"""The cleaning pipeline: five stages of training-data operators, each over all that the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import delete, shared_folder, table
from factloom.llm.decontamination import drop_contaminated
from factloom.llm.exact_dedup import drop_copies
from factloom.llm.mixing import mix
from factloom.llm.simhash import drop_near_copies
from factloom.llm.toxicity import drop_toxic


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark go; all others stay as they are."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as an index of the documents: what it takes of each, and the drawn runs of words in their
    output shards (first_word, n_words, passes, extra, shard, position). A document of which nothing is
    taken stays in the table with taken 0, so that the mix can be accounted for."""
    words, times = F.col("words"), F.col("passes") + F.col("extra")
    run = F.struct((F.col("block") * 128).cast("long").alias("first_word"), words.alias("n_words"), times.alias("times"), "shard", "position")
    drawn = F.when((times > 0) & (words > 0), run)
    by = mix(docs).groupBy("id", "source", "copy", "size", "source_size", "target")
    taken = by.agg(F.sum(words * times).cast("long").alias("taken"), F.array_sort(F.collect_list(drawn)).alias("draws"))
    return taken.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken", "draws")


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", decontaminated), ("mixing", mixed)]

#: SimHash and the toxicity model have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written as Parquet to the shared folder and read again; what
    a stage has read is deleted when its own rows are written. The last stage reads the last of these."""
    docs, top, last = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if last is not None:
            delete(spark, last)
        last = f"{top}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
