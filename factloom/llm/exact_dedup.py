"""Exact deduplication by a 128-bit content hash, with the bytes compared inside the groups.

Only DataFrame functions run here. A text's key is the MD5 (128 bits) of its normalised form. One
aggregation keyed by (hash, normalised text) compares the bytes: Spark's aggregation merges two rows
only when all key bytes agree, so a hash that comes out with more than one text is a collision. The
map side of that aggregation folds copies before anything is shuffled. All other steps move narrow rows
(id, hash, length); no step gathers a group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, one_of_each, whole, without_spaces


def _never_null(digest: Column) -> Column:
    """A digest is never null; when the planner knows, it does not compute it once more in a filter."""
    return F.coalesce(digest, F.expr("X''"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = without_spaces(column(text_col))
    return docs.select(
        column(id_col).alias("id"),
        F.char_length(F.coalesce(column(text_col), F.lit(""))).cast("long").alias("points"),
        norm.alias("norm"),
        _never_null(F.unhex(F.md5(norm.cast("binary")))).alias("hash"),
    )


def has_collisions(keyed: DataFrame) -> bool:
    """Whether two different texts have one hash: bytes compared over all rows."""
    texts = keyed.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("n"))
    return not texts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256; more may name points, the code
    points of the text.

    Texts are equal when they are identical after deleting spaces (common.SPACES). Of equal texts the
    row with most code points stays, then the smallest id; ids that are null come last. Rows that repeat
    both id and text are told apart by number, and exactly one row of a group is kept. A null text
    counts as empty. Columns of docs other than the two named are not looked at.
    """
    keyed = _keyed(docs, id_col, text_col)
    key = ["hash", "norm"] if has_collisions(keyed) else ["hash"]
    rows = (
        keyed.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
        .groupBy(*key, "sha", "id", "points")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    best = F.min(F.struct((-F.col("points")).alias("minus"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    # A hot group is first folded in 64 parts. Its rows then meet one row: with the hash computed anew the
    # groups come to the join through an exchange of their own, and so adaptive execution can split the hot rows.
    parts = rows.groupBy(*key, F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.sum("copies").alias("copies"), best.alias("best"))
    groups = parts.groupBy(*key).agg(F.sum("copies").alias("group_size"), F.min("best").alias("best"))
    groups = groups.withColumn("hash", F.expr("concat(hash, X'')"))
    each = rows.join(groups, key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.minus")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *more,
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all their columns.

    The kept (id, text hash, length) triples meet the documents in one join on all three, which no hot
    group can skew; of rows that repeat a kept row's id and text one is taken.
    """
    norm, points = without_spaces(column(text_col)).cast("binary"), F.char_length(F.coalesce(column(text_col), F.lit(""))).cast("long")
    groups = exact_groups(docs, id_col, text_col, "points").filter("kept")
    kept = groups.select(column(id_col).alias("id"), _never_null(F.unhex("text_sha256")).alias("sha"), "points")
    marked = docs.select(whole(docs, "row"), column(id_col).alias("id"), _never_null(F.unhex(F.sha2(norm, 256))).alias("sha"), points.alias("points"))
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.sha") == F.col("k.sha")) & (F.col("d.points") == F.col("k.points"))
    return one_of_each(marked.alias("d").join(kept.alias("k"), same, "left_semi"), ["id", "sha"], docs.columns)
