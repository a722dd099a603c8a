"""Tables that are written once in a folder that all machines share, and joins that know nulls."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on the named columns, nulls equal to nulls; the left side's columns of these names stay."""
    names = {c: f"other:{c}" for c in on}
    right = right.withColumnsRenamed(names)
    test = left[f"`{on[0]}`"].eqNullSafe(right[f"`{names[on[0]]}`"])
    for c in on[1:]:
        test = test & left[f"`{c}`"].eqNullSafe(right[f"`{names[c]}`"])
    return left.join(right, test, how).drop(*names.values())


def written(df: DataFrame) -> DataFrame:
    """Evaluate df now, write it below spark.checkpoint.dir, and read it from there ever after."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return df.checkpoint(eager=True)
