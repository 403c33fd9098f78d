"""Row numbers, predecessors and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive.session import Cut


def sorted_runs(df: DataFrame, keys: list[str], order: list[str], cut: Cut) -> DataFrame:
    """df sorted by keys and order over range partitions, with its run: _run (its partition) and _pos (its place there).

    The bounds are taken over keys and order together, so a group of most of the rows is spread over many runs. Nulls
    in keys form groups of their own and come first in an order.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    place = F.monotonically_increasing_id()
    return cut.keep(ranged.withColumn("_run", F.shiftright(place, 33).cast("int")).withColumn("_pos", place.bitwiseAND((1 << 33) - 1)))


def _with_run(rows: DataFrame, per_run: DataFrame, keys: list[str]) -> DataFrame:
    """rows, with the columns that per_run has for their group and run."""
    other = per_run.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_run").alias("_run2"), *[c for c in per_run.columns if c not in (*keys, "_run")])
    cond = F.col("_run") == F.col("_run2")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(other, cond).drop("_run2", *[f"_key{i}" for i in range(len(keys))])


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str, cut: Cut) -> DataFrame:
    """df with each row's number, from 1, in the order of its group; only a row per group and run is put in a window."""
    runs = sorted_runs(df, keys, order, cut)
    sizes = runs.groupBy(*keys, "_run").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_run")) - F.col("_n")).drop("_n")
    return _with_run(runs, before, keys).select(*df.columns, F.expr("_pos - _first + _before + 1").alias(into))


def sessions(df: DataFrame, keys: list[str], at: str, order: list[str], gap: int | Column, into: str, cut: Cut) -> DataFrame:
    """df with the number, from 1, of its session in its group: a new one begins after a gap of more than ``gap``.

    Rows with a null ``at`` belong to the first session. A run's first row is held against the end of the group's run
    before, and sessions are counted in runs and added up, so that no group is sorted in one task.
    """
    runs = sorted_runs(df, keys, [at, *order], cut)
    ends = runs.groupBy(*keys, "_run").agg(F.max(at).alias("_end"))
    ends = ends.withColumn("_came", F.max("_end").over(W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    joined = _with_run(runs, ends, keys)
    inner = W.partitionBy(*keys, "_run").orderBy("_pos")
    last = F.coalesce(F.lag(at).over(inner), F.col("_came"))
    starts = cut.keep(joined.withColumn("_new", F.coalesce((F.col(at) - last > gap).cast("int"), F.lit(0))))
    counts = starts.groupBy(*keys, "_run").agg(F.sum("_new").alias("_k"))
    before = counts.withColumn("_before", F.sum("_k").over(W.partitionBy(*keys).orderBy("_run")) - F.col("_k")).drop("_k")
    within = starts.withColumn("_in", F.sum("_new").over(inner))
    return _with_run(within, before, keys).select(*df.columns, F.expr("_in + _before + 1").alias(into))
