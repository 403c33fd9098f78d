"""Deterministic samples by hash order, and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive.functions.text import rank_key


def bottom_k(rows: DataFrame, by: list[str], key: str, k: int, seed: str) -> DataFrame:
    """The k rows of each group that come first in hash order, ties by key.

    Sixty-four salted parts of a group keep their own first k before the group's are chosen, so that no group is put
    in order as a whole.
    """
    r = rows.withColumn("_r", rank_key(seed, F.col(key))).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    part = W.partitionBy(*by, "_salt").orderBy("_r", key)
    kept = r.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k)
    return kept.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("_r", key))).where(F.col("_n") <= k).select(*rows.columns)


def largest_remainder(sizes: DataFrame, by: str, n: str, total: int) -> DataFrame:
    """(by, n, quota): ``total`` places in proportion to sizes, the rest by largest remainders, ties by name.

    sizes has a row a stratum; strata are put in one order, as the rule asks for.
    """
    whole = sizes.agg(F.sum(n).alias("_all"))
    q = sizes.join(F.broadcast(whole)).withColumn("_q", F.lit(float(total)) * F.col(n) / F.col("_all"))
    f = q.withColumn("_b", F.floor("_q")).withColumn("_r", F.round(F.col("_q") - F.col("_b"), 9))
    rest = f.agg((F.lit(total) - F.sum("_b")).alias("_left"))
    k = F.row_number().over(W.orderBy(F.desc("_r"), by))
    return f.withColumn("_k", k).join(F.broadcast(rest)).select(by, n, (F.col("_b") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0)).alias("quota"))


def stratified_quota(rows: DataFrame, by: str, key: str, total: int, seed: str) -> DataFrame:
    """``total`` rows in all, each stratum by its quota (largest_remainder()) in hash order."""
    quota = largest_remainder(rows.groupBy(by).agg(F.count("*").alias("_n")), by, "_n", total).select(by, "quota")
    first = bottom_k(rows, [by], key, total, seed)
    ranked = first.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(rank_key(seed, F.col(key)), key)))
    return ranked.join(quota, by).where("_k <= quota").select(*rows.columns)


def round_robin(rows: DataFrame, by: str, key: str, k: int, seed: str) -> DataFrame:
    """The first k rows when strata, in the order of their names, are asked in turn for their next in hash order."""
    first = bottom_k(rows, [by], key, k, seed)
    ranked = first.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(rank_key(seed, F.col(key)), key)))
    top = ranked.orderBy("_k", by).limit(k)
    return top.withColumn("place", F.row_number().over(W.orderBy("_k", by))).select(*rows.columns, "place")


def balanced_pick(rows: DataFrame, by: str, order: str, rank: str, key: str, count: int, prior: DataFrame | None = None) -> DataFrame:
    """The ``count`` rows when the next is always of the category that has fewest, its first left in order of rank.

    Categories count from what prior(by, taken) has; of equal ones the least ``order`` is asked. Each pick adds one, so a
    row's turn is its place in its category plus what that had before; no row beyond ``count`` of a category has one.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    kept = salted.withColumn("_n", F.row_number().over(W.partitionBy(by, "_salt").orderBy(rank, key))).where(F.col("_n") <= count)
    kept = kept.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(rank, key))).where(F.col("_n") <= count)
    taken = F.lit(0)
    if prior is not None:
        kept, taken = kept.join(prior.select(by, "taken"), by, "left"), F.coalesce("taken", F.lit(0))
    turn = kept.withColumn("_turn", taken + F.col("_n"))
    return turn.orderBy("_turn", order, rank, key).limit(count).select(*rows.columns)


def whole_groups(groups: DataFrame, size: str, order: list[str], target: int, all_of: str = "_all") -> DataFrame:
    """The groups, in order, whose predecessors hold fewer than ``target`` rows: the last may go beyond it.

    Only as many groups as rows are asked for can be taken, so no more are put in one order.
    """
    first = groups.orderBy(*order).limit(target)
    before = F.coalesce(F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn(all_of, before).where(F.col(all_of) < target).drop(all_of)
