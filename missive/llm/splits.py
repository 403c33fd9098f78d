"""Problem 1: train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive.functions.ids import bare, packed, valued
from missive.operators.graph import components
from missive.session import Cut, table

#: Slices of the hash order; their totals (one row each) are the only thing that is put in order as a whole.
SLICES = 4096


def _best(rows: DataFrame, key: str) -> DataFrame:
    """The label each key keeps: an earlier one before any new, else the smallest."""
    return rows.groupBy(key).agg(F.min(F.when(F.col("old"), F.col("label"))).alias("_kept"), F.min("label").alias("_least"))


def _spread(adjacency: DataFrame, frontier: DataFrame, at: str, to: str, known: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of all searches at once, from the frontier's ``at`` to their ``to``.

    Returns what is known now, the newly reached, and the pairs of labels that met.
    """
    reached = adjacency.join(frontier, at).select(to, "label").distinct().withColumn("old", F.lit(False))
    reached = cut.keep(reached)
    rows = reached.unionAll(known.join(reached.select(to).distinct(), to, "left_semi").select(to, "label", F.lit(True).alias("old")))
    best = cut.keep(_best(rows, to))
    met = reached.join(best, to).select("label", F.coalesce("_kept", "_least").alias("other")).where("label <> other")
    met = met.select(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()
    fresh = best.where("_kept is null").select(to, F.col("_least").alias("label"))
    return known.unionAll(fresh), fresh, met


def related(records: DataFrame, ties: DataFrame, cut: Cut) -> DataFrame:
    """(record_id, component) for every distinct record_id of records; ties(record_id, key) share units by key.

    Breadth-first searches start at once from every record that comes first, in a random order, among all records
    it shares a key with, so that each component has a search and most records are reached in the first step. The
    frontier goes from records to their keys and on to the keys' records over hash-partitioned adjacency lists, where
    a key or record is expanded once. Where searches meet, the pair of their labels goes into a small graph, whose
    components are merged at the end. A key of a third of all rows is one label row joined to its adjacency, which
    adaptive execution splits; all minima are pre-aggregated. Null ids and keys, and keys of unknown records, tie
    nothing; repeated rows count once.
    """
    ids = records.select("record_id").where("record_id is not null").distinct()
    # xxhash64 of one long is a bijection: unique numbers in random order.
    ids = cut.keep(ids.withColumn("rec", F.xxhash64(F.monotonically_increasing_id())))
    ties = cut.keep(ties.select("record_id", F.col("key").alias("_key")).where("_key is not null").distinct().join(ids, "record_id").select("rec", "_key"))
    keys = ties.groupBy("_key").agg(F.min("rec").alias("first"), F.count("*").alias("n")).where("n > 1")
    keys = cut.keep(keys.withColumn("key", F.monotonically_increasing_id()))
    adjacency = cut.keep(ties.join(keys, "_key").select("rec", "key", "first"))
    seeds = adjacency.groupBy("rec").agg(F.min("first").alias("first")).where("rec = first").select("rec", F.col("rec").alias("label"))
    adjacency = adjacency.select("rec", "key")
    frontier = known = cut.keep(seeds)
    known_keys = keys.select("key", F.col("first").alias("label")).limit(0)
    met = None
    while not frontier.isEmpty():
        known_keys, fresh, pairs = _spread(adjacency, frontier, "rec", "key", known_keys, cut)
        met = pairs if met is None else met.unionAll(pairs)
        known, fresh, pairs = _spread(adjacency, fresh, "key", "rec", known, cut)
        met = met.unionAll(pairs)
        frontier = cut.keep(fresh)
    if met is not None:
        merged = cut.keep(components(met, cut)).select(F.col("node").alias("label"), "component")
        known = known.join(merged, "label", "left").select("rec", F.coalesce("component", "label").alias("component"))
    else:
        known = known.select("rec", F.col("label").alias("component"))
    return ids.join(known, "rec", "left").select("record_id", F.coalesce("component", "rec").alias("component"))


def units(found: DataFrame) -> DataFrame:
    """(record_id, component, unit_id, unit_size): the smallest record_id and the size of each component."""
    sizes = found.groupBy("component").agg(F.min("record_id").alias("unit_id"), F.count("*").alias("unit_size"))
    return found.join(sizes, "component")


def split(found: DataFrame, proportions: dict[str, float], cut: Cut) -> DataFrame:
    """(record_id, split): components in hash order fill the splits one after the other.

    A component goes where the middle of its stretch of the order falls, so no split is off by more than half a
    component at each of its borders. The order is cut into SLICES slices; only their totals are ordered as a whole.
    """
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    sizes = cut.keep(sizes.withColumn("place", F.xxhash64("component")).withColumn("slice", F.shiftright("place", 52) + SLICES // 2))
    totals = sizes.groupBy("slice").agg(F.sum("n").alias("total"))
    before = totals.withColumn("before", F.sum("total").over(W.orderBy("slice")) - F.col("total")).select("slice", "before")
    whole = totals.agg(F.sum("total").alias("whole"))
    inner = W.partitionBy("slice").orderBy("place", "component")
    placed = sizes.withColumn("inner", F.sum("n").over(inner) - F.col("n")).join(F.broadcast(before), "slice").join(F.broadcast(whole))
    middle = (F.col("before") + F.col("inner") + F.col("n") / 2) / F.col("whole")
    total, share, name = sum(proportions.values()), 0.0, None
    for part, p in proportions.items():
        share += p / total
        name = F.when(middle <= share, part) if name is None else name.when(middle <= share, part)
    placed = placed.select("component", name.otherwise(part).alias("split"))
    return found.join(placed, "component").select("record_id", "split")


def _found(spark: SparkSession, sf_dir: str, cut: Cut) -> DataFrame:
    records = table(spark, sf_dir, "identity_records")
    threads = records.select("record_id", F.concat(F.lit("t|"), packed(F.col("overlap_family")), F.lit("|"), bare(F.col("thread_id"))).alias("key"))
    groups = table(spark, sf_dir, "leakage_records").select("record_id", F.concat(F.lit("g|"), valued(F.col("leakage_group_id"))).alias("key"))
    return cut.keep(related(records, threads.unionAll(groups), cut))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record that shares a unit with another: record_id, unit_id."""
    return units(_found(spark, sf_dir, Cut(spark))).where("unit_size > 1").select("record_id", "unit_id")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record: 80 % train, 10 % validation, 10 % test."""
    cut = Cut(spark)
    return split(_found(spark, sf_dir, cut), {"train": 0.8, "validation": 0.1, "test": 0.1}, cut)


def oracle_sql() -> dict[str, str]:
    none = "('', '-', '--', '0', '?', 'n/a', 'na', 'n.a.', 'nan', 'nil', 'none', 'null', '(none)', '(null)', 'undefined', 'unknown', 'unspecified', 'und', 'tbd', 'xx', 'xxx')"
    return {
        "p1_found": f"""
    with recursive raw as (
      select record_id, 't|' || lower(replace(overlap_family, ' ', '')) || '|' || lower(trim(thread_id, e' \\t\\n\\r<>')) as k from identity_records
      where lower(trim(thread_id, e' \\t\\n\\r<>')) not in {none}
      union select record_id, 'g|' || lower(trim(leakage_group_id)) from leakage_records
      where lower(trim(leakage_group_id)) not in {none} and record_id in (select record_id from identity_records)),
    firsts as (select record_id, min(record_id) over (partition by k) as f from raw),
    pairs as (select distinct record_id as l, f as r from firsts where record_id <> f),
    both_ways as (select l, r from pairs union select r, l from pairs),
    reach(k, o) as (select l, l from both_ways union select reach.k, both_ways.r from reach join both_ways on reach.o = both_ways.l)
    select k as record_id, min(o) as unit_id from reach group by k""",
    }
