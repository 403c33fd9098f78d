"""Problem 3: one group identifier for all records that links tie together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.ids import squeezed
from missive.operators.graph import components
from missive.session import Cut, table


def consolidate(records: DataFrame, links: DataFrame, cut: Cut) -> DataFrame:
    """(record_id, group_id, group_size) for every distinct record_id of records(record_id).

    links(left_id, right_id) count in both directions and once however often they stand; ids are compared without
    case and outer blanks. A link with an end that is null or that no record has ties nothing, as does a link of a
    record with itself. group_id is the smallest record_id of the group and group_size its number of records, 1 for
    a record that nothing is tied to. Null record ids are no records. Empty tables give an empty result.
    """
    rows = records.select("record_id", squeezed(F.col("record_id")).alias("key")).where("key is not null").distinct()
    rows = cut.keep(rows)
    nodes = cut.keep(rows.groupBy("key").agg(F.min("record_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    ends = nodes.select("key", "node")
    ties = links.select(squeezed(F.col("left_id")).alias("l"), squeezed(F.col("right_id")).alias("r")).where("l <> r").distinct()
    ties = ties.join(ends.select(F.col("key").alias("l"), F.col("node").alias("a")), "l").join(ends.select(F.col("key").alias("r"), F.col("node").alias("b")), "r")
    found = cut.keep(components(ties.select("a", "b"), cut))
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = named.groupBy("component").agg(F.min("first").alias("group_id"), F.count("*").alias("group_size"))
    grouped = named.join(groups, "component").select("key", "group_id", "group_size")
    return rows.join(grouped, "key").select("record_id", "group_id", "group_size")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(table(spark, sf_dir, "leakage_records"), table(spark, sf_dir, "leakage_links"), Cut(spark))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record in a group of two or more: record_id, group_id."""
    return _run(spark, sf_dir).where("group_size > 1").select("record_id", "group_id")


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups of each size there are, single records included."""
    groups = _run(spark, sf_dir).groupBy("group_id").agg(F.max("group_size").alias("group_size"))
    return groups.groupBy("group_size").agg(F.count("*").alias("n_groups"))


def oracle_sql() -> dict[str, str]:
    groups = """
    with recursive recs as (select record_id, lower(trim(record_id, e' \\t\\n\\r')) as k from (select distinct record_id from leakage_records)),
    ties as (select distinct lower(trim(left_id, e' \\t\\n\\r')) as l, lower(trim(right_id, e' \\t\\n\\r')) as r from leakage_links),
    edges as (select l, r from ties where l in (select k from recs) and r in (select k from recs) and l <> r),
    both_ways as (select l, r from edges union select r, l from edges),
    reach(k, o) as (select k, k from recs union select reach.k, both_ways.r from reach join both_ways on reach.o = both_ways.l),
    groups as (select reach.k, min(recs.record_id) as group_id, count(distinct reach.o) as group_size from reach join recs on recs.k = reach.o group by reach.k)
    """
    return {
        "p3_found": groups + "select recs.record_id, group_id from recs join groups using (k) where group_size > 1",
        "p3_group_sizes": groups + ", one as (select group_id, max(group_size) as group_size from groups group by group_id) select group_size, count(*) as n_groups from one group by group_size",
    }
