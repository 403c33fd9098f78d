"""Joins that Spark has no operator for: by time, one to one, by shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive.functions.ids import bare
from missive.operators.graph import components
from missive.session import Cut

#: Without effect since nearest_earlier() needs no list of values; kept for callers that set it.
MANY = 32


def star_edges(rows: DataFrame, key: str, by: str, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that tie the rows of rows(key, by) with one value of ``by`` to the first of them.

    Also returns (key, by, node) of the rows that share a value with another. No pairs within a value are made.
    """
    ids = cut.keep(rows.select(key).where(F.col(key).isNotNull()).distinct().withColumn("node", F.monotonically_increasing_id()))
    members = rows.select(key, by).where(F.col(by).isNotNull()).distinct().join(ids, key)
    hubs = members.groupBy(by).agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select(by, "hub")
    shared = cut.keep(members.join(hubs, by))
    return shared.select(F.col("node").alias("a"), F.col("hub").alias("b")), shared.select(key, by, "node")


def thread_ids(rows: DataFrame, key: str, names: str, cut: Cut) -> DataFrame:
    """(key, thread_id, n_members): rows tied by a name in rows(key, names array), whether or not a row bears it.

    thread_id is the start of the digest of the members' sorted keys, one a line. Null, blank and bracketed forms of a
    name count as in bare(). A row that nothing ties is a thread of its own. The members of one thread are gathered
    to be hashed, as its id is a digest of all of them.
    """
    each = rows.select(key, F.explode(names).alias("_n")).select(key, bare(F.col("_n")).alias("_name"))
    edges, members = star_edges(each, key, "_name", cut)
    found = cut.keep(components(edges, cut))
    placed = cut.keep(members.select(key, "node").distinct().join(found, "node").select(key, "component"))
    threads = placed.groupBy("component").agg(F.array_sort(F.collect_list(key)).alias("m"))
    threads = threads.select("component", F.substring(F.sha2(F.array_join("m", "\n"), 256), 1, 20).alias("thread_id"), F.size("m").alias("n_members"))
    tied = placed.join(threads, "component").select(key, "thread_id", "n_members")
    alone = rows.select(key).where(F.col(key).isNotNull()).distinct().join(tied, key, "left")
    return alone.select(key, F.coalesce("thread_id", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 20)).alias("thread_id"), F.coalesce("n_members", F.lit(1)).alias("n_members"))


def nearest_earlier(rows: DataFrame, key: str, by: list[str], unlike: str, at: str, gap: int) -> DataFrame:
    """(later_id, earlier_id): for each row the latest earlier one with equal ``by`` and another ``unlike``.

    It lies at ``at - gap`` or later and before ``at``; of rows at one time the smallest key counts. Time is cut into
    slices of ``gap``, and a row is put into its own slice and, as what came before, into the next, so that a group
    of most of the rows is many windows. Each row carries the row before its run of one ``unlike``: if the latest
    earlier row is of the own kind, the one before its run is the latest that is not. Null times, groups and values match
    nothing.
    """
    own = rows.select(key, *by, unlike, at, F.floor(F.col(at) / gap).alias("_slice")).where(" and ".join(f"`{c}` is not null" for c in (*by, unlike, at)))
    spread = own.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_part", F.col("_slice") + F.col("_copy"))
    order = W.partitionBy(*by, "_part").orderBy(at, F.desc(key))
    me = F.struct(F.col(at).alias("t"), (-F.col(key)).alias("k"), F.col(unlike).alias("u"))
    spread = spread.withColumn("_prior", F.lag(me).over(order))
    begins = F.col("_prior").isNull() | (F.col("_prior")["u"] != F.col(unlike))
    # Of the run's first row the prior, of its others that of the first: a null prior is kept as an empty mark.
    mark = F.when(begins, F.struct(F.col("_prior")["t"].alias("t"), F.col("_prior")["k"].alias("k")))
    spread = spread.withColumn("_before", F.last(mark, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    frame = W.partitionBy(*by, "_part").orderBy(at).rangeBetween(-gap, -1)
    seen = spread.withColumn("_top", F.max(F.struct(F.col(at).alias("t"), (-F.col(key)).alias("k"), F.col(unlike).alias("u"), F.col("_before").alias("b"))).over(frame)).where("_copy = 0")
    top = F.col("_top")
    found = F.when(top["u"] != F.col(unlike), top["k"]).when(top["b"]["t"] >= F.col(at) - gap, top["b"]["k"])
    return seen.select(F.col(key).alias("later_id"), (-found).alias("earlier_id")).where("earlier_id is not null")


def reciprocal_links(mails: DataFrame, gap: int) -> DataFrame:
    """(earlier_id, later_id) of mails(key, subject, sender, people, at, is_reply): pairs that answer each other and no one else.

    The later one is a reply with the same subject, at most ``gap`` after the earlier; each sender is among the
    people of the other, and they differ. A pair is given only if both its mails stand in no other such pair. The pairs of a
    common subject aren't made: mails are counted within a running frame on either side, in slices of ``gap``, so
    that a subject with most of the rows is many windows. Null subjects, senders and times pair nothing.
    """
    rows = mails.where("subject is not null and sender is not null and at is not null").select("key", "subject", "sender", F.array_distinct("people").alias("people"), "at", "is_reply")
    each = rows.select("key", "subject", "sender", F.explode("people").alias("other"), "at", "is_reply").where("other <> sender")
    sent = each.select("key", "subject", F.col("sender").alias("a"), F.col("other").alias("b"), "at", F.lit(False).alias("later"))
    replies = each.where("is_reply").select("key", "subject", F.col("other").alias("a"), F.col("sender").alias("b"), "at", F.lit(True).alias("later"))
    spread = sent.unionAll(replies).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.floor(F.col("at") / gap) + F.col("copy"))
    group = W.partitionBy("subject", "a", "b", "part").orderBy("at")
    back, on = group.rangeBetween(-gap, -1), group.rangeBetween(1, gap)
    counted = spread.select(
        "key", "later", "copy", F.sum((~F.col("later")).cast("long")).over(back).alias("before"), F.max(F.when(~F.col("later"), F.col("key"))).over(back).alias("one"), F.sum(F.col("later").cast("long")).over(on).alias("behind")
    )
    n = F.when(F.col("later") & (F.col("copy") == 0), F.col("before")).when(~F.col("later") & (F.col("copy") == 1), F.col("behind"))
    met = counted.withColumn("n", n).where("n > 0")
    degree = met.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.when(F.col("later"), F.col("one"))).alias("one")).where("n = 1")
    return degree.where("one is not null").select(F.col("key").alias("later_id"), F.col("one").alias("earlier_id")).join(degree.select(F.col("key").alias("earlier_id")), "earlier_id", "left_semi")


def one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose both ends stand in no other pair; repeated pairs count as several."""
    ends = pairs.select(F.col(a).alias("_id")).unionAll(pairs.select(b)).groupBy("_id").agg(F.count("*").alias("_n")).where("_n = 1").select("_id")
    return pairs.join(ends, pairs[a] == ends["_id"], "left_semi").join(ends, pairs[b] == ends["_id"], "left_semi").select(a, b)
