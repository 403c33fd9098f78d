"""Mails tied by threads and by naming each other's messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions.ids import bare, message_ids, valued
from missive.operators.graph import components
from missive.session import Cut


def address(c: Column) -> Column:
    """The mail address in a sender in lower case, else the whole text; null if it stands for no value."""
    found = F.regexp_extract(F.lower(c), r"([\w.+'-]+@[\w-]+(?:\.[\w-]+)+)", 1)
    return F.coalesce(F.when(found != "", found), valued(c))


def channels(mails: DataFrame, cut: Cut) -> DataFrame:
    """(source_id, channel) of mails(source_id, thread, message, named): mails tied by a thread or by naming messages.

    Each thread and each named message is a hub tied to its mails once, so that no pairs within it are made. A mail
    that nothing ties to another has no channel.
    """
    nodes = cut.keep(mails.withColumn("node", F.monotonically_increasing_id()))
    hubs = nodes.where("thread is not null").groupBy("thread").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    by_thread = nodes.join(hubs, "thread").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    names = nodes.select("node", F.explode("named").alias("message")).distinct()
    owners = nodes.where("message is not null").select("message", F.col("node").alias("owner"))
    first = owners.groupBy("message").agg(F.min("owner").alias("hub"))
    namers = names.join(first, "message").select("message", "node", "hub")
    named = namers.groupBy("message").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    # Owners of one id are tied through a mail that names it, unless that is the owner itself and alone.
    same = owners.join(named, "message").where("low <> high or low <> owner").join(first, "message").select(F.col("owner").alias("a"), F.col("hub").alias("b"))
    edges = by_thread.unionAll(namers.select("node", "hub")).unionAll(same).where("a <> b")
    found = cut.keep(components(edges, cut))
    placed = cut.keep(nodes.join(found, "node").select("source_id", F.col("component").alias("channel")))
    cut.drop(nodes, found)
    return placed


def stated(mails: DataFrame) -> DataFrame:
    """(source_id, thread, message, replies, is_reply, named, speaker) of each source_id, of its first imported row."""
    fields = F.struct(
        valued(F.col("thread_id")).alias("thread"), bare(F.col("message_id")).alias("message"), message_ids(F.col("in_reply_to")).alias("replies"), valued(F.col("in_reply_to")).isNotNull().alias("is_reply"),
        F.array_union(message_ids(F.col("in_reply_to")), message_ids(F.col("references_json"))).alias("named"), address(F.col("sender")).alias("speaker"),
    )
    return mails.where("source_id is not null").select("source_id", "imported_at", fields.alias("m")).groupBy("source_id").agg(F.min_by("m", F.struct("imported_at", F.xxhash64("m"))).alias("m")).select("source_id", "m.*")


def tied(mails: DataFrame, cut: Cut) -> DataFrame:
    """channels() of mail rows: (source_id, channel) of every mail that thread_id, in_reply_to or references_json tie to another."""
    return channels(stated(mails).select("source_id", "thread", "message", "named"), cut)
