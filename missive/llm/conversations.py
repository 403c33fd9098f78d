"""Problem 5: conversations put together from mail rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.ids import bare
from missive.llm.authored import authored
from missive.llm.channels import address, channels, stated
from missive.operators.ordering import numbered, sessions
from missive.operators.timestamps import instants
from missive.session import Cut, table

#: Share of replies that come within the inactivity gap at which sessions are split.
WITHIN = 0.95


def conversations(mails: DataFrame, times: DataFrame, written: DataFrame | Callable[[DataFrame], DataFrame], cut: Cut, placed: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """(source_id, conversation_id, turn_no, speaker_no) of every mail of each kept conversation.

    mails(source_id, thread_id, message_id, in_reply_to, references_json, sender, imported_at), times(row_id,
    utc_micros) and written(source_id, n_own), or a function that gives it for the mails(source_id) it is asked about:
    those of conversations that all else lets stand. Rows are put in sessions by channel (channels()): a channel is one
    session however long it rests, since its ties are stated. A session is kept if two or more senders write in it,
    every mail has a sender, an instant and newly written text, and every in_reply_to names a mail of the table with
    an earlier instant. Turns are numbered by instant (ties by source_id), speakers by first appearance. Of rows with
    one source_id the first imported counts; null and empty ids tie nothing; empty tables give an empty result. placed
    is channels() of these mails, and told stated(), where they are known already.
    """
    told = stated(mails) if told is None else told
    placed = channels(told.select("source_id", "thread", "message", "named"), cut) if placed is None else placed
    at = times.select(F.col("row_id").alias("source_id"), F.col("utc_micros").alias("at"))
    one = cut.keep(told.join(at, "source_id", "left").join(placed, "source_id", "left").select("source_id", "channel", "message", "speaker", "at", "replies", "is_reply"))
    rows = one.where("channel is not null")
    known = one.where("message is not null").groupBy("message").agg(F.min("at").alias("said"))
    replies = rows.select("source_id", "at", F.explode("replies").alias("message")).join(known, "message", "left")
    late = replies.where("said is null or at is null or said >= at").select("source_id").distinct().withColumn("late", F.lit(True))
    sound = (F.col("speaker").isNotNull() & F.col("at").isNotNull() & F.col("late").isNull() & (~F.col("is_reply") | (F.size("replies") > 0))).alias("sound")
    judged = cut.keep(rows.join(late, "source_id", "left").select("source_id", "channel", "speaker", "at", sound))
    cut.drop(one)
    kept = judged.groupBy("channel").agg(F.min("sound").alias("ok"), F.min("speaker").alias("x"), F.max("speaker").alias("y"), F.min("source_id").alias("conversation_id")).where("ok and x <> y")
    open_ = cut.keep(judged.join(kept.select("channel", "conversation_id"), "channel").select("source_id", "conversation_id", "speaker", "at"))
    cut.drop(judged)
    written = written(open_.select("source_id")) if callable(written) else written
    said = open_.join(written.select("source_id", "n_own"), "source_id", "left")
    empty = said.where("coalesce(n_own, 0) = 0").select("conversation_id").distinct()
    turns = open_.join(empty, "conversation_id", "left_anti")
    turns = cut.keep(numbered(turns, ["conversation_id"], ["at", "source_id"], "turn_no", cut))
    cut.drop(open_)
    speakers = numbered(turns.groupBy("conversation_id", "speaker").agg(F.min("turn_no").alias("begin")), ["conversation_id"], ["begin"], "speaker_no", cut)
    return turns.join(speakers, ["conversation_id", "speaker"]).select("source_id", "conversation_id", "turn_no", "speaker_no")


def _times(mails: DataFrame, clocks: DataFrame, cut: Cut) -> DataFrame:
    rows = mails.select(F.lit("emails").alias("origin"), F.col("source_id").alias("row_id"), "source_name", F.col("sent_timestamp").alias("text"), bare(F.col("message_id")).alias("message_id"), F.unix_micros(F.col("imported_at").cast("timestamp")).alias("received"))
    found = instants(rows, clocks, cut)
    return cut.keep(found.groupBy("row_id").agg(F.min("utc_micros").alias("utc_micros")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mail of each kept conversation: source_id, conversation_id, turn_no, speaker_no."""
    cut, mails, clocks = Cut(spark), table(spark, sf_dir, "emails"), table(spark, sf_dir, "source_clocks")
    told = cut.keep(stated(mails))
    placed = channels(told.select("source_id", "thread", "message", "named"), cut)
    times = _times(mails, clocks, cut)

    def written(asked: DataFrame) -> DataFrame:
        cut.drop(told)
        return authored(mails, clocks, cut, placed, asked, times, bare=True)

    return conversations(mails, times, written, cut, placed, told)


def sessionized(mails: DataFrame, times: DataFrame, cut: Cut) -> DataFrame:
    """(source_id, participants, session_no, role) of mails by participants: split at a calibrated inactivity gap, with roles, without monologues.

    participants is a digest of the addresses in sender and recipients. Mails are sorted by instant and split at the
    WITHIN quantile of the delays between mails and the mails they reply to; where no mail replies to another nothing
    is split. A session's first sender opens it, its other senders answer; a session is
    kept if the opener is answered. Mails without
    an instant or a sender belong to no session. Of rows with one source_id the first imported counts.
    """
    people = F.array_sort(F.array_distinct(F.concat(F.array(address(F.col("sender"))), F.regexp_extract_all(F.lower(F.coalesce("recipients_json", F.lit(""))), F.lit(r"([\w.+'-]+@[\w-]+(?:\.[\w-]+)+)")))))
    fields = F.struct(bare(F.col("message_id")).alias("message"), bare(F.col("in_reply_to")).alias("parent"), address(F.col("sender")).alias("speaker"), F.sha2(F.concat_ws("|", people), 256).alias("participants"))
    rows = mails.where(address(F.col("sender")).isNotNull()).select("source_id", "imported_at", fields.alias("m")).groupBy("source_id").agg(F.min_by("m", F.struct("imported_at", F.xxhash64("m"))).alias("m")).select("source_id", "m.*")
    rows = cut.keep(rows.join(times.select(F.col("row_id").alias("source_id"), F.col("utc_micros").alias("at")), "source_id"))
    said = rows.groupBy("message").agg(F.min("at").alias("said"))
    delays = rows.join(said.withColumnRenamed("message", "parent"), "parent").where("at > said").select((F.col("at") - F.col("said")).alias("delay"))
    gap = delays.agg(F.percentile_approx("delay", WITHIN)).collect()[0][0]
    gap = (1 << 62) if gap is None else gap
    found = cut.keep(sessions(rows.select("source_id", "participants", "speaker", "at"), ["participants"], "at", ["source_id"], gap, "session_no", cut))
    kept = found.groupBy("participants", "session_no").agg(F.min_by("speaker", F.struct("at", "source_id")).alias("opener"), F.min("speaker").alias("x"), F.max("speaker").alias("y")).where("x <> y")
    role = F.when(F.col("speaker") == F.col("opener"), "opener").otherwise("respondent").alias("role")
    return found.join(kept, ["participants", "session_no"]).select("source_id", "participants", "session_no", role)


def p5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails in sessions by participants, with roles: source_id, participants, session_no, role (sessionized())."""
    cut, mails, clocks = Cut(spark), table(spark, sf_dir, "emails"), table(spark, sf_dir, "source_clocks")
    return sessionized(mails, _times(mails, clocks, cut), cut)
