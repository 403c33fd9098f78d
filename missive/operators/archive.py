"""The archive: merging later imports, and its threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: str, at: str, keep: dict[str, str | None]) -> DataFrame:
    """One row a key, as if its rows were imported in the order of ``at``: the last row replaces the ones before.

    A column of ``keep`` stays as first set: the earliest value other than its blank (given there; null always is one).
    Rows with a null key are left out; of rows at one time the largest counts as the last. The merge is an aggregation,
    so that a key with most of the rows is combined before the shuffle.
    """
    others = [c for c in rows.columns if c not in (key, *keep)]
    blank = {c: F.col(c).isNull() if v is None else F.col(c).isNull() | (F.col(c) == v) for c, v in keep.items()}
    firsts = [F.min_by(c, F.when(~b, F.struct(at, c))).alias(f"_first_{c}") for c, b in blank.items()]
    lasts = [F.max_by(c, F.struct(at, c)).alias(f"_last_{c}") for c in keep]
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *[c for c in others if c != at])).alias("_last"), *firsts, *lasts)
    return out.select(key, *[F.col(f"_last.{c}").alias(c) for c in others], *[F.coalesce(f"_first_{c}", f"_last_{c}").alias(c) for c in keep])


def thread_rollup(mails: DataFrame, thread: str) -> DataFrame:
    """(thread, first_import, last_import, n_mails, projects, first_id) of each thread that has a value."""
    return (
        mails.where(F.col(thread).isNotNull())
        .groupBy(thread)
        .agg(F.min("imported_at").alias("first_import"), F.max("imported_at").alias("last_import"), F.count("*").alias("n_mails"), F.array_sort(F.collect_set("project_or_list")).alias("projects"), F.min("source_id").alias("first_id"))
    )
