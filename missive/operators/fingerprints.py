"""Fingerprints of subjects and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions.text import folded, squeezed, subject_of, words_of

# Shorter bodies only get short signatures, which tie nothing.
MIN_CHARS, MIN_TOKENS = 80, 12


def _hex(c: Column) -> Column:
    return F.sha2(c, 256)


def fingerprints(df: DataFrame, key: str, subject: str, body: str) -> DataFrame:
    """(key, body_exact, body_tokens, body_compact, subject_body, short_exact, short_tokens, n_chars, n_tokens, eligible).

    Bodies are compared in compatibility forms, case folded, without white space, by their words, and by their words run together, the last also
    with the subject. A body under MIN_CHARS or MIN_TOKENS has the short signatures only; an empty one has none.
    """
    df = df.select(key, folded(F.col(body)).alias("_f"), folded(F.col(subject)).alias("_g"))
    df = df.select(key, squeezed(F.col("_f")).alias("_b"), words_of(F.col("_f")).alias("_t"), subject_of(F.col("_g")).alias("_s"))
    df = df.select("*", (F.length("_b") >= MIN_CHARS).alias("_long"), F.array_join("_t", " ").alias("_j"), F.array_join("_t", "").alias("_c"))
    ok = F.col("_long") & (F.size("_t") >= MIN_TOKENS)
    return df.select(
        key, F.when(ok, _hex(F.col("_b"))).alias("body_exact"), F.when(ok, _hex(F.col("_j"))).alias("body_tokens"), F.when(ok, _hex(F.col("_c"))).alias("body_compact"),
        F.when(ok & (F.col("_s") != ""), _hex(F.concat_ws("\u0000", "_s", "_c"))).alias("subject_body"), F.when(~ok & (F.col("_b") != ""), _hex(F.col("_b"))).alias("short_exact"),
        F.when(~ok & (F.col("_j") != ""), _hex(F.col("_j"))).alias("short_tokens"), F.length("_b").alias("n_chars"), F.size("_t").alias("n_tokens"), ok.alias("eligible"),
    )
