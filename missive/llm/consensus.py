"""Problem 4: consensus labels of several reviewers, their agreement, and each reviewer's reliability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.ids import packed
from missive.session import Cut, table

# The labels of the contract; the last one stands alone.
LABELS = (
    "ACTION_REQUEST", "APPROVAL", "DEADLINE", "DEPARTMENTAL_INPUT", "FOLLOW_UP", "GENERAL_UPDATE", "MEETING",
    "REPORT_REQUEST", "NON_PROJECT",
)
N = len(LABELS)
ALONE = N - 1
#: Types of reviewers that share a confusion matrix.
COMMUNITIES = 5
#: Reviews that a reviewer's own counts weigh against its community's matrix.
STRENGTH = 20.0
ROUNDS, TOLERANCE = 40, 1e-3


def usable(reviews: DataFrame) -> DataFrame:
    """(source_id, user, mask) of reviews(source_id, user_id, annotation_json, status, revision).

    One row per source and reviewer: the highest submitted revision, if its JSON is whole and names a known label;
    mask has a bit per label of LABELS. Labels are read whatever their case, blanks, hyphens and underscores;
    unknown ones are left out. Users are compared without case and blanks. Drafts, null sources and null users
    don't count; of repeated rows with one revision the readable one counts, of two readable the larger mask.
    """
    said = F.try_variant_get(F.try_parse_json("annotation_json"), "$.labels", "array<string>")
    flat = F.transform(said, lambda x: F.upper(F.regexp_replace(x, r"[\s_\-]+", "")))
    mask = sum((F.when(F.array_contains(flat, name.replace("_", "")), 1 << k).otherwise(0) for k, name in enumerate(LABELS)), F.lit(0))
    rows = reviews.where(F.lower(F.btrim("status")) == "submitted").select("source_id", packed(F.col("user_id")).alias("user"), "revision", F.coalesce(mask, F.lit(0)).alias("mask"))
    last = rows.where("source_id is not null and user is not null").groupBy("source_id", "user").agg(F.max(F.struct("revision", "mask")).alias("last"))
    return last.select("source_id", "user", F.col("last.mask").alias("mask")).where("mask > 0")


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - sum(1 / (x + k) for k in range(6))


def _types_of(counts: np.ndarray, types: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The probability of each community, of users' counts (users, labels, truth, said)."""
    logs = np.log(types / types.sum(-1, keepdims=True))
    scores = np.log(shares) + np.einsum("ults,mlts->um", counts, logs)
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(-1, N, 2, 2)


def _sums(counts: DataFrame, types: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of each community, its users, the labels' expected numbers and all reviews: fixed in size."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COMMUNITIES * N * 4 + COMMUNITIES + N + 1)
        for b in batches:
            if len(b):
                c = _stack(b["counts"])
                r = _types_of(c, types, shares)
                total += np.concatenate([np.einsum("um,ults->mlts", r, c).ravel(), r.sum(0), c[:, :, 0].sum((0, 2)), [b["n_reviews"].sum()]])
        yield pd.DataFrame({"i": range(len(total)), "x": total})

    got = counts.select("counts", "n_reviews").mapInPandas(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    x = np.array([row["x"] for row in got]) if got else np.zeros(COMMUNITIES * N * 4 + COMMUNITIES + N + 1)
    k = COMMUNITIES * N * 4
    return x[:k].reshape(COMMUNITIES, N, 2, 2), x[k : k + COMMUNITIES], x[k + COMMUNITIES : -1], x[-1]


def _weights(counts: DataFrame, types: np.ndarray, shares: np.ndarray) -> DataFrame:
    """(user, w): expected log odds that a label applies, given that the user set it (N numbers) or didn't (N more).

    A user's Dirichlet parameters are its own counts and STRENGTH reviews spread as its communities' matrices say.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c = _stack(b["counts"])
                own = c + STRENGTH * np.einsum("um,mlts->ults", _types_of(c, types, shares), types / types.sum(-1, keepdims=True))
                logs = _digamma(own) - _digamma(own.sum(-1, keepdims=True))
                odds = logs[:, :, 0] - logs[:, :, 1]
                yield pd.DataFrame({"user": b["user"], "w": np.concatenate([odds[:, :, 0], odds[:, :, 1]], axis=1).tolist()})

    return counts.select("user", "counts").mapInPandas(part, "user string, w array<double>")


def _posterior(rows: DataFrame, prior: np.ndarray) -> DataFrame:
    """Adds q0..: the probability of each label of the source, of rows (source_id, mask, w)."""
    told = [f"sum(if(mask & {1 << k} > 0, w[{k}], w[{N + k}])) over (partition by source_id)" for k in range(N)]
    odds = np.log(prior / (1 - prior))
    return rows.selectExpr("source_id", "user", "mask", *[f"{s} + {float(o)!r}D as s{k}" for k, (s, o) in enumerate(zip(told, odds, strict=True))]).selectExpr(
        "source_id", "user", "mask", *[f"1 / (1 + exp(-greatest(-500, least(500, s{k})))) as q{k}" for k in range(N)]
    )


def _counts(rows: DataFrame) -> DataFrame:
    """(user, n_reviews, counts): expected hits, misses, false alarms and true rejections of each label."""
    sums = [f"sum(if({'' if said else 'not '}(mask & {1 << k} > 0), {q}, 0D))" for k in range(N) for q in (f"q{k}", f"1 - q{k}") for said in (1, 0)]
    return rows.groupBy("user").agg(F.expr("count(*) as n_reviews"), F.expr(f"array({', '.join(sums)}) as counts"))


def infer(reviews: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """Community confusion model over usable() reviews, by variational updates.

    Each reviewer belongs to one of COMMUNITIES types that share a confusion matrix per label; truth, types and
    matrices are updated in turn until no matrix entry moves by TOLERANCE or more (ROUNDS at most). Returns the
    reviews with their sources' label probabilities q0.., and the reviewers (user, n_reviews, counts, types). Only
    the communities' matrices, of a fixed size, come to the driver. The sums of a source run over its distinct
    reviewers; a reviewer's counts are pre-aggregated before the shuffle. An empty table gives empty results.
    """
    reviews = cut.keep(reviews)
    votes = [f"(sum(if(mask & {1 << k} > 0, 1D, 0D)) over (partition by source_id) + 0.2D) / (count(*) over (partition by source_id) + 1D) as q{k}" for k in range(N)]
    posterior = reviews.selectExpr("source_id", "user", "mask", *votes)
    counts = cut.keep(_counts(posterior))
    # Communities begin as steps from random guessing to full agreement with the votes.
    step = np.linspace(0, 1, COMMUNITIES)[:, None] * np.ones(N)
    hit, alarm = 0.25 + 0.7 * step, 0.22 - 0.2 * step
    types, shares = np.stack([hit, 1 - hit, alarm, 1 - alarm], -1).reshape(COMMUNITIES, N, 2, 2), np.full(COMMUNITIES, 1 / COMMUNITIES)
    for _ in range(ROUNDS):
        found, members, applied, n = _sums(counts, types, shares)
        if not n:
            break
        before = types / types.sum(-1, keepdims=True)
        types = found + np.array([[2.0, 1.0], [0.5, 4.5]])
        shares = (members + 0.5) / (members.sum() + 0.5 * COMMUNITIES)
        prior = np.clip((applied + 1) / (n + 8), 0.01, 0.9)
        weights = cut.keep(_weights(counts, types, shares))
        posterior = _posterior(reviews.join(weights, "user"), prior)
        old, counts = counts, cut.keep(_counts(posterior))
        cut.drop(old)
        if np.abs(types / types.sum(-1, keepdims=True) - before).max() < TOLERANCE:
            break

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(types=_types_of(_stack(b["counts"]), types, shares).tolist())

    return posterior, counts.mapInPandas(label, "user string, n_reviews long, counts array<double>, types array<double>")


def consensus(posterior: DataFrame) -> DataFrame:
    """(source_id, n_reviewers, agreement, labels): the labels that apply to each source.

    A label applies if it is likelier than not; the one that stands alone does so where it is likelier than any
    other, and falls away otherwise. Where none is likelier than not, the likeliest applies. agreement is the share
    of pairs of reviewers who agree on a label, averaged over the labels that any of them set; null for one reviewer.
    """
    one = posterior.groupBy("source_id").agg(
        F.count("*").alias("n"), *[F.max(f"q{k}").alias(f"q{k}") for k in range(N)],
        *[F.sum((F.col("mask").bitwiseAND(1 << k) > 0).cast("int")).alias(f"v{k}") for k in range(N)],
    )
    q, n = [F.col(f"q{k}") for k in range(N)], F.col("n")
    best = F.greatest(*q)
    others = [F.when((q[k] > 0.5) | (q[k] == F.greatest(*q[:ALONE])), F.when((q[k] > 0.5) | (best <= 0.5), F.lit(LABELS[k]))) for k in range(ALONE)]
    labels = F.when(q[ALONE] == best, F.array(F.lit(LABELS[ALONE]))).otherwise(F.array_compact(F.array(*others)))
    pairs = [F.when(F.col(f"v{k}") > 0, (F.col(f"v{k}") * (F.col(f"v{k}") - 1) + (n - F.col(f"v{k}")) * (n - F.col(f"v{k}") - 1)) / (n * (n - 1))) for k in range(N)]
    same = F.array_compact(F.array(*pairs))
    agreement = F.when(n > 1, F.aggregate(same, F.lit(0.0), lambda x, y: x + y) / F.size(same))
    return one.select("source_id", n.alias("n_reviewers"), agreement.alias("agreement"), labels.alias("labels"))


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return infer(usable(table(spark, sf_dir, "direct_label_reviews")), Cut(spark))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per label that applies to a source with two or more usable reviewers: source_id, label."""
    found = consensus(_run(spark, sf_dir)[0]).where("n_reviewers > 1")
    return found.select("source_id", F.explode("labels").alias("label"))


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the reviewers of each source agree."""
    return consensus(_run(spark, sf_dir)[0]).select("source_id", "n_reviewers", "agreement")


def p4_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reviewer's reliability: hit rate less false-alarm rate over all labels, and its likeliest community."""
    users = _run(spark, sf_dir)[1]
    total = [F.expr(f"aggregate(sequence(0, {N - 1}), 0D, (x, k) -> x + counts[4 * k + {i}])") for i in range(4)]
    hits, alarms = total[0] / (total[0] + total[1]), total[2] / (total[2] + total[3])
    community = F.array_position("types", F.array_max("types")) - 1
    return users.select("user", "n_reviews", hits.alias("hit_rate"), alarms.alias("false_alarm_rate"), (hits - alarms).alias("reliability"), community.alias("community"))


def oracle_sql() -> dict[str, str]:
    return {}
