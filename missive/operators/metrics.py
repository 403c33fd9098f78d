"""Agreement and classification measures over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def label_scores(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of pairs(expected array, predicted array); ratios without cases are 0."""
    each = pairs.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.array_contains("expected", x).alias("e"), F.array_contains("predicted", x).alias("p")) for x in labels])).alias("c")).select("c.*")
    c = each.groupBy("label").agg(F.count_if(F.col("e") & F.col("p")).alias("tp"), F.count_if(~F.col("e") & F.col("p")).alias("fp"), F.count_if(F.col("e") & ~F.col("p")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("label", "tp", "fp", "fn", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def overall_scores(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """One row of micro and macro F1, subset accuracy, Hamming loss and mean Jaccard (two empty sets agree)."""
    per = label_scores(pairs, labels).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro"))
    known = F.array(*map(F.lit, labels))
    e, p = F.array_intersect(known, "expected"), F.array_intersect(known, "predicted")
    both, either = F.size(F.array_intersect(e, p)), F.size(F.array_union(e, p))
    rows = pairs.select(both.alias("b"), either.alias("u")).agg(F.count("*").alias("n"), F.avg((F.col("b") == F.col("u")).cast("double")).alias("same"), F.avg((F.col("u") - F.col("b")) / len(labels)).alias("apart"), F.avg(F.when(F.col("u") == 0, 1.0).otherwise(F.col("b") / F.col("u"))).alias("j"))
    return per.join(F.broadcast(rows)).select("n", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("micro_f1"), F.round("macro", 6).alias("macro_f1"), F.round("same", 6).alias("subset_accuracy"), F.round("apart", 6).alias("hamming_loss"), F.round("j", 6).alias("mean_jaccard"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) of two raters; kappa is null where chance agreement is whole. Null ratings don't count."""
    p = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = p.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("x")), cells.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "c").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    j = total.join(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("o"), (F.col("xy") / (F.col("n") * F.col("n"))).alias("e"))
    return j.select("n", F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(F.when(F.col("e") < 1, (F.col("o") - F.col("e")) / (1 - F.col("e"))), 6).alias("kappa"))


def fleiss(counts: DataFrame, item: str, category: str, n: str) -> DataFrame:
    """(n_items, kappa) of counts(item, category, n) where every item has the same number of ratings, two or more."""
    per = counts.groupBy(item).agg(F.sum(n).alias("r"), F.sum(F.col(n) * (F.col(n) - 1)).alias("pairs"))
    total = per.agg(F.count("*").alias("n_items"), F.sum("r").alias("all"), F.avg(F.col("pairs") / (F.col("r") * (F.col("r") - 1))).alias("o"))
    shares = counts.groupBy(category).agg(F.sum(n).alias("x"))
    j = shares.join(F.broadcast(total)).groupBy("n_items", "o").agg(F.sum((F.col("x") / F.col("all")) * (F.col("x") / F.col("all"))).alias("e"))
    return j.select("n_items", F.round(F.when(F.col("e") < 1, (F.col("o") - F.col("e")) / (1 - F.col("e"))), 6).alias("kappa"))


def threshold_sweep(scored: DataFrame, score: str, positive: str, grid: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, f1) of each threshold of the grid; rows at the threshold count as predicted."""
    g = F.array(*[F.lit(float(x)) for x in grid])
    each = scored.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), F.col(positive).alias("y"), F.explode(g).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    c = each.groupBy("threshold").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"))
    return c.select("*", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def exclusive(probabilities: Column, labels: list[str], alone: str, threshold: float) -> Column:
    """The labels at or above the threshold; the one that stands alone does so if it beats every other, else it goes.

    With none at the threshold, the likeliest label (the first of equal ones).
    """
    k = labels.index(alone)
    p = [probabilities[i] for i in range(len(labels))]
    top = F.greatest(*p)
    chosen = F.array_compact(F.array(*[F.when(p[i] >= threshold, F.lit(x)) for i, x in enumerate(labels) if i != k]))
    first = F.element_at(F.array(*map(F.lit, labels)), F.array_position(probabilities, top).cast("int"))
    strongest = F.greatest(*[x for i, x in enumerate(p) if i != k])
    return F.when((p[k] >= threshold) & (p[k] > strongest), F.array(F.lit(alone))).when(F.size(chosen) > 0, chosen).otherwise(F.array(first))
