"""Queries on labels and spans: agreement, scores, thresholds, decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators.matching import heaviest_assignment, iou, largest_matching, ranked_assignment
from missive.operators.metrics import exclusive, fleiss, kappa, label_scores, overall_scores, threshold_sweep
from missive.plans.registry import query
from missive.session import table

# The labels of the contract, in its order.
LABELS = ["ACTION_REQUEST", "APPROVAL", "DEADLINE", "DEPARTMENTAL_INPUT", "FOLLOW_UP", "GENERAL_UPDATE", "MEETING", "REPORT_REQUEST", "NON_PROJECT"]
_REVIEWS = """with j as (select source_id, lower(trim(user_id)) as u, revision, annotation_json from direct_label_reviews where status = 'submitted' and json_valid(annotation_json)),
  l as (select distinct source_id, u, revision, array_to_string(list_sort(list_distinct(list_transform(json_extract_string(annotation_json, '$.labels[*]'), lambda x: replace(replace(upper(x), '-', '_'), ' ', '_')))), ',') as s, json_extract_string(annotation_json, '$.scope.value') as scope from j),
  r as (select * from l where s <> '' qualify row_number() over (partition by source_id, u order by revision desc, s desc, scope desc) = 1),
  n as (select source_id, row_number() over (partition by source_id order by u) as k, u, string_split(s, ',') as labels, scope from r),
  p as (select a.source_id, a.labels as e, b.labels as p, a.scope as ea, b.scope as pb from n a join n b on a.source_id = b.source_id and a.k = 1 and b.k = 2)
"""
_IN = ", ".join(f"('{x}')" for x in LABELS)
_CELLS = _REVIEWS + f""", c as (select label, list_contains(e, label) as x, list_contains(p, label) as y from p, (values {_IN}) v(label)),
  s as (select label, count(*) filter (x and y) as tp, count(*) filter (not x and y) as fp, count(*) filter (x and not y) as fn from c group by label)
"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, u, labels, scope) of each reviewer's latest submitted review with labels."""
    r = table(spark, sf_dir, "direct_label_reviews").where("status = 'submitted'")
    v = F.try_parse_json("annotation_json")
    labels = F.array_sort(F.array_distinct(F.transform(F.try_variant_get(v, "$.labels", "array<string>"), lambda x: F.regexp_replace(F.upper(x), "[- ]", "_"))))
    rows = r.select("source_id", F.lower(F.trim("user_id")).alias("u"), "revision", F.array_join(labels, ",").alias("s"), F.try_variant_get(v, "$.scope.value", "string").alias("scope")).where("s <> ''")
    last = rows.groupBy("source_id", "u").agg(F.max(F.struct("revision", "s", "scope")).alias("m"))
    return last.select("source_id", "u", F.split("m.s", ",").alias("labels"), "m.scope")


def first_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two reviewers of each source, by name, side by side (J-20)."""
    r = reviews(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("u", "labels", "scope"))).alias("o")).where("size(o) > 1")
    return r.select("source_id", F.col("o")[0]["labels"].alias("expected"), F.col("o")[1]["labels"].alias("predicted"), F.col("o")[0]["scope"].alias("a"), F.col("o")[1]["scope"].alias("b"))


@query(_CELLS + """select label, tp, fp, fn, round(case when tp + fp > 0 then tp * 1.0 / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp * 1.0 / (tp + fn) else 0 end, 6) as recall,
  round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from s""")
def reviewer_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second reviewer of each source held against the first, by label (A-17, A-26, A-31)."""
    return label_scores(first_two(spark, sf_dir), LABELS)


@query(_CELLS + f""", q as (select count(*) as n, avg((len(list_intersect(e, p)) = len(list_distinct(list_concat(e, p))))::int) as same, avg((len(list_distinct(list_concat(e, p))) - len(list_intersect(e, p))) / {len(LABELS)}.0) as apart, avg(len(list_intersect(e, p)) * 1.0 / len(list_distinct(list_concat(e, p)))) as j from p)
  select max(n) as n, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as micro_f1, round(avg(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end), 6) as macro_f1, round(max(same), 6) as subset_accuracy, round(max(apart), 6) as hamming_loss, round(max(q.j), 6) as mean_jaccard from s, q""")
def reviewer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all labels (A-17, A-18, A-20)."""
    return overall_scores(first_two(spark, sf_dir), LABELS)


@query(_REVIEWS + """, c as (select ea, pb, count(*) as n from p where ea is not null and pb is not null group by 1, 2), t as (select sum(n) as n, sum(n) filter (ea = pb) as same from c), x as (select ea as c, sum(n) as x from c group by 1), y as (select pb as c, sum(n) as y from c group by 1), e as (select sum(x * y) as xy from x join y using (c)),
  k as (select t.n, t.same * 1.0 / t.n as o, e.xy * 1.0 / (t.n * t.n) as e from t, e) select n::bigint as n, round(o, 6) as observed, round(e, 6) as expected, round((o - e) / (1 - e), 6) as kappa from k""")
def scope_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of two reviewers on the scope (A-20)."""
    return kappa(first_two(spark, sf_dir), "a", "b")


@query(_REVIEWS + """select ea as scope, count(*) filter (pb = 'PROJECT') as project, count(*) filter (pb = 'NON_PROJECT') as non_project, count(*) filter (pb = 'UNCERTAIN') as uncertain from p group by 1""")
def scope_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion matrix of two reviewers on the scope (A-25)."""
    m = first_two(spark, sf_dir).groupBy(F.col("a").alias("scope")).pivot("b", ["PROJECT", "NON_PROJECT", "UNCERTAIN"]).count()
    return m.select("scope", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("PROJECT", "NON_PROJECT", "UNCERTAIN")])


@query(_REVIEWS + """, t as (select source_id, scope from n where k <= 3 and source_id in (select source_id from n group by 1 having count(*) >= 3)), c as (select source_id, scope, count(*) as n from t group by 1, 2),
  i as (select source_id, sum(n * (n - 1)) / 6.0 as o from c group by 1), e as (select sum(s * s) as e from (select sum(n) * 1.0 / (select sum(n) from c) as s from c group by scope)) select count(*) as n_items, round((avg(o) - max(e)) / (1 - max(e)), 6) as kappa from i, e""")
def scope_fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleiss' kappa of the first three reviewers of each source on the scope (A-21)."""
    r = reviews(spark, sf_dir).groupBy("source_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("u", "scope"))), 1, 3).alias("o")).where("size(o) = 3")
    counts = r.select("source_id", F.explode("o").alias("x")).groupBy("source_id", F.col("x.scope").alias("scope")).agg(F.count("*").alias("n"))
    return fleiss(counts, "source_id", "scope", "n")


@query("""with e as (select value / 100.0 as s, event_type = 'purchase' as y from events), g as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::double as threshold), c as (select threshold, count(*) filter (s >= threshold and y) as tp, count(*) filter (s >= threshold and not y) as fp, count(*) filter (s < threshold and y) as fn from e, g group by 1)
  select threshold, tp, fp, fn, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c""")
def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 at each threshold of a grid (M-12, M-25)."""
    e = table(spark, sf_dir, "events").select((F.col("value") / 100.0).alias("s"), (F.col("event_type") == "purchase").alias("y"))
    return threshold_sweep(e, "s", "y", [k / 10 for k in range(1, 10)])


@query(_REVIEWS + f""", v as (select source_id, label, avg(list_contains(labels, label)::int) as p, array_position({LABELS!r}, label) as i from n, (values {_IN}) v(label) group by 1, 2), m as (select source_id, max(p) as top, max(p) filter (label <> 'NON_PROJECT') as other, max(p) filter (label = 'NON_PROJECT') as alone, list_sort(list(label) filter (p >= 0.5 and label <> 'NON_PROJECT')) as chosen from v group by 1),
  f as (select source_id, label as first from v join m using (source_id) where p = top qualify row_number() over (partition by source_id order by i) = 1)
  select source_id, case when alone >= 0.5 and alone > other then 'NON_PROJECT' when len(chosen) > 0 then array_to_string(chosen, ',') else first end as decided from m join f using (source_id)""")
def exclusive_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels decided from shares of votes, where one stands alone (R-07, R-08)."""
    shares = F.array(*[F.avg(F.array_contains("labels", x).cast("double")) for x in LABELS]).alias("p")
    r = reviews(spark, sf_dir).groupBy("source_id").agg(shares)
    return r.select("source_id", F.array_join(F.array_sort(exclusive(F.col("p"), LABELS, "NON_PROJECT", 0.5)), ",").alias("decided"))


@query(_REVIEWS + """select label, count(*) filter (y) as n_positive, count(*) filter (not y) as n_negative, round(count(*) filter (not y) * 1.0 / nullif(count(*) filter (y), 0), 6) as weight from (select label, list_contains(labels, label) as y from n, (values """ + _IN + """) v(label)) group by label""")
def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives over positives of each label (A-36)."""
    r = reviews(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.array_contains("labels", x).alias("y")) for x in LABELS])).alias("c")).select("c.*")
    g = r.groupBy("label").agg(F.count_if("y").alias("n_positive"), F.count_if(~F.col("y")).alias("n_negative"))
    return g.select("*", F.round(F.try_divide("n_negative", "n_positive"), 6).alias("weight"))


@query("""with j as (select distinct source_id, annotation_json from direct_label_reviews where json_valid(annotation_json)), s as (select source_id, unnest(from_json(json_extract(annotation_json, '$.spans'), '[{"start":"INTEGER","end":"INTEGER","text":"VARCHAR"}]')) as p from j)
  select coalesce(substr(body, p.start + 1, p."end" - p.start) = p.text, false) as exact, count(*) as n_spans from s left join sources using (source_id) group by 1""")
def span_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of reviews by whether their text is what stands there in the source (P-31, P-39, P-40)."""
    r = table(spark, sf_dir, "direct_label_reviews").select("source_id", "annotation_json").distinct()
    spans = F.try_variant_get(F.try_parse_json("annotation_json"), "$.spans", "array<struct<start:int,end:int,text:string>>")
    s = r.select("source_id", F.explode(spans).alias("p")).join(table(spark, sf_dir, "sources").select("source_id", "body"), "source_id", "left")
    exact = F.coalesce(F.substr("body", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")) == F.col("p.text"), F.lit(False))
    return s.groupBy(exact.alias("exact")).agg(F.count("*").alias("n_spans"))


@query()
def span_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the first two reviewers of each source that overlap, matched one to one, and their mean overlap (A-27, M-02, M-03)."""
    r = table(spark, sf_dir, "direct_label_reviews").where("status = 'submitted'").select("source_id", F.lower(F.trim("user_id")).alias("u"), F.try_variant_get(F.try_parse_json("annotation_json"), "$.spans", "array<struct<start:int,end:int>>").alias("s")).where("s is not null")
    two = r.groupBy("source_id", "u").agg(F.max("s").alias("s")).groupBy("source_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("u", "s"))), 1, 2).alias("o")).where("size(o) = 2")

    def part(batches):
        for b in batches:
            out = []
            for key, o in zip(b["source_id"], b["o"], strict=True):
                x, y = [[(s["start"], s["end"]) for s in side["s"]] for side in o]
                w = [[iou([a], [c]) for c in y] for a in x]
                pairs = largest_matching(w)
                out.append((key, len(x), len(y), len(pairs), sum(w[i][j] for i, j in pairs) / len(pairs) if pairs else None))
            yield pd.DataFrame(out, columns=["source_id", "n_first", "n_second", "n_matched", "mean_iou"]).astype({"mean_iou": "float64"})

    return two.mapInPandas(part, "source_id string, n_first int, n_second int, n_matched int, mean_iou double")


@query(_REVIEWS + f""", t as (select a.u as first_user, b.u as second_user, label, list_contains(a.labels, label) as x, list_contains(b.labels, label) as y from n a join n b on a.source_id = b.source_id and a.u < b.u, (values {_IN}) v(label)),
  c as (select first_user, second_user, label, count(*) as n, count(*) filter (x and y) as n_both, count(*) filter (x <> y) as n_one, count(*) filter (not x and not y) as n_none from t group by all)
  select first_user, second_user, label, n, n_both, n_one, round(case when n_both + n_one > 0 then 2.0 * n_both / (2 * n_both + n_one) end, 6) as positive_agreement, round(case when n_none + n_one > 0 then 2.0 * n_none / (2 * n_none + n_one) end, 6) as negative_agreement from c""")
def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every two reviewers and each label, how far they agree that it applies and that it doesn't (A-22).

    A source has few reviewers, so its pairs are few; they are counted before any shuffle but that by source.
    """
    r = reviews(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("u", "labels"))).alias("o")).where("size(o) > 1")
    pairs = F.flatten(F.transform("o", lambda a, i: F.transform(F.filter("o", lambda b, j: j > i), lambda b: F.struct(a["u"].alias("first_user"), b["u"].alias("second_user"), a["labels"].alias("x"), b["labels"].alias("y")))))
    p = r.select(F.explode(pairs).alias("p")).select("p.*")
    sides = F.array(*[F.struct(F.lit(v).alias("label"), F.array_contains("x", v).alias("x"), F.array_contains("y", v).alias("y")) for v in LABELS])
    c = p.select("first_user", "second_user", F.explode(sides).alias("l")).groupBy("first_user", "second_user", "l.label")
    c = c.agg(F.count("*").alias("n"), F.count_if(F.col("l.x") & F.col("l.y")).alias("n_both"), F.count_if(F.col("l.x") != F.col("l.y")).alias("n_one"), F.count_if(~F.col("l.x") & ~F.col("l.y")).alias("n_none"))
    share = lambda n: F.when(F.col(n) + F.col("n_one") > 0, F.round(2.0 * F.col(n) / (2 * F.col(n) + F.col("n_one")), 6))
    return c.select("first_user", "second_user", "label", "n", "n_both", "n_one", share("n_both").alias("positive_agreement"), share("n_none").alias("negative_agreement"))


@query("""with j as (select distinct source_id, lower(trim(user_id)) as u, annotation_json from direct_label_reviews where status = 'submitted' and json_valid(annotation_json)),
  s as (select distinct source_id, u, p.field as f, p.start as a, p."end" as b, p.type as t from (select source_id, u, unnest(from_json(json_extract(annotation_json, '$.spans'), '[{"field":"VARCHAR","start":"INTEGER","end":"INTEGER","type":"VARCHAR"}]')) as p from j)),
  w as (select source_id, u, row_number() over (partition by source_id order by u) as k from (select distinct source_id, u from s)), x as (select s.* from s join w using (source_id, u) where k = 1), y as (select s.* from s join w using (source_id, u) where k = 2),
  two as (select source_id from w where k = 2) select coalesce(x.t, y.t) as span_type, count(*) filter (x.t is not null and y.t is not null) as n_both, count(*) filter (y.t is null) as n_first_only, count(*) filter (x.t is null) as n_second_only
  from (select * from x where source_id in (select source_id from two)) x full join y on x.source_id = y.source_id and x.f is not distinct from y.f and x.a = y.a and x.b = y.b and x.t is not distinct from y.t group by 1""")
def span_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that both, or one, of the first two reviewers with spans of each source set, by type (A-23, A-27)."""
    kind = "array<struct<field:string,start:int,end:int,type:string>>"
    r = table(spark, sf_dir, "direct_label_reviews").where("status = 'submitted'").select("source_id", F.lower(F.trim("user_id")).alias("u"), F.explode(F.try_variant_get(F.try_parse_json("annotation_json"), "$.spans", kind)).alias("p"))
    s = r.select("source_id", "u", "p.field", "p.start", "p.end", "p.type").distinct()
    users = s.groupBy("source_id").agg(F.slice(F.array_sort(F.collect_set("u")), 1, 2).alias("w")).where("size(w) = 2")
    who = F.when(F.col("u") == F.col("w")[0], 1).when(F.col("u") == F.col("w")[1], 2)
    k = s.join(users, "source_id").withColumn("k", who).where("k is not null").groupBy("source_id", "field", "start", "end", "type").agg(F.sum("k").alias("k"))
    return k.groupBy(F.col("type").alias("span_type")).agg(F.count_if(F.col("k") == 3).alias("n_both"), F.count_if(F.col("k") == 1).alias("n_first_only"), F.count_if(F.col("k") == 2).alias("n_second_only"))


#: A span of an annotation: field, start, end, type.
Span = tuple[str, int, int, str]


def matched_spans(left: list[Span], right: list[Span]) -> tuple[int, int, float, float]:
    """Pairs, those of one type, and summed overlap of the assignment with most pairs, then overlap, then equal types;
    and the greatest overlap that pairs of one type can sum up to. Spans of different fields don't overlap."""
    over = [[iou([a[1:3]], [b[1:3]]) if a[0] == b[0] else 0.0 for b in right] for a in left]
    best = ranked_assignment([[(1.0, w, float(a[3] == b[3])) if w > 0 else () for b, w in zip(right, row, strict=True)] for a, row in zip(left, over, strict=True)])
    typed = [[w if a[3] == b[3] else 0.0 for b, w in zip(right, row, strict=True)] for a, row in zip(left, over, strict=True)]
    return len(best), sum(left[i][3] == right[j][3] for i, j in best), sum(over[i][j] for i, j in best), sum(typed[i][j] for i, j in heaviest_assignment(typed))


@query()
def matched_span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the first two reviewers of each source assigned one to one: by pairs, overlap and type in that order, and by the
    most overlap of one type (M-01, M-03, M-05, A-27)."""
    kind = "array<struct<field:string,start:int,end:int,type:string>>"
    r = table(spark, sf_dir, "direct_label_reviews").where("status = 'submitted'").select("source_id", F.lower(F.trim("user_id")).alias("u"), "revision", F.try_variant_get(F.try_parse_json("annotation_json"), "$.spans", kind).alias("s")).where("s is not null")
    two = r.groupBy("source_id", "u").agg(F.max(F.struct("revision", "s"))["s"].alias("s")).groupBy("source_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("u", "s"))), 1, 2).alias("o")).where("size(o) = 2")
    columns = ["source_id", "n_first", "n_second", "n_matched", "n_same_type", "overlap", "typed_overlap"]

    def part(batches):
        for b in batches:
            out = []
            for key, o in zip(b["source_id"], b["o"], strict=True):
                x, y = [sorted({(s["field"] or "", s["start"] or 0, s["end"] or 0, s["type"] or "") for s in side["s"]}) for side in o]
                out.append((key, len(x), len(y), *matched_spans(x, y)))
            yield pd.DataFrame(out, columns=columns)

    return two.mapInPandas(part, "source_id string, n_first int, n_second int, n_matched int, n_same_type int, overlap double, typed_overlap double")
