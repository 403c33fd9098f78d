"""Queries on splits, folds, lineage, role maps, adjudication and resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive.functions.ids import bare
from missive.functions.text import rank_key, tokens
from missive.operators.ordering import numbered
from missive.plans.metric_queries import _REVIEWS, LABELS, first_two, reviews
from missive.plans.registry import query
from missive.session import Cut, table

_SPLIT = "case when substr(h, 1, 2) < 'cc' then 'train' when substr(h, 1, 2) < 'e6' then 'validation' else 'test' end"


@query(f"""with r as (select distinct record_id, coalesce('g|' || leakage_group_id, 'r|' || record_id) as g, dataset from leakage_records), s as (select record_id, g, dataset, sha256('2026' || chr(0) || g) as h from r),
  p as (select record_id, case when dataset = 'manual' then 'test' when dataset = 'synthetic' then 'train' else {_SPLIT} end as split, g from s), o as (select g, max(case split when 'test' then 3 when 'validation' then 2 else 1 end) as k from p group by g)
  select record_id, case k when 3 then 'test' when 2 then 'validation' else 'train' end as split from p join o using (g)""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by hash of the group; a group with a protected record goes to test as a whole (in place of T-06: no greedy balancing)."""
    r = table(spark, sf_dir, "leakage_records").select("record_id", F.coalesce(F.concat(F.lit("g|"), "leakage_group_id"), F.concat(F.lit("r|"), "record_id")).alias("g"), "dataset").distinct()
    h = F.substring(rank_key("2026", F.col("g")), 1, 2)
    place = F.when(F.col("dataset") == "manual", 3).when(F.col("dataset") == "synthetic", 1).when(h < "cc", 1).when(h < "e6", 2).otherwise(3)
    most = r.groupBy("g").agg(F.max(place).alias("k"))
    names = F.when(F.col("k") == 3, "test").when(F.col("k") == 2, "validation").otherwise("train")
    return r.join(most, "g").select("record_id", names.alias("split"))


@query("""with g as (select leakage_group_id as g, count(distinct record_id) as n from leakage_records where leakage_group_id is not null group by 1), r as (select g, n, row_number() over (order by n desc, g) - 1 as i from g)
  select g as group_id, (case when (i // 5) % 2 = 0 then i % 5 else 4 - i % 5 end)::bigint as fold, n as n_records from r""")
def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, the largest first, dealt to five folds there and back (T-09, by size alone)."""
    g = table(spark, sf_dir, "leakage_records").where("leakage_group_id is not null").groupBy(F.col("leakage_group_id").alias("group_id")).agg(F.count_distinct("record_id").alias("n_records"))
    r = numbered(g.withColumn("all", F.lit(0)).withColumn("order", -F.col("n_records")), ["all"], ["order", "group_id"], "i", Cut(spark))
    i = F.col("i") - 1
    return r.select("group_id", F.when(F.floor(i / 5) % 2 == 0, i % 5).otherwise(4 - i % 5).alias("fold"), "n_records")


@query(r"""with d as (select distinct doc_id, text from documents), t as (select doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), ' ') as j from d)
  select doc_id, min(doc_id) over (partition by j) as kept_id from t where j <> '' qualify min(doc_id) over (partition by j) <> doc_id""")
def dropped_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left out as copies, each with the one that stays (U-07, U-04)."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("j")).distinct().where("j <> ''").select("doc_id", F.sha2("j", 256).alias("h"))
    first = t.groupBy("h").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1")
    return t.join(first, "h").where("doc_id <> kept_id").select("doc_id", "kept_id")


@query("""with j as (select distinct source_id, lower(trim(user_id)) as u, annotation_json from direct_label_reviews where json_valid(annotation_json)), s as (select source_id, u, unnest(from_json(json_extract(annotation_json, '$.spans'), '[{"field":"VARCHAR","start":"INTEGER","end":"INTEGER","type":"VARCHAR"}]')) as p from j)
  select source_id, p.field as field, p.start as start_pos, p."end" as end_pos, p.type as span_type, count(distinct u) as n_users, min(u) as first_user from s group by all""")
def distinct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all reviewers made one by place and type, with who set them (U-06)."""
    r = table(spark, sf_dir, "direct_label_reviews").select("source_id", F.lower(F.trim("user_id")).alias("u"), F.try_variant_get(F.try_parse_json("annotation_json"), "$.spans", "array<struct<field:string,start:int,end:int,type:string>>").alias("s")).distinct()
    s = r.select("source_id", "u", F.explode("s").alias("p"))
    return s.groupBy("source_id", F.col("p.field").alias("field"), F.col("p.start").alias("start_pos"), F.col("p.end").alias("end_pos"), F.col("p.type").alias("span_type")).agg(F.count_distinct("u").alias("n_users"), F.min("u").alias("first_user"))


# Roles by event type and value, most specific first.
ROLES = (("purchase", "high", "spend"), ("purchase", None, "order"), (None, "high", "peak"))
_ROLE_VALUES = ", ".join(f"({'null' if a is None else repr(a)}, {'null' if b is None else repr(b)}, {c!r})" for a, b, c in ROLES)


@query(f"""with r(t, l, role) as (values {_ROLE_VALUES}), e as (select event_type, case when value >= 50 then 'high' else 'low' end as l from events),
  m as (select e.event_type, e.l, coalesce(x.role, y.role, z.role, 'unmapped') as role from e left join r x on x.t = e.event_type and x.l = e.l left join r y on y.t = e.event_type and y.l is null left join r z on z.t is null and z.l = e.l) select event_type, l as level, role, count(*) as n from m group by all""")
def mapped_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by an exact rule, else the type's default, else the level's, else none (J-27)."""
    rules = spark.createDataFrame(ROLES, "t string, l string, role string")
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") >= 50, "high").otherwise("low").alias("l"))
    exact = rules.where("t is not null and l is not null").select(F.col("t").alias("event_type"), "l", F.col("role").alias("x"))
    kind = rules.where("t is not null and l is null").select(F.col("t").alias("event_type"), F.col("role").alias("y"))
    level = rules.where("t is null").select("l", F.col("role").alias("z"))
    m = e.join(exact, ["event_type", "l"], "left").join(kind, "event_type", "left").join(level, "l", "left")
    return m.groupBy("event_type", F.col("l").alias("level"), F.coalesce("x", "y", "z", F.lit("unmapped")).alias("role")).agg(F.count("*").alias("n"))


@query(_REVIEWS + """, o as (select source_id, list(array_to_string(labels, ',') order by k) as s from n where k <= 3 group by 1)
  select source_id, case when len(s) = 1 then 'single' when s[1] = s[2] then 'agreed' when len(s) = 3 and (s[3] = s[1] or s[3] = s[2]) then 'third' else 'open' end as decision, case when len(s) > 1 and s[1] = s[2] then s[1] when len(s) = 3 and (s[3] = s[1] or s[3] = s[2]) then s[3] end as labels from o""")
def adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers who agree decide, else a third who agrees with one of them, else none (J-32, R-03, R-06, R-11)."""
    r = reviews(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("u", F.array_join("labels", ",").alias("s")))).alias("o"))
    s = [F.get(F.col("o"), k)["s"] for k in range(3)]
    third = s[2].isNotNull() & ((s[2] == s[0]) | (s[2] == s[1]))
    decision = F.when(s[1].isNull(), "single").when(s[0] == s[1], "agreed").when(third, "third").otherwise("open")
    return r.select("source_id", decision.alias("decision"), F.when(s[0] == s[1], s[0]).when(third, s[2]).alias("labels"))


@query(_REVIEWS + """, x as (select source_id, list_sort(e) <> list_sort(p) or len(e) > 1 as must, sha256('2026' || chr(0) || source_id) as h from p), m as (select source_id, 'disagreement or several labels' as reason from x where must), c as (select ceil(count(*) * 0.2)::int as k from x)
  select * from m union all select source_id, 'drawn' from (select source_id, row_number() over (order by h, source_id) as i, must from x), c where i <= k and not must""")
def audit_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to audit: disagreements, several labels, and a fifth of all in hash order (T-22)."""
    x = first_two(spark, sf_dir).select("source_id", ((F.array_sort("expected") != F.array_sort("predicted")) | (F.size("expected") > 1)).alias("must"), rank_key("2026", F.col("source_id")).alias("h"), F.lit(0).alias("all"))
    cut = Cut(spark)
    ranked = cut.keep(numbered(x, ["all"], ["h", "source_id"], "i", cut))
    k = ranked.agg(F.ceil(F.count("*") * 0.2).alias("k"))
    return ranked.join(F.broadcast(k)).where("must or i <= k").select("source_id", F.when(F.col("must"), "disagreement or several labels").otherwise("drawn").alias("reason"))


@query("""with p as (select distinct email_id, lower(trim(message_id, e' \\t<>')) as m, lower(regexp_extract(sender, '([A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+)', 1)) as s from parsed_messages), e as (select lower(trim(message_id, e' \\t<>')) as m, min(lower(regexp_extract(sender, '([A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+)', 1))) as s from emails group by 1)
  select case when p.m = '' then 'no id' when e.m is null then 'missing' when e.s is distinct from p.s then 'other sender' else 'joined' end as status, count(*) as n from p left join e using (m) group by 1""")
def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of messages joined to the archive by id, with what doesn't fit told apart (J-18, J-19, F-13)."""
    address = lambda c: F.lower(F.regexp_extract(c, r"([A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+)", 1))
    p = table(spark, sf_dir, "parsed_messages").select("email_id", bare(F.col("message_id")).alias("m"), address(F.col("sender")).alias("s")).distinct()
    e = table(spark, sf_dir, "emails").select(bare(F.col("message_id")).alias("m"), address(F.col("sender")).alias("t")).groupBy("m").agg(F.min("t").alias("t"), F.lit(True).alias("there"))
    j = p.join(e, "m", "left")
    status = F.when(F.col("m").isNull(), "no id").when(F.col("there").isNull(), "missing").when(~F.col("t").eqNullSafe(F.col("s")), "other sender").otherwise("joined")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""with c as (select distinct doc_id, source, lang from documents), n as (select source, lang, count(*) as n from c group by all), r as (select *, row_number() over (partition by source order by n desc, lang nulls last) as k from n) select source, lang, n from r where k = 1""")
def main_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common label of each source, ties by name (W-12, A-34)."""
    n = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").distinct().groupBy("source", "lang").agg(F.count("*").alias("n"))
    r = n.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), F.asc_nulls_last("lang"))))
    return r.where("k = 1").select("source", "lang", "n")


REPLICATES = 2000


def paired_bootstrap(rows: DataFrame, labels: list[str], replicates: int = REPLICATES) -> DataFrame:
    """(metric, delta, low, high) of rows(key, expected, first, second): how much better second is, with 95 % intervals.

    Metrics are micro and macro F1; a label that nobody expects or predicts counts 0 in the macro. Both systems are
    weighed by the same Poisson weights, which come from the row's own key, so the interval doesn't depend on the
    partitioning. Partitions send their sums, of a fixed size. An empty table gives no rows.
    """
    has = lambda c: F.array(*[F.array_contains(c, x).cast("int") for x in labels])
    rows = rows.select(F.xxhash64("key").alias("h"), has("expected").alias("e"), has("first").alias("a"), has("second").alias("b"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((replicates + 1, 2, 2, len(labels)))  # the rows themselves first; system; true positives, and sizes
        for b in batches:
            e = np.array(b["e"].tolist())
            each = np.stack([np.stack([e * x, e + x], 1) for x in (np.array(b["a"].tolist()), np.array(b["b"].tolist()))], 1) if len(b) else None
            for k in range(0, len(b), 512):
                w = np.stack([np.append(1, np.random.default_rng(h & 0xFFFFFFFF).poisson(1, replicates)) for h in b["h"][k : k + 512]], 1)
                sums += np.einsum("rn,nstl->rstl", w, each[k : k + 512])
        yield pd.DataFrame({"i": range(replicates + 1), "s": list(sums.reshape(replicates + 1, -1))})

    each = rows.mapInPandas(part, "i int, s array<double>").select("i", F.posexplode("s").alias("k", "v")).groupBy("i", "k").agg(F.sum("v").alias("v"))
    n = len(labels)
    cell = each.withColumn("system", F.floor(F.col("k") / (2 * n))).withColumn("size", F.floor(F.col("k") / n) % 2).withColumn("label", F.col("k") % n)
    f1 = cell.groupBy("i", "system", "label").agg(F.sum(F.when(F.col("size") == 0, F.col("v"))).alias("tp"), F.sum(F.when(F.col("size") == 1, F.col("v"))).alias("n"))
    ratio = lambda t, m: F.coalesce(2 * t / F.nullif(m, F.lit(0.0)), F.lit(0.0))
    both = f1.groupBy("i", "system").agg(ratio(F.sum("tp"), F.sum("n")).alias("micro"), F.avg(ratio(F.col("tp"), F.col("n"))).alias("macro"))
    sign = F.when(F.col("system") == 1, 1).otherwise(-1)
    delta = both.groupBy("i").agg(F.sum(sign * F.col("micro")).alias("micro"), F.sum(sign * F.col("macro")).alias("macro"))
    long = delta.select("i", F.explode(F.array(F.struct(F.lit("micro").alias("metric"), F.col("micro").alias("d")), F.struct(F.lit("macro").alias("metric"), F.col("macro").alias("d")))).alias("m")).select("i", "m.*")
    drawn = F.when(F.col("i") > 0, F.col("d"))
    return long.groupBy("metric").agg(F.round(F.max(F.when(F.col("i") == 0, F.col("d"))), 6).alias("delta"), F.round(F.percentile(drawn, 0.025), 6).alias("low"), F.round(F.percentile(drawn, 0.975), 6).alias("high"))


@query()
def bootstrap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much nearer the third reviewer of a source is to the first than the second is, with resampled intervals (A-37)."""
    r = reviews(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("u", "labels"))).alias("o")).where("size(o) > 2")
    return paired_bootstrap(r.select(F.col("source_id").alias("key"), F.col("o")[0]["labels"].alias("expected"), F.col("o")[1]["labels"].alias("first"), F.col("o")[2]["labels"].alias("second")), LABELS)
