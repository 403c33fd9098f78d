"""Queries on rows: rollups, joins, windows, sets, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from missive.functions import text as T
from missive.functions.ids import bare, message_ids, valued
from missive.operators.archive import thread_rollup, upsert
from missive.operators.graph import components
from missive.operators.joins import nearest_earlier, one_to_one, star_edges, thread_ids
from missive.operators.ordering import numbered, sessions
from missive.operators.sampling import bottom_k, largest_remainder, round_robin, stratified_quota
from missive.plans.registry import query
from missive.session import Cut, table

_NONE = "('', '-', '--', '0', '?', 'n/a', 'na', 'n.a.', 'nan', 'nil', 'none', 'null', '(none)', '(null)', '<none>', '<null>', 'undefined', 'unknown', 'unspecified', 'und', 'tbd', 'xx', 'xxx')"
_THREAD = f"case when lower(trim(thread_id, e' \\t\\n\\r')) not in {_NONE} then lower(trim(thread_id, e' \\t\\n\\r')) end"
_ONE = "one as (select * from emails qualify row_number() over (partition by source_id order by imported_at, body_sha256) = 1)"


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first import of each mail."""
    m = table(spark, sf_dir, "emails")
    return m.groupBy("source_id").agg(F.min_by(F.struct(*[c for c in m.columns if c != "source_id"]), F.struct("imported_at", "body_sha256")).alias("m")).select("source_id", "m.*")


@query("""select count(*) as n_rows, count(distinct source_id) as n_mails, count(*) - count(distinct source_id) as n_repeated, count(*) filter (in_reply_to is not null) as n_replies,
  count(*) filter (coalesce(sender, '') = '') as n_without_sender, count(*) filter (length(body_raw) = 0) as n_empty, sum(length(body_raw))::bigint as n_chars, count(*) filter (attachment_names_json <> '[]') as n_with_files from emails""")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an ingest in one pass (A-01)."""
    c = F.count_if
    return table(spark, sf_dir, "emails").agg(
        F.count("*").alias("n_rows"), F.count_distinct("source_id").alias("n_mails"), (F.count("*") - F.count_distinct("source_id")).alias("n_repeated"), c(F.col("in_reply_to").isNotNull()).alias("n_replies"),
        c(F.coalesce("sender", F.lit("")) == "").alias("n_without_sender"), c(F.length("body_raw") == 0).alias("n_empty"), F.sum(F.length("body_raw")).alias("n_chars"), c(F.col("attachment_names_json") != "[]").alias("n_with_files"),
    )


@query(f"""with {_ONE}, m as (select distinct lower(trim(message_id, e' \\t<>')) as id from one), r as (select lower(trim(in_reply_to, e' \\t<>')) as parent, in_reply_to from one)
  select case when in_reply_to is null then 'no_parent' when parent in (select id from m) then 'linked' else 'dangling' end as status, count(*) as n_mails from r group by 1""")
def reply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails by whether the mail they reply to is there (J-28, A-02)."""
    one = _mails(spark, sf_dir).select(bare(F.col("message_id")).alias("id"), bare(F.col("in_reply_to")).alias("parent"))
    ids = one.select(F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    status = F.when(F.col("parent").isNull(), "no_parent").when(F.col("known"), "linked").otherwise("dangling")
    return one.select("parent").join(ids, "parent", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n_mails"))


@query(f"""with {_ONE}, t as (select {_THREAD} as t, count(*) as n from one group by 1) select case when n = 1 then '1' when n = 2 then '2' when n <= 5 then '3-5' when n <= 10 then '6-10' when n <= 50 then '11-50' else '>50' end as size, count(*) as n_threads, sum(n)::bigint as n_mails from t where t is not null group by 1""")
def thread_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads by size (A-03)."""
    t = _mails(spark, sf_dir).select(valued(F.col("thread_id")).alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("n"))
    size = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").when(F.col("n") <= 10, "6-10").when(F.col("n") <= 50, "11-50").otherwise(">50")
    return t.groupBy(size.alias("size")).agg(F.count("*").alias("n_threads"), F.sum("n").alias("n_mails"))


@query("""with d as (select distinct doc_id, source, n_chars from documents) select source, count(*) as n, min(n_chars) as least, quantile_disc(n_chars, 0.5) as median, quantile_disc(n_chars, 0.9) as p90, max(n_chars) as most from d group by source""")
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median, ninetieth percentile (nearest rank) and most characters by source (A-04)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").distinct()
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by n_chars)")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), q(0.5).cast("long").alias("median"), q(0.9).cast("long").alias("p90"), F.max("n_chars").alias("most"))


@query(f"""with {_ONE}, a as (select lower(regexp_extract(sender, '([A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+)', 1)) as address from one) select address, count(*) as n_mails from a where address <> '' group by 1 order by n_mails desc, address limit 50""")
def top_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty senders of most mails, ties by address (A-06, P-11, P-20)."""
    a = _mails(spark, sf_dir).select(F.lower(F.regexp_extract("sender", r"([A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+)", 1)).alias("address")).where("address <> ''")
    return a.groupBy("address").agg(F.count("*").alias("n_mails")).orderBy(F.desc("n_mails"), "address").limit(50)


@query(f"""with {_ONE}, t as (select {_THREAD} as thread, source_id, imported_at, project_or_list from one)
  select thread, min(imported_at) as first_import, max(imported_at) as last_import, count(*) as n_mails, array_to_string(list_sort(list_distinct(list(project_or_list))), ',') as projects, min(source_id) as first_id from t where thread is not null group by 1""")
def archive_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thread table of the archive (A-14, S-13)."""
    return thread_rollup(_mails(spark, sf_dir).withColumn("thread", valued(F.col("thread_id"))), "thread").select("thread", "first_import", "last_import", "n_mails", F.array_join("projects", ",").alias("projects"), "first_id")


@query("""with o as (select source_id, imported_at, annotation_method, current_message from emails), f as (select * from o qualify row_number() over (partition by source_id order by imported_at) = 1),
  l as (select * from o qualify row_number() over (partition by source_id order by imported_at desc) = 1)
  select l.source_id, l.imported_at, case when f.annotation_method <> 'UNANNOTATED' then f.annotation_method else l.annotation_method end as annotation_method, coalesce(f.current_message, l.current_message) is not null as has_current from f join l using (source_id)""")
def archive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive after every row was imported in order: later rows replace, annotations and texts stay (K-05, W-03)."""
    return upsert(table(spark, sf_dir, "emails"), "source_id", "imported_at", keep={"annotation_method": "UNANNOTATED", "current_message": None}).select(
        "source_id", "imported_at", "annotation_method", F.col("current_message").isNotNull().alias("has_current")
    )


@query("""with k as (select record_id, 'g' || leakage_group_id as k, 1 as bit from leakage_records where leakage_group_id is not null union select record_id, 'm' || message_id, 2 from identity_records where message_id is not null union select record_id, 's' || subject || body, 4 from identity_records where length(body) >= 40),
  f as (select record_id, k, bit, min(record_id) over (partition by k) as f, count(*) over (partition by k) as n from k),
  e as (select record_id as l, f as r from f where n > 1 and record_id <> f), w as (select l, r from e union select r, l from e),
  c as (with recursive reach(x, y) as (select l, l from w union select reach.x, w.r from reach join w on reach.y = w.l) select x, min(y) as root from reach group by x),
  v as (select record_id, bit_or(bit) as bits from f where n > 1 group by record_id)
  select root, count(*) as n_records, count(distinct split_part(v.record_id, ':', 1)) as n_datasets, bit_or(bits)::int as evidence from c join v on v.record_id = c.x group by root""")
def hash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of records that share a group, a message or a text, with the kinds of evidence (J-01, J-07, A-11)."""
    cut = Cut(spark)
    groups = table(spark, sf_dir, "leakage_records").select("record_id", F.concat(F.lit("g"), "leakage_group_id").alias("k"), F.lit(1).alias("bit"))
    i = table(spark, sf_dir, "identity_records")
    named = i.select("record_id", F.concat(F.lit("m"), "message_id").alias("k"), F.lit(2).alias("bit"))
    texts = i.where("length(body) >= 40").select("record_id", F.concat(F.lit("s"), "subject", "body").alias("k"), F.lit(4).alias("bit"))
    keys = groups.unionAll(named).unionAll(texts).where("k is not null").distinct()
    edges, members = star_edges(keys, "record_id", "k", cut)
    found = components(edges, cut)
    evidence = members.join(keys, ["record_id", "k"]).groupBy("record_id", "node").agg(F.bit_or("bit").alias("bits"))
    done = evidence.join(found, "node").withColumn("dataset", F.substring_index("record_id", ":", 1))
    return done.groupBy("component").agg(F.min("record_id").alias("root"), F.count("*").alias("n_records"), F.count_distinct("dataset").alias("n_datasets"), F.bit_or("bits").alias("evidence")).drop("component")


@query("""with p as (select email_id, lower(trim(message_id, e' \\t<>')) as mid, list_distinct(list_transform(list_concat(coalesce(reference_ids, []), coalesce(in_reply_to, [])), lambda x: lower(trim(x, e' \\t<>')))) as refs from (select distinct email_id, message_id, reference_ids, in_reply_to from parsed_messages)),
  k as (select email_id, mid as k from p where mid <> '' union select email_id, r from (select email_id, unnest(refs) as r from p) where r <> ''),
  f as (select email_id, min(email_id) over (partition by k) as f from k), w as (select email_id as l, f as r from f union select f, email_id from f),
  c as (with recursive reach(x, y) as (select l, l from w union select reach.x, w.r from reach join w on reach.y = w.l) select x, list_sort(list(distinct y)) as members from reach group by x)
  select p.email_id, substr(sha256(array_to_string(coalesce(c.members, [p.email_id]), chr(10))), 1, 20) as thread_id, coalesce(len(c.members), 1) as n_members from p left join c on c.x = p.email_id""")
def message_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of messages that share an id, name one another or name the same missing message (J-02, F-04)."""
    p = table(spark, sf_dir, "parsed_messages").select("email_id", "message_id", "reference_ids", "in_reply_to")
    named = F.concat(F.coalesce("reference_ids", F.array().cast("array<string>")), F.coalesce("in_reply_to", F.array().cast("array<string>")))
    return thread_ids(p.select("email_id", F.concat(F.array("message_id"), named).alias("names")), "email_id", "names", Cut(spark))


@query("""with e as (select event_id, user_id, event_type, ts from events), p as (select b.event_id as later_id, a.event_id as earlier_id, row_number() over (partition by b.event_id order by a.ts desc, a.event_id) as k
  from e b join e a on a.user_id = b.user_id and a.event_type <> b.event_type and a.ts < b.ts and a.ts >= b.ts - interval 7 days) select later_id, earlier_id from p where k = 1""")
def earlier_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of another type by the same user within the seven days before each event (J-03)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return nearest_earlier(e, "event_id", ["user_id"], "event_type", "at", 7 * 86_400_000_000)


@query("""with e as (select event_id, user_id, event_type, ts from events), p as (select b.event_id as later_id, a.event_id as earlier_id, row_number() over (partition by b.event_id order by a.ts desc, a.event_id) as k
  from e b join e a on a.user_id = b.user_id and a.event_type <> b.event_type and a.ts < b.ts and a.ts >= b.ts - interval 2 hours), x as (select later_id, earlier_id from p where k = 1),
  n as (select id, count(*) as n from (select later_id as id from x union all select earlier_id from x) group by id having count(*) = 1) select later_id, earlier_id from x where later_id in (select id from n) and earlier_id in (select id from n)""")
def one_to_one_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the latest earlier event within two hours whose both ends are in no other pair (J-04)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return one_to_one(nearest_earlier(e, "event_id", ["user_id"], "event_type", "at", 2 * 3_600_000_000), "later_id", "earlier_id")


@query("""with s as (select user_id, event_id, case when ts - lag(ts) over w > interval 12 hours then 1 else 0 end as n from events window w as (partition by user_id order by ts, event_id)), r as (select user_id, event_id, sum(n) over (partition by user_id order by event_id rows unbounded preceding) as x from s)
  select e.user_id, e.event_id, (1 + sum(s.n) over (partition by e.user_id order by e.ts, e.event_id rows unbounded preceding))::bigint as session_no from events e join s using (event_id)""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered by session: a new one after twelve hours of rest."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return sessions(e, ["user_id"], "at", ["event_id"], 12 * 3_600_000_000, "session_no", Cut(spark)).select("user_id", "event_id", "session_no")


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as turn_index from events")
def turn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place in its group by time, ties by id, from 0 (W-01)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return numbered(e, ["user_id"], ["ts", "event_id"], "n", Cut(spark)).select("event_id", "user_id", (F.col("n") - 1).alias("turn_index"))


@query("""with r as (select user_id, event_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as g from events)
  select user_id, event_type, min(event_id) as first_id, count(*) as n_rows, min(ts) as started from r group by user_id, event_type, g having count(*) > 1""")
def type_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more successive events of one type by a user (W-17, W-18)."""
    cut = Cut(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    r = numbered(numbered(e, ["user_id"], ["ts", "event_id"], "a", cut), ["user_id", "event_type"], ["ts", "event_id"], "b", cut)
    return r.groupBy("user_id", "event_type", (F.col("a") - F.col("b")).alias("g")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n_rows"), F.min("ts").alias("started")).where("n_rows > 1").drop("g")


@query("""select source_id, user_id, revision, status from (select distinct source_id, lower(trim(user_id)) as user_id, revision, status from direct_label_reviews where status = 'submitted') qualify row_number() over (partition by source_id, user_id order by revision desc) = 1""")
def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest submitted revision of each reviewer and source (W-13)."""
    r = table(spark, sf_dir, "direct_label_reviews").where("status = 'submitted'").select("source_id", F.lower(F.trim("user_id")).alias("user_id"), "revision", "status")
    return r.groupBy("source_id", "user_id").agg(F.max("revision").alias("revision"), F.max("status").alias("status"))


@query("select lower(trim(user_id)) as user_id, status, count(*) as n_reviews, sum(active_ms)::bigint as active_ms, median(active_ms / 60000.0) as median_minutes from direct_label_reviews group by 1, 2")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and active time by reviewer and status (A-15, A-24)."""
    r = table(spark, sf_dir, "direct_label_reviews")
    return r.groupBy(F.lower(F.trim("user_id")).alias("user_id"), "status").agg(F.count("*").alias("n_reviews"), F.sum("active_ms").alias("active_ms"), F.median(F.col("active_ms") / 60000.0).alias("median_minutes"))


@query("""select w.user_id, w.slot, count(r.source_id) as n_submitted from reviewers w left join (select distinct source_id, lower(trim(user_id)) as user_id from direct_label_reviews where status = 'submitted') r on r.user_id = w.user_id group by 1, 2""")
def reviewer_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted sources of each reviewer, those without any included (A-16, S-14)."""
    r = table(spark, sf_dir, "direct_label_reviews").where("status = 'submitted'").select("source_id", F.lower(F.trim("user_id")).alias("user_id")).distinct()
    return table(spark, sf_dir, "reviewers").join(r, "user_id", "left").groupBy("user_id", "slot").agg(F.count("source_id").alias("n_submitted"))


@query("""select s.source_id, w.user_id, r.n is not null as reviewed, s.common_blind = 1 as shared from sources s join reviewers w on s.common_blind = 1 and w.slot < 3 or s.owner_slot = w.slot
  left join (select source_id, lower(trim(user_id)) as user_id, count(*) as n from direct_label_reviews group by 1, 2) r on r.source_id = s.source_id and r.user_id = w.user_id""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reviewer's queue: own sources, for the first three also shared ones, with whether a review is there (J-24, W-10)."""
    s, w = table(spark, sf_dir, "sources"), table(spark, sf_dir, "reviewers").select("user_id", "slot")
    slots = F.array_union(F.array("owner_slot"), F.when(F.col("common_blind") == 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")))
    mine = s.select("source_id", "common_blind", F.explode(slots).alias("slot")).join(w, "slot")
    r = table(spark, sf_dir, "direct_label_reviews").select("source_id", F.lower(F.trim("user_id")).alias("user_id")).distinct().withColumn("seen", F.lit(True))
    return mine.join(r, ["source_id", "user_id"], "left").select("source_id", "user_id", F.col("seen").isNotNull().alias("reviewed"), (F.col("common_blind") == 1).alias("shared"))


@query("""select count(*) as n_reviews, count(*) filter (s.source_id is null) as n_unknown_source, count(*) filter (w.user_id is null) as n_unknown_user from direct_label_reviews r left join sources s using (source_id) left join reviewers w on w.user_id = lower(trim(r.user_id))""")
def review_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of unknown sources and by unknown reviewers (J-25, U-02)."""
    r = table(spark, sf_dir, "direct_label_reviews").select("source_id", F.lower(F.trim("user_id")).alias("user_id"))
    s = table(spark, sf_dir, "sources").select("source_id", F.lit(1).alias("a"))
    w = table(spark, sf_dir, "reviewers").select("user_id", F.lit(1).alias("b"))
    return r.join(s, "source_id", "left").join(w, "user_id", "left").agg(F.count("*").alias("n_reviews"), F.count_if(F.col("a").isNull()).alias("n_unknown_source"), F.count_if(F.col("b").isNull()).alias("n_unknown_user"))


@query("select unnest(range(0, 30))::bigint as slot except select slot::bigint from reviewers")
def free_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots below thirty that no reviewer has (J-26)."""
    return spark.range(30).toDF("slot").join(table(spark, sf_dir, "reviewers").select(F.col("slot").cast("long")), "slot", "left_anti")


@query("""select leakage_group_id, count(distinct overlap_family) as n_families, count(distinct record_id) as n_records from leakage_records where leakage_group_id is not null group by 1 having count(distinct upper(trim(overlap_family))) > 1""")
def partition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose records are in several families (A-13, P-33)."""
    r = table(spark, sf_dir, "leakage_records").where("leakage_group_id is not null")
    g = r.groupBy("leakage_group_id").agg(F.count_distinct("overlap_family").alias("n_families"), F.count_distinct("record_id").alias("n_records"), F.count_distinct(F.upper(F.trim("overlap_family"))).alias("k"))
    return g.where("k > 1").drop("k")


@query("""with r as (select distinct record_id, leakage_group_id, identity_complete, upper(trim(overlap_family)) as f, dataset from leakage_records), p as (select * from r where dataset = 'manual')
  select record_id, case when leakage_group_id in (select leakage_group_id from p where leakage_group_id is not null) then 'group' else 'family' end as reason from r where dataset <> 'manual' and (coalesce(leakage_group_id in (select leakage_group_id from p where leakage_group_id is not null), false) or (not identity_complete and f in (select f from p)))""")
def training_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept from training by a protected record of their group, or of their family if their identity is open (J-15, J-16)."""
    r = table(spark, sf_dir, "leakage_records").select("record_id", "leakage_group_id", "identity_complete", F.upper(F.trim("overlap_family")).alias("f"), "dataset").distinct()
    p = r.where("dataset = 'manual'")
    groups, families = p.select("leakage_group_id").where("leakage_group_id is not null").distinct().withColumn("g", F.lit(True)), p.select("f").distinct().withColumn("h", F.lit(True))
    j = r.where("dataset <> 'manual'").join(groups, "leakage_group_id", "left").join(families, "f", "left")
    return j.where("g or (not identity_complete and h)").select("record_id", F.when(F.col("g"), "group").otherwise("family").alias("reason"))


@query("""with a as (select o_orderpriority as k, count(*) as n from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' group by 1), b as (select o_orderpriority as k, count(*) as n from orders join customer on c_custkey = o_custkey where c_mktsegment = 'MACHINERY' group by 1)
  select k, least(coalesce(a.n, 0), coalesce(b.n, 0)) as n_both, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) as n_only_first from a full join b using (k)""")
def multiset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset intersection and difference of two sets of values, by counts (U-03)."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("a"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("b")).where("a + b > 0")
    return g.select("k", F.least("a", "b").alias("n_both"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("n_only_first"))


_RANK = "sha256('2026' || chr(0) || doc_id::varchar)"


@query(f"select doc_id, source from (select distinct doc_id, source from documents) qualify row_number() over (partition by source order by {_RANK}, doc_id) <= 3")
def sampled_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each source, the first in hash order (W-04, W-05, T-16, F-07)."""
    return bottom_k(table(spark, sf_dir, "documents").select("doc_id", "source").distinct(), ["source"], "doc_id", 3, "2026")


@query("""with n as (select source, count(distinct doc_id) as n from documents group by source), q as (select source, n, 200.0 * n / sum(n) over () as q from n), f as (select source, n, floor(q)::bigint as b, round(q - floor(q), 9) as r from q),
  s as (select *, row_number() over (order by r desc, source) as k, 200 - sum(b) over () as left_over from f) select source, n, (b + case when k <= left_over then 1 else 0 end)::bigint as quota from s""")
def source_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred places by largest remainders (T-11, T-13)."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("doc_id").alias("n"))
    return largest_remainder(n, "source", "n", 200)


@query(f"""with d as (select distinct doc_id, source from documents), n as (select source, count(*) as n from d group by source), q as (select source, 200.0 * n / sum(n) over () as q from n), f as (select source, floor(q)::bigint as b, round(q - floor(q), 9) as r from q),
  s as (select source, b, row_number() over (order by r desc, source) as k, 200 - sum(b) over () as left_over from f), u as (select source, b + case when k <= left_over then 1 else 0 end as quota from s),
  x as (select doc_id, source, row_number() over (partition by source order by {_RANK}, doc_id) as rank from d) select doc_id, source from x join u using (source) where rank <= quota""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred documents, each source by its quota in hash order (T-14, W-05)."""
    return stratified_quota(table(spark, sf_dir, "documents").select("doc_id", "source").distinct(), "source", "doc_id", 200, "2026")


@query(f"""with x as (select doc_id, source, row_number() over (partition by source order by {_RANK}, doc_id) as rank from (select distinct doc_id, source from documents)) select doc_id, source, row_number() over (order by rank, source) as place from x qualify place <= 100""")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents taken from the sources in turn (W-06)."""
    return round_robin(table(spark, sf_dir, "documents").select("doc_id", "source").distinct(), "source", "doc_id", 100, "2026")


@query("""select email_id, substr(sha256(coalesce(message_id, '') || chr(0) || email_id || chr(0) || body_digest), 1, 24) as identity from (select distinct email_id, message_id, body_digest from parsed_messages)""")
def message_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message's identity by its id and body (F-02, F-03)."""
    p = table(spark, sf_dir, "parsed_messages").select("email_id", "message_id", "body_digest").distinct()
    return p.select("email_id", F.substring(F.sha2(F.concat_ws("\u0000", T.text(F.col("message_id")), "email_id", "body_digest"), 256), 1, 24).alias("identity"))


@query(f"""with {_ONE}, v as (select source_id, list_filter([case when coalesce(trim(sender), '') = '' then 'sender' end, case when coalesce(body_raw, '') = '' then 'body' end, case when {_THREAD} is null then 'thread' end, case when recipients_json is null or recipients_json[1] <> '[' then 'recipients' end], lambda x: x is not null) as v from one)
  select array_to_string(v, ',') as violations, count(*) as n_mails from v group by 1""")
def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails by the fields that are not as they should be (P-31, P-32)."""
    bad = lambda c, name: F.when(c, F.lit(name))
    v = F.array_compact(F.array(bad(F.trim(T.text(F.col("sender"))) == "", "sender"), bad(T.text(F.col("body_raw")) == "", "body"), bad(valued(F.col("thread_id")).isNull(), "thread"), bad(F.col("recipients_json").isNull() | ~F.col("recipients_json").startswith("["), "recipients")))
    return _mails(spark, sf_dir).groupBy(F.array_join(v, ",").alias("violations")).agg(F.count("*").alias("n_mails"))


@query(f"""with {_ONE} select n_named, count(*) as n_mails from (select source_id, len(list_distinct(list_filter(string_split_regex(lower(coalesce(references_json, '')), '[\\s<>\\[\\]",;]+'), lambda x: contains(x, '@')))) as n_named from one) group by 1""")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails by how many messages their references name (P-12, P-13, A-02)."""
    return _mails(spark, sf_dir).groupBy(F.size(message_ids(F.col("references_json"))).alias("n_named")).agg(F.count("*").alias("n_mails"))


@query("""with t as (select user_id, event_id, ts, event_type from events), c as (select user_id, event_id, string_agg(event_type, '|') over (partition by user_id order by ts, event_id rows between 40 preceding and 1 preceding) as c from t) select user_id, event_id, right(coalesce(c, ''), 60) as context from c""")
def running_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail of what came before each row of a group: at most 60 characters, so a bounded frame is enough (W-02)."""
    cut = Cut(spark)
    rows = numbered(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "n", cut)
    # Blocks of a group, each with the 40 rows before it, stand for the group: none is put in order as a whole.
    rows = rows.withColumn("block", F.floor((F.col("n") - 1) / 1000)).select("*", F.explode(F.when((F.col("n") - 1) % 1000 >= 960, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))).alias("b"))
    w = W.partitionBy("user_id", "b").orderBy("n").rowsBetween(-40, -1)
    told = rows.withColumn("context", F.right(F.array_join(F.collect_list("event_type").over(w), "|"), F.lit(60)))
    return told.where("b = block").select("user_id", "event_id", "context")
