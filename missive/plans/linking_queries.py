"""Queries on links between mails and between texts: reciprocal replies, contained and near texts, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions import text as T
from missive.functions.ids import bare, message_ids, valued
from missive.functions.text import rank_key
from missive.operators.joins import reciprocal_links
from missive.operators.sampling import balanced_pick, whole_groups
from missive.operators.similarity import similar_pairs
from missive.plans.registry import query
from missive.plans.relational_queries import _NONE, _ONE, _THREAD, _mails
from missive.plans.text_queries import _TOKENS, CATEGORIES, categories, cue_sql, cues
from missive.session import Cut, table

_ADDRESSES = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9._%+''-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'))"
# How subjects are compared when replies are sought, and the least that tells one from another.
_REPLY = r"^(\s*(re|fwd?)\s*:\s*)+"
_SUBJECT = r"trim(regexp_replace(regexp_replace(lower(coalesce(subject, '')), '^(\s*(re|fwd?)\s*:\s*)+', ''), '\s+', ' ', 'g'))"
MIN_SUBJECT_WORDS, MIN_SUBJECT_CHARS, GAP_DAYS = 3, 16, 7
_LINKS = rf"""{_ONE}, t as (select *, {_THREAD} as thread, {_SUBJECT} as subj, {_ADDRESSES.format("sender")} as s, {_ADDRESSES.format("recipients_json")} as people from one),
  k as (select source_id, subj, s[1] as sender, people, imported_at as at, regexp_matches(coalesce(subject, ''), '(?i)^\s*re\s*:') as is_reply from (select *, count(*) over (partition by coalesce('t' || thread, 'm' || source_id)) as members from t)
    where members = 1 and length(subj) >= {MIN_SUBJECT_CHARS} and len(string_split(subj, ' ')) >= {MIN_SUBJECT_WORDS} and len(s) = 1),
  e as (select a.source_id as earlier_id, b.source_id as later_id from k a join k b on a.subj = b.subj and a.sender <> b.sender and list_contains(b.people, a.sender) and list_contains(a.people, b.sender) and b.is_reply and a.at < b.at and a.at >= b.at - interval {GAP_DAYS} days),
  n as (select id from (select earlier_id as id from e union all select later_id from e) group by id having count(*) = 1),
  l as (select earlier_id, later_id from e where earlier_id in (select id from n) and later_id in (select id from n))"""


def _linkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mails(spark, sf_dir)
    subject = F.trim(F.regexp_replace(F.regexp_replace(F.lower(T.text(F.col("subject"))), _REPLY, ""), r"\s+", " "))
    t = m.select("source_id", subject.alias("subj"), T.addresses(F.col("sender")).alias("s"), T.addresses(F.col("recipients_json")).alias("people"), F.unix_micros(F.col("imported_at").cast("timestamp")).alias("at"), T.text(F.col("subject")).rlike(r"(?i)^\s*re\s*:").alias("is_reply"), valued(F.col("thread_id")).alias("thread"))
    many = t.where("thread is not null").groupBy("thread").agg(F.count("*").alias("n")).where("n > 1").select("thread")
    single = t.join(many, "thread", "left_anti")
    return single.where((F.length("subj") >= MIN_SUBJECT_CHARS) & (F.size(F.split("subj", " ")) >= MIN_SUBJECT_WORDS) & (F.size("s") == 1)).select(F.col("source_id").alias("key"), F.col("subj").alias("subject"), F.col("s")[0].alias("sender"), "people", "at", "is_reply")


@query(f"with {_LINKS} select earlier_id, later_id, substr(sha256(least(earlier_id, later_id) || chr(10) || greatest(earlier_id, later_id)), 1, 20) as secondary_thread_id from l")
def secondary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of single threads that answer each other by subject, people and time, with no other partner (J-03, J-04).

    The time is that of the import, which SQL can read as well as the operator. No subject is too common (J-05).
    """
    found = reciprocal_links(_linkable(spark, sf_dir), GAP_DAYS * 86_400_000_000)
    return found.select("earlier_id", "later_id", F.substring(F.sha2(F.concat_ws("\n", F.least("earlier_id", "later_id"), F.greatest("earlier_id", "later_id")), 256), 1, 20).alias("secondary_thread_id"))


@query(f"""with {_LINKS} select o.source_id, coalesce(a.later_id, b.earlier_id) as partner_id, case when a.later_id is not null then 0 when b.earlier_id is not null then 1 else -1 end as turn,
  case when b.earlier_id is not null then sha256(coalesce(p.body_raw, '')) end as context from one o left join l a on a.earlier_id = o.source_id left join l b on b.later_id = o.source_id left join one p on p.source_id = b.earlier_id""")
def linked_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mail with its partner and place in the pair (-1: none), the later with the earlier one's text as context (J-06)."""
    links, one = secondary_links(spark, sf_dir), _mails(spark, sf_dir).select("source_id", "body_raw")
    said = one.select(F.col("source_id").alias("partner_id"), F.sha2(T.text(F.col("body_raw")), 256).alias("context"))
    first = links.select(F.col("earlier_id").alias("source_id"), F.col("later_id").alias("partner_id"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("context"))
    later = links.select(F.col("later_id").alias("source_id"), F.col("earlier_id").alias("partner_id"), F.lit(1).alias("turn")).join(said, "partner_id").select("source_id", "partner_id", "turn", "context")
    return one.select("source_id").join(first.unionAll(later), "source_id", "left").fillna(-1, "turn")


@query(f"""with {_LINKS}, b as (select subj, count(*) as n from k group by subj) select count(*) as n_subjects, coalesce(sum(n), 0)::bigint as n_mails, count(*) filter (n > 100) as n_common_subjects, coalesce(sum(n) filter (n > 100), 0)::bigint as n_common_mails from b""")
def subject_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that may be linked and their subjects, those of more than a hundred mails told apart (J-05)."""
    b = _linkable(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"))
    return b.agg(F.count("*").alias("n_subjects"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_mails"), F.count_if(F.col("n") > 100).alias("n_common_subjects"), F.coalesce(F.sum(F.when(F.col("n") > 100, F.col("n"))), F.lit(0)).alias("n_common_mails"))


_PAIRS = rf"""t as (select doc_id, max(array_to_string({_TOKENS}, ' ')) as j, max(length(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')))) as chars from documents group by doc_id),
  r as (select j, min(doc_id) as key from t where j <> '' group by j), q as (select r.key, r.j, t.chars, len(string_split(r.j, ' ')) as words from r join t on t.doc_id = r.key),
  s as (select distinct key, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) as x from (select key, string_split(j, ' ') as w from q) where len(w) >= 5), n as (select key, count(*) as n from s group by key),
  m as (select a.key as a, b.key as b, count(*) as k from s a join s b on a.x = b.x and a.key <> b.key group by 1, 2),
  p as (select m.a, m.b, na.n as n_a, nb.n as n_b, m.k as n_shared, qa.words as words_a, qb.words as words_b, qa.chars as chars_a, qb.chars as chars_b, m.k = na.n and contains(' ' || qb.j || ' ', ' ' || qa.j || ' ') as ordered
    from m join n na on na.key = m.a join n nb on nb.key = m.b join q qa on qa.key = m.a join q qb on qb.key = m.b where (na.n < nb.n or (na.n = nb.n and m.a < m.b)) and m.k >= na.n * 0.9)"""
_REASON = """case when ordered and words_a >= 20 and chars_a >= 120 then 'ordered containment' when least(words_a, words_b) < 20 or least(chars_a, chars_b) < 120 then null
  when least(words_a, words_b) * 1.0 / greatest(words_a, words_b) >= 0.9 and n_shared * 1.0 / (n_a + n_b - n_shared) >= 0.92 then 'near shingles' when words_a * 1.0 / words_b >= 0.5 and n_shared * 1.0 / n_a >= 0.95 then 'long containment' end"""


@query(f"with {_PAIRS}, x as (select a, b, n_shared, {_REASON} as reason from p) select a, b, n_shared, reason from x where reason is not null")
def leakage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct texts by ordered containment, near shingles or containment of a long body, in that order (J-10, J-11, J-12)."""
    pairs, _ = similar_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", Cut(spark), words=20)  # as all reasons ask for
    return pairs.select("a", "b", F.col("n_shared").cast("long").alias("n_shared"), F.expr(_REASON.replace("1.0", "1.0D")).alias("reason")).where("reason is not null")


@query(f"with {_PAIRS}, d as (select doc_id, max(source) as source from documents group by doc_id) select a, b, n_shared from p join d x on x.doc_id = a join d y on y.doc_id = b where x.source <> y.source and n_a >= 16 and n_a * 1.0 / n_b >= 0.85 and n_shared * 1.0 / (n_a + n_b - n_shared) >= 0.9")
def cross_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near texts under different sources, by shingles alone (J-13)."""
    d = table(spark, sf_dir, "documents")
    pairs, _ = similar_pairs(d, "doc_id", "text", Cut(spark), words=20)  # 16 shingles have as many
    of = d.groupBy("doc_id").agg(F.max("source").alias("source"))
    both = pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").where("x <> y and n_a >= 16 and n_a / n_b >= 0.85 and n_shared / (n_a + n_b - n_shared) >= 0.9")
    return both.select("a", "b", F.col("n_shared").cast("long").alias("n_shared"))


# ---- candidates: cues in what a mail says itself (direct) and in what it quotes (context)

_PLAIN = r"translate(replace(replace(regexp_replace(coalesce(body_raw, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), chr(8239), ' '), chr(8203) || chr(65279), '')"
_BOUND = r"(?i)^(>.*|-{2,}\s*(original message|forwarded message|forwarded by)\b.*|on .{4,}\s+wrote:\s*|from:\s+\S.*|--\s*)$"
_CATS = lambda column: "list_filter([" + ", ".join("case when " + " or ".join(cue_sql(n, column) for n in names) + f" then {i} end" for i, names in enumerate(CATEGORIES.values())) + "], lambda x: x is not null)"
_POOL = rf"""{_ONE}, v as (select source_id, coalesce({_THREAD}, 'm' || source_id) as thread, subject, string_split({_PLAIN}, chr(10)) as l from one),
  w as (select *, list_position(list_transform(l, lambda x, i: i > 1 and regexp_matches(trim(x), '{_BOUND}')), true) as cut from v),
  z as (select source_id, thread, coalesce(subject, '') || chr(10) || array_to_string(case when cut > 0 then l[1:cut-1] else l end, chr(10)) as said, case when cut > 0 then array_to_string(l[cut:], chr(10)) else '' end as quoted from w),
  c as (select source_id, thread, {_CATS("said")} as direct, {_CATS("quoted")} as context, sha256('2026' || chr(0) || source_id) as rank from z),
  nd as (select x, count(*) as n from (select unnest(direct) as x from c) group by x), nc as (select x, count(*) as n from (select unnest(context) as x from c) group by x),
  u as (select source_id, thread, rank, len(direct) > 0 as is_direct, unnest(case when len(direct) > 0 then direct else context end) as x from c where len(direct) + len(context) > 0),
  o as (select source_id, thread, rank, is_direct, x from (select u.*, row_number() over (partition by source_id order by case when is_direct then nd.n else nc.n end, u.x) as k from u left join nd using (x) left join nc using (x)) where k = 1)"""


def _pool(spark: SparkSession, sf_dir: str, cut: Cut) -> DataFrame:
    """(source_id, thread, rank, is_direct, x) of mails with cues: x is the number of the rarest of their categories."""
    m = _mails(spark, sf_dir).select("source_id", F.coalesce(valued(F.col("thread_id")), F.concat(F.lit("m"), "source_id")).alias("thread"), "subject", F.split(T.plain_lines(F.col("body_raw")), "\n").alias("l"))
    bound = F.array_position(F.transform("l", lambda x, i: (i > 0) & F.trim(x).rlike(T.BOUNDARY)), F.lit(True)).cast("int")
    m = m.withColumn("cut", bound)
    said = F.when(F.col("cut") > 0, F.slice("l", F.lit(1), F.col("cut") - 1)).otherwise(F.col("l"))
    quoted = F.when(F.col("cut") > 0, F.array_join(F.slice("l", F.col("cut"), F.size("l")), "\n")).otherwise(F.lit(""))
    names = F.array(*map(F.lit, CATEGORIES))
    numbers = lambda c: F.transform(categories(cues(c)), lambda x: (F.array_position(names, x) - 1).cast("int"))
    c = m.select("source_id", "thread", F.concat_ws("\n", T.text(F.col("subject")), F.array_join(said, "\n")).alias("said"), quoted.alias("quoted"))
    c = cut.keep(c.select("source_id", "thread", numbers(F.col("said")).alias("direct"), numbers(F.col("quoted")).alias("context"), rank_key("2026", F.col("source_id")).alias("rank")))
    n = c.select(F.explode("direct").alias("x"), F.lit(True).alias("is_direct")).unionAll(c.select(F.explode("context"), F.lit(False))).groupBy("x", "is_direct").agg(F.count("*").alias("n"))
    u = c.select("source_id", "thread", "rank", (F.size("direct") > 0).alias("is_direct"), F.explode(F.when(F.size("direct") > 0, F.col("direct")).otherwise(F.col("context"))).alias("x"))
    best = u.join(n, ["x", "is_direct"]).groupBy("source_id", "thread", "rank", "is_direct").agg(F.min(F.struct("n", "x")).alias("b"))
    return cut.keep(best.select("source_id", "thread", "rank", "is_direct", "b.x"))


TARGET = 200


@query(f"""with {_POOL}, s as (select count(*) filter (is_direct) as d, count(*) filter (not is_direct) as q from o), a as (select least(d, {TARGET} - least(q, {TARGET} // 5)) as d, q from s), b as (select d, least(q, {TARGET} - d) as q from a),
  kd as (select *, row_number() over (partition by x order by rank, source_id) as n from o where is_direct), pd as (select * from kd qualify row_number() over (order by n, x, rank, source_id) <= (select d from b)),
  taken as (select x, count(*) as t from pd group by x), kq as (select o.*, coalesce(t, 0) + row_number() over (partition by o.x order by rank, source_id) as n from o left join taken using (x) where not is_direct),
  pq as (select * from kq qualify row_number() over (order by n, x, rank, source_id) <= (select q from b)) select source_id, x as category_no, 'direct' as kind from pd union all select source_id, x, 'context' from pq""")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred mails with cues, a fifth of them only in what they quote, the next always of the category with fewest (T-01, T-02, W-07)."""
    pool = _pool(spark, sf_dir, Cut(spark))
    n = pool.agg(F.count_if("is_direct").alias("d"), F.count_if(~F.col("is_direct")).alias("q")).first()
    direct = min(n["d"], TARGET - min(n["q"], TARGET // 5))
    first = balanced_pick(pool.where("is_direct"), "x", "x", "rank", "source_id", direct)
    rest = balanced_pick(pool.where("not is_direct"), "x", "x", "rank", "source_id", min(n["q"], TARGET - direct), first.groupBy("x").agg(F.count("*").alias("taken")))
    kind = F.when(F.col("is_direct"), "direct").otherwise("context").alias("kind")
    return first.unionAll(rest).select("source_id", F.col("x").alias("category_no"), kind)


@query(f"""with {_POOL}, sizes as (select thread, count(*) as n from v group by thread), g as (select thread, bool_or(is_direct) as has from o group by thread), y as (select o.thread, o.x from o join g using (thread) where o.is_direct = g.has),
  yn as (select x, count(*) as n from y group by x), h as (select thread, x from (select distinct y.thread, y.x, yn.n from y join yn using (x)) qualify row_number() over (partition by thread order by n, x) = 1),
  r as (select thread, x, row_number() over (partition by x order by sha256('2026' || chr(0) || thread), thread) as k from h), w2 as (select r.*, n, coalesce(sum(n) over (order by k, x rows between unbounded preceding and 1 preceding), 0) as before from r join sizes using (thread))
  select thread, x as category_no, n as n_mails from w2 where before < {TARGET}""")
def whole_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole threads with cues, from the categories in turn, until two hundred mails are reached (T-05, T-01)."""
    cut = Cut(spark)
    pool = _pool(spark, sf_dir, cut)
    sizes = _mails(spark, sf_dir).groupBy(F.coalesce(valued(F.col("thread_id")), F.concat(F.lit("m"), "source_id")).alias("thread")).agg(F.count("*").alias("n"))
    g = pool.groupBy("thread").agg(F.bool_or("is_direct").alias("has"))
    y = cut.keep(pool.join(g, "thread").where("is_direct = has").select("thread", "x"))
    of = y.groupBy("x").agg(F.count("*").alias("many"))
    h = y.join(of, "x").groupBy("thread").agg(F.min(F.struct("many", "x")).alias("b")).select("thread", "b.x", rank_key("2026", F.col("thread")).alias("rank"))
    first = balanced_pick(h, "x", "x", "rank", "thread", TARGET)  # more threads than mails are never taken
    turn = F.expr("row_number() over (partition by x order by rank, thread)")
    chosen = whole_groups(first.withColumn("k", turn).join(sizes, "thread"), "n", ["k", "x"], TARGET)
    return chosen.select("thread", F.col("x").alias("category_no"), F.col("n").alias("n_mails"))


_PART = "list_filter(string_split_regex(lower(coalesce({}, '')), '[\\s<>\\[\\]\",;]+'), lambda x: contains(x, '@'))"


@query(f"""with {_ONE}, e as (select source_id, {_THREAD} as t, ({_PART.format("references_json")})[1] as r, ({_PART.format("in_reply_to")})[1] as p, lower(trim(message_id, e' \\t<>')) as m from one),
  k as (select source_id, case when t is not null then 'thread:' || t when r is not null then 'message:' || r when p is not null then 'message:' || p when m <> '' and m not in {_NONE} then 'message:' || m else 'mail:' || source_id end as thread from e)
  select thread, count(*) as n_mails, min(source_id) as first_id from k group by thread""")
def effective_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads by the first that a mail has of: its thread, its first reference, what it replies to, its id, itself (P-14)."""
    first = lambda c: F.get(message_ids(F.col(c)), 0)
    key = F.coalesce(F.concat(F.lit("thread:"), valued(F.col("thread_id"))), F.concat(F.lit("message:"), F.coalesce(first("references_json"), first("in_reply_to"), bare(F.col("message_id")))), F.concat(F.lit("mail:"), "source_id"))
    return _mails(spark, sf_dir).groupBy(key.alias("thread")).agg(F.count("*").alias("n_mails"), F.min("source_id").alias("first_id"))


@query(rf"with {_ONE}, k as (select {_SUBJECT} as subject, source_name from one) select subject, count(*) as n_mails, count(distinct source_name) as n_sources from k group by 1")
def subject_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails by subject without reply and forward prefixes, punctuation kept (P-10)."""
    subject = F.trim(F.regexp_replace(F.regexp_replace(F.lower(T.text(F.col("subject"))), _REPLY, ""), r"\s+", " "))
    return _mails(spark, sf_dir).groupBy(subject.alias("subject")).agg(F.count("*").alias("n_mails"), F.count_distinct("source_name").alias("n_sources"))


@query(r"""with d as (select distinct doc_id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://\S+|www\.\S+', ' SLOT ', 'g'), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', ' SLOT ', 'g'), '\d+', ' SLOT ', 'g') as t from documents),
  w as (select doc_id, list_sort(list_distinct(regexp_extract_all(t, 'SLOT|[a-z]{3,}'))) as w from d) select doc_id, len(w) as n_words, sha256(array_to_string(w, ' ')) as digest from w""")
def diversity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of three letters or more of each text, with links, addresses and numbers as one slot (P-16)."""
    t = F.lower(T.text(F.col("text")))
    for pattern in (r"https?://\S+|www\.\S+", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"\d+"):
        t = F.regexp_replace(t, pattern, " SLOT ")
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).distinct()
    w = F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(SLOT|[a-z]{3,})"))))
    return d.select("doc_id", F.size(w).cast("long").alias("n_words"), F.sha2(F.array_join(w, " "), 256).alias("digest"))


@query("""select user_id, source_id, submitted_at, row_number() over (partition by user_id order by submitted_at is null, submitted_at desc, source_id, revision) as place from
  (select distinct lower(trim(user_id)) as user_id, source_id, submitted_at, revision from direct_label_reviews) qualify place <= 20""")
def recent_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reviewer's twenty latest reviews, those without a time last (W-09)."""
    r = table(spark, sf_dir, "direct_label_reviews").select(F.lower(F.trim("user_id")).alias("user_id"), "source_id", "submitted_at", "revision").distinct()
    place = F.expr("row_number() over (partition by user_id order by submitted_at desc nulls last, source_id, revision)")
    return r.withColumn("place", place).where("place <= 20").select("user_id", "source_id", "submitted_at", "place")


@query("""with c as (select distinct record_id, leakage_group_id as g, dataset from leakage_records where leakage_group_id is not null), n as (select g, count(distinct dataset) as d from c group by g)
  select c.dataset, count(distinct c.record_id) as n_records, count(distinct c.record_id) filter (n.d > 1) as n_shared, count(distinct c.g) filter (n.d > 1) as n_shared_groups from c join n using (g) group by 1""")
def overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each dataset whose group another dataset has too (A-12, J-23)."""
    c = table(spark, sf_dir, "leakage_records").where("leakage_group_id is not null").select("record_id", F.col("leakage_group_id").alias("g"), "dataset").distinct()
    j = c.join(c.groupBy("g").agg(F.count_distinct("dataset").alias("d")), "g")
    shared = F.col("d") > 1
    return j.groupBy("dataset").agg(F.count_distinct("record_id").alias("n_records"), F.count_distinct(F.when(shared, F.col("record_id"))).alias("n_shared"), F.count_distinct(F.when(shared, F.col("g"))).alias("n_shared_groups"))
