"""Queries on text: normalization, fingerprints, duplicates, cues, windows and terms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions import text as T
from missive.operators.fingerprints import fingerprints
from missive.operators.similarity import cosine_top, near_duplicates
from missive.plans.registry import query
from missive.session import Cut, table

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
# The oracle folds characters one by one, by a table made from the Unicode data that Python has, and composes them again.
_FOLDS = {chr(c): f for c in range(0x80, 0x1F800) if not 0xAC00 <= c < 0xD7B0 and (f := unicodedata.normalize("NFKC", chr(c)).casefold()) != chr(c)}
_FOLD_ROWS = ", ".join("('{}', '{}')".format(c, f.replace("'", "''")) for c, f in _FOLDS.items())


def _folded_sql(column: str) -> str:
    """CTEs that give (doc_id, s) with a column of d folded; u are its other characters than ASCII ones."""
    return rf"""u_{column} as (select doc_id, unnest(string_split(lower({column}), '')) as c, unnest(range(length({column}))) as i from (select doc_id, coalesce({column}, '') as {column} from d) where regexp_matches({column}, '[^\x00-\x7f]')),
  x_{column} as (select doc_id, nfc_normalize(string_agg(coalesce(t, c), '' order by i)) as s from u_{column} left join folds using (c) group by doc_id),
  f_{column} as (select d.doc_id, coalesce(x.s, lower(coalesce(d.{column}, ''))) as s from d left join x_{column} x using (doc_id))"""


def _fingers(d: str) -> str:
    return rf"""
  with d as ({d}), folds(c, t) as (values {_FOLD_ROWS}), {_folded_sql("text")}, {_folded_sql("title")},
  b as (select d.doc_id, d.source, trim(regexp_replace(f_text.s, '[\s\x1c-\x1f\x{{85}}\x{{2028}}\x{{2029}}]+', ' ', 'g')) as b, regexp_extract_all(f_text.s, '[\p{{L}}\p{{N}}]+') as t,
    array_to_string(regexp_extract_all(regexp_replace(trim(f_title.s), '^((re|fw|fwd|aw|sv)\s*:\s*)+', ''), '[\p{{L}}\p{{N}}]+'), ' ') as s from d join f_text using (doc_id) join f_title using (doc_id)),
  f as (select *, array_to_string(t, ' ') as j, array_to_string(t, '') as c, length(b) >= 80 and len(t) >= 12 as ok from b)
"""


_FINGERS = _fingers("select distinct doc_id, text, title, source from documents")
_MAIL_FINGERS = _fingers("select source_id as doc_id, subject as text, project_or_list as title, source_name as source from emails qualify row_number() over (partition by source_id order by imported_at, body_sha256) = 1")


@query(r"""select source_id, length(p) as n_chars, sha256(p) as digest from (select distinct source_id,
  translate(replace(replace(regexp_replace(coalesce(body_raw, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), chr(8239), ' '), chr(8203) || chr(65279), '') as p from emails)""")
def plain_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with line ends and spaces made plain (P-02)."""
    p = table(spark, sf_dir, "emails").select("source_id", T.plain_lines(F.col("body_raw")).alias("p")).distinct()
    return p.select("source_id", F.length("p").alias("n_chars"), F.sha2("p", 256).alias("digest"))


@query(r"""with p as (select distinct source_id, string_split(translate(replace(replace(regexp_replace(coalesce(body_raw, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), chr(8239), ' '), chr(8203) || chr(65279), ''), chr(10)) as l from emails),
  c as (select source_id, l, list_position(list_transform(l, lambda x, i: i > 1 and regexp_matches(trim(x), '(?i)^(>.*|-{2,}\s*(original message|forwarded message|forwarded by)\b.*|on .{4,}\s+wrote:\s*|from:\s+\S.*|--\s*)$')), true) as k from p)
  select source_id, sha256(regexp_replace(array_to_string(case when k > 0 then l[1:k-1] else l end, chr(10)), '^\s+|\s+$', '', 'g')) as digest, coalesce(k, 0)::int as cut_line from c""")
def authored_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text before the first boundary line (P-03, P-06), and that line's number (0: none)."""
    mails = table(spark, sf_dir, "emails").select("source_id", "body_raw").distinct()
    lines = F.split(T.plain_lines(F.col("body_raw")), "\n")
    cut = F.array_position(F.transform(lines, lambda x, i: (i > 0) & F.trim(x).rlike(T.BOUNDARY)), F.lit(True))
    return mails.select("source_id", F.sha2(T.authored(F.col("body_raw")), 256).alias("digest"), cut.cast("int").alias("cut_line"))


@query(_FINGERS + """select doc_id, case when ok then sha256(b) end as body_exact, case when ok then sha256(j) end as body_tokens, case when ok then sha256(c) end as body_compact,
  case when ok and s <> '' then sha256(s || chr(0) || c) end as subject_body, case when not ok and b <> '' then sha256(b) end as short_exact, case when not ok and j <> '' then sha256(j) end as short_tokens,
  length(b) as n_chars, len(t) as n_tokens, ok as eligible from f""")
def body_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, word, compact and subject fingerprints of documents (F-01, P-07 to P-09)."""
    return fingerprints(table(spark, sf_dir, "documents").dropDuplicates(["doc_id"]), "doc_id", "title", "text")


@query(_FINGERS + "select sha256(j) as body_tokens, min(doc_id) as group_id, count(*) as n_docs, count(distinct source) as n_sources from f where ok group by j having count(*) > 1")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same words (A-08)."""
    d = table(spark, sf_dir, "documents").dropDuplicates(["doc_id"])
    f = fingerprints(d, "doc_id", "title", "text").where("eligible").join(d.select("doc_id", "source"), "doc_id")
    return f.groupBy("body_tokens").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources")).where("n_docs > 1")


@query(_FINGERS + """, g as (select j, count(*) filter (source like 'archive%') as a, count(*) filter (source not like 'archive%') as o from f where ok group by j)
  select count(*) filter (a > 0 and o > 0) as n_signatures, coalesce(sum(a * o), 0)::bigint as n_pairs, coalesce(sum(a) filter (o > 0), 0)::bigint as n_archive_docs from g""")
def cross_source_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures shared between the archive's sources and others, and the pairs they stand for (A-09)."""
    d = table(spark, sf_dir, "documents").dropDuplicates(["doc_id"])
    f = fingerprints(d, "doc_id", "title", "text").where("eligible").join(d.select("doc_id", "source"), "doc_id")
    g = f.groupBy("body_tokens").agg(F.count_if(F.col("source").like("archive%")).alias("a"), F.count_if(~F.col("source").like("archive%")).alias("o"))
    return g.agg(F.count_if((F.col("a") > 0) & (F.col("o") > 0)).alias("n_signatures"), F.coalesce(F.sum(F.col("a") * F.col("o")), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("o") > 0, F.col("a"))), F.lit(0)).alias("n_archive_docs"))


@query(_MAIL_FINGERS + """select sha256(j) as short_tokens, count(*) as n_mails, min(doc_id) as first_mail, max(doc_id) as last_mail, count(distinct source) as n_sources from f where not ok and j <> '' group by j having count(*) > 1""")
def short_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of mails whose subjects, short texts that tie nothing, have the same words, with their members' bounds (A-10)."""
    m = table(spark, sf_dir, "emails").groupBy("source_id").agg(F.min_by(F.struct("project_or_list", "subject", "source_name"), F.struct("imported_at", "body_sha256")).alias("m")).select("source_id", "m.*")
    f = fingerprints(m, "source_id", "project_or_list", "subject").where("short_tokens is not null").join(m.select("source_id", "source_name"), "source_id")
    return f.groupBy("short_tokens").agg(F.count("*").alias("n_mails"), F.min("source_id").alias("first_mail"), F.max("source_id").alias("last_mail"), F.count_distinct("source_name").alias("n_sources")).where("n_mails > 1")


@query(rf"""with t as (select doc_id, max(array_to_string({_TOKENS}, ' ')) as j from documents group by doc_id),
  r as (select j, min(doc_id) as first from t where j <> '' group by j),
  s as (select distinct first, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) as x from (select first, string_split(j, ' ') as w from r) where len(w) >= 5),
  n as (select first, count(*) as n from s group by first),
  p as (select a.first as a, b.first as b, count(*) as k from s a join s b on a.x = b.x and a.first < b.first group by 1, 2),
  l as (select a, b from p join n na on na.first = a join n nb on nb.first = b where k * 1.0 / (na.n + nb.n - k) >= 0.8),
  e as (select a, b from l union all select b, a from l),
  c as (with recursive reach(x, y) as (select first, first from r union select reach.x, e.b from reach join e on reach.y = e.a) select x, min(y) as class_id from reach group by x),
  k as (select a, count(*) as n_links from e group by a)
  select t.doc_id, coalesce(c.class_id, t.doc_id) as class_id, coalesce(k.n_links, 0) as n_links from t left join r using (j) left join c on c.x = r.first left join k on k.a = r.first""")
def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in classes of shared five-word shingles at 0.8, with their links (F-12, J-09 without subjects)."""
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", Cut(spark))


@query(rf"""with d as (select distinct doc_id, text from documents), s as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) as t from d),
  u as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'https?://\S+|www\.\S+', '<url>', 'g'), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}', '<email>', 'g'), '\b\d{{1,4}}[/-]\d{{1,2}}[/-]\d{{1,4}}\b', '<date>', 'g'), '\b\d+([.,]\d+)*\b', '<number>', 'g') as t from s)
  select sha256(t) as template, count(*) as n_docs, min(doc_id) as first_doc from u group by t having count(*) > 1""")
def template_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are the same but for addresses, links, dates and numbers (P-15)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").distinct().select("doc_id", F.sha2(T.template(F.col("text")), 256).alias("template"))
    return d.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


# Fixed values, which must equal those of other tools that mine the same cues: 25 cues in their order, by pattern.
CUES = (
    ("meeting", r"\b(?:meetings?|mtgs?\.?)\b"), ("schedule", r"\bschedul(?:e|ed|ing|es)\b"), ("reschedule", r"\breschedul(?:e|ed|ing|es)\b"), ("agenda", r"\bagenda\b"),
    ("minutes", r"\bminutes?\b|\bmom\b"), ("deadline", r"\bdeadlines?\b"),
    ("due", r"\bdue\s+(?:date|by|on|before|today|tomorrow|immediately|asap|monday|tuesday|wednesday|thursday|friday|saturday|sunday|(?:\d{1,2})(?:st|nd|rd|th)?|jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|no later than|in\s+(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:hours?|days?|weeks?))\b|\bis\s+due\s+(?:on|by|at|today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday|(?:\d{1,2})(?:st|nd|rd|th)?|jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"),
    ("submit", r"\bsubmit(?:s|ted|ting)?\b"), ("report", r"\breports?\b"), ("presentation", r"\bpresentations?\b"), ("approval", r"\bapprov(?:e|es|ed|al|ing)\b"),
    ("review", r"\breviews?\b|\breviewing\b|\breviewed\b"), ("follow_up", r"\bfollow[ -]?up\b"), ("reminder", r"\breminders?\b|\bremind\b"), ("input", r"\binputs?\b"),
    ("action_item", r"\baction items?\b"), ("action", r"\bactions?\b"), ("task", r"\btasks?(?!\s+force)\b|\bto[- ]do\b"), ("assigned", r"\bassign(?:s|ed|ment|ments|ing)?\b"),
    ("pending", r"\bpending\b"), ("update", r"\bupdates?\b|\bupdated\b"), ("attached", r"\battachments?\b|\battached\b"), ("send", r"\bsend(?:s|ing|t)?\b"),
    ("provide", r"\bprovid(?:e|es|ed|ing)\b"), ("complete", r"\bcomplet(?:e|es|ed|ing|ion)\b"),
)
# The categories in their order, with their cues.
CATEGORIES = {
    "meeting": ("meeting", "schedule", "reschedule", "agenda", "minutes"), "deadline": ("deadline", "due"), "report_doc": ("report", "submit", "presentation", "attached", "provide"),
    "department_input": ("input",), "follow_up": ("follow_up", "reminder", "send"), "approval": ("approval", "review"), "update": ("update",),
    "action_task": ("action_item", "action", "task", "assigned", "pending", "complete"),
}
CATEGORY = {cue: category for category, cues in CATEGORIES.items() for cue in cues}


def cue_sql(cue: str, column: str) -> str:
    """Whether a text shows a cue, in SQL; where the pattern looks ahead, what it must not meet is taken out before."""
    pattern = dict(CUES)[cue]
    if "(?!" in pattern:
        column, pattern = f"regexp_replace({column}, '(?i)\\btasks?\\s+force', '#', 'g')", pattern.replace("(?!\\s+force)", "")
    return f"regexp_matches({column}, '(?i){pattern}')"


def cues(text: Column) -> Column:
    """The cues that a text shows, in the order of CUES."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(n)) for n, p in CUES]))


def categories(found: Column) -> Column:
    """The categories of cues, in the order of CATEGORIES."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(found, F.array(*map(F.lit, names))), F.lit(c)) for c, names in CATEGORIES.items()]))


_CUE_ROWS = "\n union all ".join(f"select doc_id, '{n}' as cue, '{CATEGORY[n]}' as category from d where {cue_sql(n, 'text')}" for n, _ in CUES)


@query(f"with d as (select distinct doc_id, text from documents), h as ({_CUE_ROWS}) select category, cue, count(*) as n_docs from h group by category, cue")
def cue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that show each cue, with its category (P-21, P-23, A-05)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").distinct()
    names = F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])
    each = d.select("doc_id", F.explode(cues(F.col("text"))).alias("cue"))
    return each.groupBy(names[F.col("cue")].alias("category"), "cue").agg(F.count("*").alias("n_docs"))


_HAS = {c: " or ".join(cue_sql(n, "text") for n in names) for c, names in CATEGORIES.items()}


@query("with d as (select distinct doc_id, coalesce(text, '') as text from documents), c as (select doc_id, array_to_string(list_filter([" + ", ".join(f"case when {x} then '{c}' end" for c, x in _HAS.items()) + "], lambda x: x is not null), ',') as categories from d) select categories, count(*) as n_docs from c group by 1")
def category_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the categories of their cues, in the fixed order (P-23, A-05)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.text(F.col("text")).alias("text")).distinct()
    return d.select(F.array_join(categories(cues(F.col("text"))), ",").alias("categories")).groupBy("categories").agg(F.count("*").alias("n_docs"))


@query(rf"""with d as (select distinct doc_id, text from documents), w as (select doc_id, unnest(list_distinct({_TOKENS})) as term from d), n as (select count(*) as n from d)
  select term, count(*) as df, round(ln((1.0 + max(n.n)) / (1.0 + count(*))) + 1, 6) as idf from w, n group by term""")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of each word and ln((1+n)/(1+df))+1 (A-32)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").distinct()
    n = d.agg(F.count("*").alias("n"))
    w = d.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return w.join(F.broadcast(n)).select("term", "df", F.round(F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1, 6).alias("idf"))


@query(rf"""with d as (select distinct doc_id, text from documents), w as (select doc_id, unnest({_TOKENS}) as term from d), n as (select count(*) as n from d),
  tf as (select doc_id, term, 1 + ln(count(*)) as tf from w group by 1, 2), f as (select term, ln((1.0 + max(n.n)) / (1.0 + count(*))) + 1 as idf from tf, n group by term),
  x as (select doc_id, term, tf * idf as v from tf join f using (term)), l as (select doc_id, sqrt(sum(v * v)) as l from x group by doc_id),
  r as (select doc_id, term, v / l as weight, row_number() over (partition by doc_id order by round(v / l, 9) desc, term) as rank from x join l using (doc_id)) select doc_id, rank, term, floor(round(weight, 9) * 10000)::bigint as weight_e4 from r where rank <= 3""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest words of each document by sublinear TF-IDF with L2 norm (M-06, M-07, W-12)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").distinct()
    n = d.agg(F.count("*").alias("n"))
    tf = d.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("v"))
    top = x.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"), F.collect_list(F.struct("v", "term")).alias("o"))
    ranked = F.slice(F.array_sort(F.transform("o", lambda s: F.struct((-F.round(s["v"] / F.col("l"), 9)).alias("w"), s["term"].alias("term")))), 1, 3)
    return top.select("doc_id", F.posexplode(ranked).alias("rank", "o")).select("doc_id", (F.col("rank") + 1).alias("rank"), "o.term", F.floor(-F.col("o.w") * 10000).alias("weight_e4"))


@query("""with d as (select distinct doc_id, coalesce(text, '') as text from documents) select doc_id, 'head' as part, sha256(substr(text, 1, 1200)) as digest from d
  union all select doc_id, 'middle', sha256(substr(text, (length(text) - 1200) // 2 + 1, 1200)) from d where length(text) > 2400 union all select doc_id, 'tail', sha256(substr(text, length(text) - 1199, 1200)) from d where length(text) > 1200""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, middle and tail windows of 1200 characters; shorter texts have fewer (W-14)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.text(F.col("text")).alias("text")).distinct()
    n = F.length("text")
    part = lambda name, begin, where: F.when(where, F.struct(F.lit(name).alias("part"), F.sha2(F.substr("text", begin.cast("int"), F.lit(1200)), 256).alias("digest")))
    parts = F.array_compact(F.array(part("head", F.lit(1), F.lit(True)), part("middle", F.floor((n - 1200) / 2) + 1, n > 2400), part("tail", n - 1199, n > 1200)))
    return d.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.part", "p.digest")


@query(rf"""with d as (select distinct doc_id, {_TOKENS} as t from documents), w as (select doc_id, t, unnest(range(0, greatest(1, ceil((len(t) - 128) / 384.0)::int))) as k from d where len(t) > 0)
  select doc_id, k::int as window_no, sha256(array_to_string(t[k*384+1:k*384+512], ' ')) as digest from w""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 words that overlap by 128 (W-15, W-16)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).distinct().where("size(t) > 0")
    last = F.greatest(F.lit(1), F.ceil((F.size("t") - 128) / 384)).cast("int") - 1
    w = d.select("doc_id", "t", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    return w.select("doc_id", "window_no", F.sha2(F.array_join(F.slice("t", F.col("window_no") * 384 + 1, F.lit(512)), " "), 256).alias("digest"))


@query(r"""select distinct doc_id, length(text) as code_points, length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) as utf16_units from documents where text is not null""")
def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in code points and in UTF-16 units (F-14)."""
    d = table(spark, sf_dir, "documents").where("text is not null").distinct()
    return d.select("doc_id", F.length("text").alias("code_points"), T.utf16_length(F.col("text")).alias("utf16_units")).distinct()


@query(r"""with l as (select distinct doc_id, source, unnest(string_split_regex(text, '[\r\n]+')) as s from documents), k as (select doc_id, source, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) as s from l)
  select sha256(s) as sentence, count(distinct doc_id) as n_docs, count(distinct source) as n_sources from k where length(s) >= 40 group by s having count(distinct source) > 1""")
def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that stand in documents of several sources (A-35)."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", r"[\r\n]+")).alias("s"))
    k = lines.select("doc_id", "source", T.collapsed(F.col("s")).alias("s")).where(F.length("s") >= 40)
    return k.groupBy(F.sha2("s", 256).alias("sentence")).agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_sources")).where("n_sources > 1")


@query("""with v as (select vec_id, embedding::double[] as e from embeddings), q as (select vec_id as query_id, e from v where vec_id % 50 = 0),
  p as (select query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) as similarity from q join v on v.vec_id <> q.query_id),
  r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from p) select query_id, rank, similarity from r where rank <= 5""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarities of the five nearest of all vectors to every fiftieth (J-30 and M-17 in part)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = cosine_top(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return found.select("query_id", "rank", F.round("similarity", 6).alias("similarity"))
