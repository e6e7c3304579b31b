"""Queries of relations: filters, joins, aggregates, windows, limits and set operations over profiles, pages, requests, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.dates import ascii_digits
from lectern.operators.ranking import numbered
from lectern.plans.registry import CURRENT, PAGES, Registry
from lectern.sources.shared import small
from lectern.sources.tables import current_profiles, latest, table

R = Registry()


def requests(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """Every request once."""
    return latest(table(spark, sf_dir, "score_requests"), "request_id", ["ingested_at"], keep)


@R.query(f"""
select profile_id, coalesce(nullif(trim(identity.full_name.value), ''), '(name not detected)') as name, coalesce(headline, '') as headline, total_years_experience.value as years,
  array_to_string(list_transform(skills[1:6], lambda s: coalesce(s.name, '')), ', ') as top_skills, identity.emails[1] as email, extraction.status as status, round(extraction.field_coverage, 4) as coverage from {CURRENT}""")
def roster(spark, sf_dir):
    """One line for each profile: name, headline, years, six skills, first address, status."""
    keep = ["headline", "total_years_experience", "skills", "identity", "extraction"]
    c = current_profiles(spark, sf_dir, keep)
    return c.select(
        "profile_id", F.coalesce(F.nullif(F.trim("identity.full_name.value"), F.lit("")), F.lit("(name not detected)")).alias("name"), F.coalesce("headline", F.lit("")).alias("headline"), F.col("total_years_experience.value").alias("years"),
        F.array_join(F.transform(F.slice("skills", 1, 6), lambda s: F.coalesce(s["name"], F.lit(""))), ", ").alias("top_skills"), F.get("identity.emails", F.lit(0)).alias("email"), F.col("extraction.status").alias("status"), F.round("extraction.field_coverage", 4).alias("coverage"),
    )


@R.query(f"select profile_id, coalesce(total_years_experience.value, 0.0) as years from {CURRENT} where coalesce(total_years_experience.value, 0) >= 8")
def years_filter(spark, sf_dir):
    """Profiles with at least eight years; unknown years are none."""
    return current_profiles(spark, sf_dir, {"y": F.col("total_years_experience.value")}).select("profile_id", F.coalesce("y", F.lit(0.0)).alias("years")).where("years >= 8")


@R.query(f"""
with c as (select profile_id, list_transform(list_filter(skills, lambda s: s.name is not null), lambda s: lower(s.name)) as names from {CURRENT}),
t as (select profile_id, unnest(['python', 'sql', 'kafka']) as term, unnest([1, 2, 3]) as k, names from c),
m as (select profile_id, term, k, list_filter(names, lambda n: contains(n, term) or contains(term, n)) as hit from t)
select profile_id, arg_min(term, k) as term, arg_min(hit[1], k) as skill from m where len(hit) > 0 group by profile_id""")
def who_has(spark, sf_dir):
    """Profiles that have a skill like one of three terms (either contains the other), with the first term that hits."""
    names = F.transform(F.filter("skills", lambda s: s["name"].isNotNull()), lambda s: F.lower(s["name"]))
    c = current_profiles(spark, sf_dir, {"names": names})

    def like(term: str):
        return F.filter("names", lambda n: n.contains(term) | F.lit(term).contains(n))

    hits = [like(t) for t in ("python", "sql", "kafka")]
    first = F.coalesce(*[F.when(F.size(h) > 0, F.struct(F.lit(t).alias("term"), F.get(h, F.lit(0)).alias("skill"))) for t, h in zip(("python", "sql", "kafka"), hits, strict=True)])
    return c.select("profile_id", first.alias("x")).where("x is not null").select("profile_id", "x.*")


@R.query(f"""
with weak as (select profile_id from {CURRENT} where extraction.status = 'NEEDS_REVIEW' or extraction.field_coverage < 0.6)
select profile_id, chat_id from {CURRENT} where profile_id not in (select profile_id from weak)""")
def exclude_weak(spark, sf_dir):
    """Profiles that are left without those to be looked at and the thinly filled ones."""
    c = current_profiles(spark, sf_dir, {"chat_id": F.col("chat_id"), "st": F.col("extraction.status"), "cov": F.col("extraction.field_coverage")})
    return c.where("not coalesce(st = 'NEEDS_REVIEW' or cov < 0.6, false)").select("profile_id", "chat_id")


@R.query(f"""
with c as (select profile_id, identity i, experiences x, skills s, education d, length(full_text) as n, extraction e, trim(coalesce(full_text, ''), ' ') = '' as unreadable, len(list_distinct(list_transform(regexp_extract_all(full_text, '{T.EMAIL}'), lambda x: lower(rtrim(x, '.'))))) as mails, source.page_range[1] as first_page, source.page_range[2] as last_page, coalesce(regexp_matches(lower(full_text), '{"|".join(T.INJECTION)}'), false) as injected from {CURRENT}),
k as (select profile_id, n, e, unreadable, mails, first_page, last_page, injected, if(trim(coalesce(i.full_name.value, '')) <> '', 20, 0) + if(coalesce(len(list_filter(i.emails, lambda y: trim(y) <> '')), 0) + coalesce(len(list_filter(i.phones, lambda y: trim(y) <> '')), 0) > 0, 20, 0)
   + if(coalesce(len(x), 0) > 0, 25, 0) + if(coalesce(len(s), 0) >= 3, 20, if(coalesce(len(s), 0) >= 1, 10, 0)) + if(coalesce(len(d), 0) > 0, 15, 0) as points,
   coalesce(len(list_filter(i.emails, lambda y: trim(y) <> '')), 0) + coalesce(len(list_filter(i.phones, lambda y: trim(y) <> '')), 0) = 0 as unanchored from c)
select profile_id, cast(points as int) as points, array_to_string(case when unreadable then ['UNREADABLE_FILE'] else list_filter([case when unanchored then 'NO_IDENTITY_ANCHOR' end, case when e.mean_ocr_confidence < 60 then 'LOW_OCR_CONFIDENCE' end, case when coalesce(n, 0) < 200 then 'SPARSE_TEXT' end, case when points < 40 then 'SPARSE_EXTRACTION' end, case when mails > 1 and last_page > first_page then 'MULTIPLE_CVS_IN_FILE' end, case when injected then 'INJECTION_SUSPECTED' end], lambda r: r is not null) end, ',') as reasons from k""")
def text_gating(spark, sf_dir):
    """Coverage points of each profile and the reasons to look at it, in order."""
    filled = lambda c: F.coalesce(F.size(F.filter(c, lambda y: F.trim(y) != "")), F.lit(0))
    keep = {"name": F.col("identity.full_name.value"), "contacts": F.when(F.col("identity").isNotNull(), F.greatest(filled(F.col("identity.emails")), F.lit(0)) + F.greatest(filled(F.col("identity.phones")), F.lit(0))), "x": F.size("experiences"), "s": F.size("skills"), "d": F.size("education"), "n": F.length("full_text"), "ocr": F.col("extraction.mean_ocr_confidence"), "unreadable": F.trim(F.coalesce("full_text", F.lit(""))) == "", "mails": F.size(T.emails(F.col("full_text"))), "first_page": F.get("source.page_range", F.lit(0)), "last_page": F.get("source.page_range", F.lit(1)), "injected": F.coalesce(F.lower("full_text").rlike("|".join(T.INJECTION)), F.lit(False))}
    c = current_profiles(spark, sf_dir, keep).withColumn("contacts", F.coalesce("contacts", F.lit(0)))
    points = F.expr("if(trim(coalesce(name, '')) <> '', 20, 0) + if(contacts > 0, 20, 0) + if(x > 0, 25, 0) + if(s >= 3, 20, if(s >= 1, 10, 0)) + if(d > 0, 15, 0)")
    reasons = F.array_compact(F.array(F.expr("if(contacts = 0, 'NO_IDENTITY_ANCHOR', null)"), F.expr("if(ocr < 60, 'LOW_OCR_CONFIDENCE', null)"), F.expr("if(coalesce(n, 0) < 200, 'SPARSE_TEXT', null)"), F.expr("if(points < 40, 'SPARSE_EXTRACTION', null)"), F.expr("if(mails > 1 and last_page > first_page, 'MULTIPLE_CVS_IN_FILE', null)"), F.expr("if(injected, 'INJECTION_SUSPECTED', null)")))
    reasons = F.when(F.col("unreadable"), F.array(F.lit("UNREADABLE_FILE"))).otherwise(reasons)
    return c.withColumn("points", points).select("profile_id", "points", F.array_join(reasons, ",").alias("reasons"))


@R.query(f"""
select profile_id, cast(count(*) as bigint) as pages, cast(coalesce(sum(if(source = 'ocr', 1, 0)), 0) as bigint) as ocr_pages, cast(coalesce(sum(if(source = 'vlm', 1, 0)), 0) as bigint) as vlm_pages, round(avg(case when source = 'ocr' then ocr_confidence end), 6) as mean_ocr_confidence,
  cast(coalesce(sum(length(text)), 0) as bigint) as text_chars, coalesce(bool_and(trim(coalesce(text, ''), ' ') = ''), true) as empty from {PAGES} where profile_id is not null group by profile_id""")
def doc_summary(spark, sf_dir):
    """Pages of each profile by source, mean confidence of its scans, characters."""
    p = latest(table(spark, sf_dir, "cv_pages"), "page_id", ["ingested_at"], {"profile_id": F.col("profile_id"), "source": F.col("source"), "conf": F.col("ocr_confidence"), "n": F.length("text"), "e": F.trim(F.coalesce("text", F.lit(""))) == ""})
    return p.where("profile_id is not null").groupBy("profile_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("source") == "ocr").alias("ocr_pages"), F.count_if(F.col("source") == "vlm").alias("vlm_pages"), F.round(F.avg(F.when(F.col("source") == "ocr", F.col("conf"))), 6).alias("mean_ocr_confidence"),
        F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("text_chars"), F.bool_and("e").alias("empty"),
    )


@R.query(f"""
select chat_id, cast(count(*) as bigint) as total, cast(count_if(extraction.status = 'NEEDS_REVIEW') as bigint) as needs_review, cast(count_if(extraction.status = 'OK') as bigint) as processed, cast(count_if(total_years_experience.value >= 10) as bigint) as senior, round(avg(extraction.field_coverage), 6) as coverage from {CURRENT} group by chat_id""")
def kpi_partition(spark, sf_dir):
    """Counts of each session's profiles by status."""
    c = current_profiles(spark, sf_dir, {"chat_id": F.col("chat_id"), "st": F.col("extraction.status"), "y": F.col("total_years_experience.value"), "cov": F.col("extraction.field_coverage")})
    return c.groupBy("chat_id").agg(F.count("*").alias("total"), F.count_if(F.col("st") == "NEEDS_REVIEW").alias("needs_review"), F.count_if(F.col("st") == "OK").alias("processed"), F.count_if(F.col("y") >= 10).alias("senior"), F.round(F.avg("cov"), 6).alias("coverage"))


@R.query(f"""
with k as (select distinct profile_id, 'email:' || lower(trim(e)) as key from (select profile_id, unnest(identity.emails) as e from {CURRENT}) where trim(e) <> ''
  union select distinct profile_id, 'phone:' || right(regexp_replace(translate(p, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[^0-9]', '', 'g'), 9) from (select profile_id, unnest(identity.phones) as p from {CURRENT}) where length(regexp_replace(translate(p, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[^0-9]', '', 'g')) >= 8),
f as (select key, count(*) as n from k group by key having count(*) = 2)
select a.key, a.profile_id as earlier, b.profile_id as later from k a join k b on a.key = b.key and a.profile_id < b.profile_id where a.key in (select key from f)""")
def contact_key_edges(spark, sf_dir):
    """Pairs of profiles that a rare contact joins: one that exactly two profiles have, so that a key gives one pair at most."""
    c = current_profiles(spark, sf_dir, {"e": F.col("identity.emails"), "p": F.col("identity.phones")})
    mail = c.select("profile_id", F.explode("e").alias("x")).where("trim(x) <> ''").select("profile_id", F.concat(F.lit("email:"), F.lower(F.trim("x"))).alias("key"))
    digits = F.regexp_replace(ascii_digits(F.col("x")), "[^0-9]", "")
    call = c.select("profile_id", F.explode("p").alias("x")).where(F.length(digits) >= 8).select("profile_id", F.concat(F.lit("phone:"), F.right(digits, F.lit(9))).alias("key"))
    return mail.unionByName(call).distinct().groupBy("key").agg(F.count("*").alias("n"), F.min("profile_id").alias("earlier"), F.max("profile_id").alias("later")).where("n = 2").drop("n")


@R.query(f"""
select lower(trim(regexp_replace(identity.full_name.value, ' +', ' ', 'g'), ' ')) as name, cast(count(*) as bigint) as profiles, min(profile_id) as first_id, max(profile_id) as last_id from {CURRENT}
where trim(identity.full_name.value, ' ') <> '' group by 1 having count(*) > 1""")
def same_name_groups(spark, sf_dir):
    """Names that several profiles have."""
    c = current_profiles(spark, sf_dir, {"v": F.col("identity.full_name.value")}).where("trim(v) <> ''")
    return c.groupBy(F.lower(F.trim(F.regexp_replace("v", " +", " "))).alias("name")).agg(F.count("*").alias("profiles"), F.min("profile_id").alias("first_id"), F.max("profile_id").alias("last_id")).where("profiles > 1")


@R.query("""
with m as (select rtype, label, kind, text, keywords, min_years, try_cast(regexp_extract(req_id, '[0-9]+') as int) as pos from requirements where label is not null),
k as (select rtype, label, array_to_string(list_sort(list_distinct(flatten(list(keywords) filter (where keywords is not null)))), ',') as keywords from m group by rtype, label)
select m.rtype, m.label, max(case when m.kind = 'required' then 'required' else 'preferred' end) as kind, max(m.min_years) as floor, max(length(m.text)) as longest, k.keywords, cast(count(*) as bigint) as uses
from m join k on m.rtype is not distinct from k.rtype and m.label = k.label group by m.rtype, m.label, k.keywords""")
def merged_requirements(spark, sf_dir):
    """Requirements of one type and label as one: the stronger kind, all keywords, the highest floor, the longest text."""
    m = table(spark, sf_dir, "requirements").where("label is not null")
    words = F.nullif(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("keywords")))), ","), F.lit(""))
    return m.groupBy("rtype", "label").agg(
        F.max(F.when(F.col("kind") == "required", "required").otherwise("preferred")).alias("kind"), F.max("min_years").alias("floor"), F.max(F.length("text").cast("long")).alias("longest"), words.alias("keywords"), F.count("*").alias("uses")
    )


@R.query(f"select kind, cast(count(*) as bigint) as n from (select profile_id, unnest(education).degree as kind from {CURRENT}) where kind is not null group by kind order by n desc, kind limit 3")
def top_degrees(spark, sf_dir):
    """The three degrees that occur most."""
    c = current_profiles(spark, sf_dir, {"d": F.col("education.degree")}).select(F.explode("d").alias("kind")).where("kind is not null")
    return c.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(3)


@R.query("select s_suppkey, rank() over (order by round(s_acctbal / 100) desc) as place, count(*) over (partition by round(s_acctbal / 100)) > 1 as tied, row_number() over (order by round(s_acctbal / 100) desc, s_nationkey, s_suppkey) as line from supplier")
def competition_rank(spark, sf_dir):
    """Places of suppliers by balance in hundreds, shared by ties, and their order inside a tie.

    How many are before a score is counted by score; the order of the lines is numbered in parts, never all rows in one task.
    """
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.round(F.col("s_acctbal") / 100).alias("score"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = s.groupBy("score").agg(F.count("*").alias("n")).select("score", "n", before.alias("before"))
    lines = numbered(s, None, [F.desc("score"), F.asc("s_nationkey"), F.asc("s_suppkey")], "line")
    return lines.join(small(places), "score").select("s_suppkey", (F.col("before") + 1).alias("place"), (F.col("n") > 1).alias("tied"), "line")


@R.query(f"""
select chat_id, profile_id, row_number() over (partition by chat_id order by total_years_experience.value desc nulls last, display_no, profile_id) as place from {CURRENT} where extraction.status = 'OK' and chat_id is not null""")
def screening_rank(spark, sf_dir):
    """The profiles of each session, the most experienced first; a large session is numbered in parts."""
    c = current_profiles(spark, sf_dir, {"chat_id": F.col("chat_id"), "st": F.col("extraction.status"), "y": F.col("total_years_experience.value"), "display_no": F.col("display_no")}).where("st = 'OK' and chat_id is not null")
    order = [F.desc_nulls_last("y"), F.col("display_no").asc_nulls_last(), F.col("profile_id").asc()]
    return numbered(c, "chat_id", order, "place").select("chat_id", "profile_id", "place")


@R.query("select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as place from orders qualify place <= 3")
def top_orders(spark, sf_dir):
    """The three largest orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("o_custkey", "o_orderkey", "place")


@R.query(f"""
with p as (select profile_id, page, page_id, length('[Page ' || page || chr(10)) + least(length(text), 4000) as n from {PAGES} where text is not null and profile_id is not null),
r as (select *, coalesce(sum(n) over (partition by profile_id order by page, page_id rows between unbounded preceding and 1 preceding), 0) as before from p)
select profile_id, page_id, cast(least(n, 14000 - before) as bigint) as taken from r where before < 14000""")
def text_budget(spark, sf_dir):
    """How much of each page goes into a profile's text of at most 14,000 characters, 4,000 of a page; the last one is cut."""
    p = latest(table(spark, sf_dir, "cv_pages"), "page_id", ["ingested_at"], {"profile_id": F.col("profile_id"), "page": F.col("page"), "len": F.length("text")}).where("len is not null and profile_id is not null")
    p = p.select("profile_id", "page", "page_id", (F.length(F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("\n"))) + F.least("len", F.lit(4000))).cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("profile_id").orderBy("page", "page_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("before", before).where("before < 14000").select("profile_id", "page_id", F.least(F.col("n"), 14000 - F.col("before")).alias("taken"))


@R.query("select event_type, min(event_id) as first_event, max(event_id) as last_event, cast(count(*) as bigint) as n from events group by event_type")
def first_per_key(spark, sf_dir):
    """The first and last event of each type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))


@R.query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5")
def last_events(spark, sf_dir):
    """The last five events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 5").select("user_id", "event_id")


@R.query("""
with d as (select cast(ts as date) as day, avg(value) as v from events group by 1),
b as (select day, v, max(v) over (order by day rows between unbounded preceding and 1 preceding) as best from d)
select day, round(v, 6) as v, round(best, 6) as best, coalesce(best - v > 0.25, false) as alert from b""")
def drift_prefix_max(spark, sf_dir):
    """Daily means against the best earlier day, with an alert where they fall far below; days are few, however many events."""
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    best = F.max("v").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("best", best).select("day", F.round("v", 6).alias("v"), F.round("best", 6).alias("best"), F.coalesce(F.col("best") - F.col("v") > 0.25, F.lit(False)).alias("alert"))


@R.query("""
with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 120 minutes or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id, min(ts) as first_ts, max(ts) as last_ts, cast(count(*) as bigint) as events from s group by user_id, k""")
def session_ttl(spark, sf_dir):
    """Sessions of users: a pause of more than 120 minutes ends one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    g = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(gap.isNull() | (gap > 7200), 1).otherwise(0).alias("fresh"))
    s = g.withColumn("k", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "k").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")).drop("k")


@R.query("""
with d as (select sha256(text) as h, doc_id, source from documents where text is not null)
select h as text_hash, min(doc_id) as class_id, cast(count(*) as bigint) as copies, cast(count(distinct source) as bigint) as sources from d group by h having count(*) > 1""")
def exact_copies(spark, sf_dir):
    """Texts that occur under several ids, as classes."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("text_hash"), "doc_id", "source")
    return d.groupBy("text_hash").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.countDistinct("source").alias("sources")).where("copies > 1")


@R.query("""
with d as (select doc_id, sha256(text) as h, received_at from documents where text is not null), old as (select distinct h from d where received_at < timestamp '2026-03-01')
select doc_id from d where received_at >= timestamp '2026-03-01' and h not in (select h from old)""")
def append_antijoin(spark, sf_dir):
    """New documents whose text no earlier batch holds."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), (F.col("received_at") < F.lit("2026-03-01").cast("timestamp_ntz")).alias("old"))
    return d.where("not old").join(d.where("old").select("h"), "h", "left_anti").select("doc_id")


@R.query("""
with a as (select c_custkey as k, c_nationkey as n from customer), b as (select s_suppkey as k, s_nationkey as n from supplier)
select n, cast(count(*) as bigint) as members from (select k, n from a union all select k, n from b) group by n""")
def union_batches(spark, sf_dir):
    """Two batches as one, counted by nation."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    return a.unionByName(b).groupBy("n").agg(F.count("*").alias("members"))


@R.query("""
with u as (unpivot (select s_suppkey, cast(s_nationkey as double) as nation, s_acctbal as balance from supplier where s_suppkey in (1, 2)) on nation, balance into name field value v)
select field, max(case when s_suppkey = 1 then v end) as first, max(case when s_suppkey = 2 then v end) as second from u group by field""")
def compare_pivot(spark, sf_dir):
    """Two suppliers side by side, a row for each field."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey in (1, 2)").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    u = s.unpivot("s_suppkey", ["nation", "balance"], "field", "v")
    return u.groupBy("field").agg(F.max(F.when(F.col("s_suppkey") == 1, F.col("v"))).alias("first"), F.max(F.when(F.col("s_suppkey") == 2, F.col("v"))).alias("second"))


@R.query(f"""
with w as (select page_id, page, regexp_split_to_array(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ') as ws from {PAGES} where text is not null and source = 'ocr'),
x as (select page_id, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from w)
select page_id, cast(pos // 12 as bigint) as line, string_agg(word, ' ' order by pos) as text from x where word <> '' group by page_id, pos // 12""")
def ocr_line_rebuild(spark, sf_dir):
    """Lines of twelve words put together again from single words with their places."""
    p = latest(table(spark, sf_dir, "cv_pages"), "page_id", ["ingested_at"], ["text", "source"]).where("text is not null and source = 'ocr'")
    words = p.select("page_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")), " ")).alias("pos", "word")).where("word <> ''")
    lines = words.groupBy("page_id", F.floor(F.col("pos") / 12).alias("line")).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))  # twelve words at most
    return lines.select("page_id", "line", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


QUERIES, SQL = R.queries, R.sql
