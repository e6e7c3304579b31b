"""Further queries on profiles: lanes, evidence, numbering, duplicates, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.ranking import numbered
from lectern.operators.resolve import absorb
from lectern.plans.anchors import SQL as ANCHOR_SQL
from lectern.plans.anchors import quote_verify
from lectern.plans.matching import REQUESTS_SQL, request_pairs
from lectern.plans.registry import CURRENT, PAGES, Registry
from lectern.plans.relational import SQL as RELATIONAL_SQL
from lectern.plans.relational import contact_key_edges
from lectern.sources.shared import small
from lectern.sources.tables import current_profiles, latest, table

R = Registry()
EDGE_SQL = RELATIONAL_SQL["contact_key_edges"]
#: Share of words in common from which two profiles are one document.
CONTENT = 0.8


@R.query(f"""
select chat_id, case when extraction.status = 'NEEDS_REVIEW' then 'review' when extraction.status = 'OK' then 'pool' else 'other' end as lane, cast(count(*) as bigint) as n from {CURRENT} group by all""")
def lanes(spark, sf_dir):
    """Profiles of each session by lane: to be looked at, usable, neither."""
    c = current_profiles(spark, sf_dir, {"chat_id": F.col("chat_id"), "st": F.col("extraction.status")})
    return c.groupBy("chat_id", F.when(F.col("st") == "NEEDS_REVIEW", "review").when(F.col("st") == "OK", "pool").otherwise("other").alias("lane")).agg(F.count("*").alias("n"))


@R.query(f"""
with m as (select profile_id, page_id, list_distinct(list_transform(regexp_extract_all(text, '{T.EMAIL}'), lambda x: lower(rtrim(x, '.')))) as e from {PAGES} where profile_id is not null),
p as (select profile_id, count(*) as pages from m group by 1), d as (select profile_id, count(distinct x) as emails from (select profile_id, unnest(e) as x from m) group by 1)
select p.profile_id, cast(p.pages as bigint) as pages, cast(coalesce(d.emails, 0) as bigint) as emails, coalesce(d.emails, 0) > 1 and p.pages > 1 as several from p left join d using (profile_id)""")
def several_people(spark, sf_dir):
    """Profiles of more than one page with more than one address: the file may hold several people."""
    p = latest(table(spark, sf_dir, "cv_pages"), "page_id", ["ingested_at"], {"profile_id": F.col("profile_id"), "e": T.emails(F.col("text"))}).where("profile_id is not null")
    found = p.select("profile_id", "page_id", F.explode_outer("e").alias("x"))
    g = found.groupBy("profile_id").agg(F.countDistinct("page_id").alias("pages"), F.countDistinct("x").alias("emails"))
    return g.select("*", ((F.col("emails") > 1) & (F.col("pages") > 1)).alias("several"))


@R.query(f"with v as ({ANCHOR_SQL['quote_verify']}) select part, cast(count(*) as bigint) as quotes, cast(count(page) as bigint) as found, round(count(page) / count(*), 6) as validity from v group by part")
def evidence_validity(spark, sf_dir):
    """Share of evidence quotes that stand on a page of their profile."""
    g = quote_verify(spark, sf_dir).groupBy("part").agg(F.count("*").alias("quotes"), F.count("page").alias("found"))
    return g.select("*", F.round(F.col("found") / F.col("quotes"), 6).alias("validity"))


@R.query(f"""
with e as (select profile_id, unnest(skills).evidence.page as page from {CURRENT} union all select profile_id, unnest(experiences).evidence.page from {CURRENT} union all select profile_id, unnest(education).evidence.page from {CURRENT})
select profile_id, string_agg(distinct cast(page as varchar), ',' order by cast(page as varchar)) as pages from e where page is not null group by 1""")
def evidence_pages(spark, sf_dir):
    """Pages that the evidence of each profile names, as a list."""
    pages = F.array_union(F.array_union(F.coalesce("skills.evidence.page", F.array().cast("array<int>")), F.coalesce("experiences.evidence.page", F.array().cast("array<int>"))), F.coalesce("education.evidence.page", F.array().cast("array<int>")))
    c = current_profiles(spark, sf_dir, {"p": F.array_sort(F.transform(F.array_compact(F.array_distinct(pages)), lambda x: x.cast("string")))})
    return c.where("size(p) > 0").select("profile_id", F.array_join("p", ",").alias("pages"))


@R.query(f"select chat_id, profile_id, 'c_' || lpad(cast(k as varchar), cast(greatest(3, length(cast(k as varchar))) as int), '0') as candidate from (select chat_id, profile_id, row_number() over (partition by chat_id order by display_no, profile_id) as k from {CURRENT} where chat_id is not null)")
def candidate_numbers(spark, sf_dir):
    """Numbers of profiles in their session; three digits at least."""
    c = current_profiles(spark, sf_dir, ["chat_id", "display_no"]).where("chat_id is not null")
    return numbered(c, "chat_id", [F.col("display_no").asc_nulls_last(), F.col("profile_id").asc()], "place").withColumn("k", F.col("place").cast("string")).select("chat_id", "profile_id", F.concat(F.lit("c_"), F.expr("lpad(k, greatest(3, length(k)), '0')")).alias("candidate"))


# Duplicates in SQL: nodes are decided in order of their ids, each seeing which earlier ones were taken in.
DUP_SQL = f"""
dt as (select profile_id, display_no, chat_id, trim(identity.full_name.value, ' ') as name, list_filter(regexp_split_to_array(lower(coalesce(identity.full_name.value, '')), '[^\\p{{L}}\\p{{M}}]+'), lambda x: length(x) > 1) as t,
  list_distinct(regexp_extract_all(lower(coalesce(full_text, '')), '[a-z0-9ء-ي]{{2,}}')) as words from {CURRENT}),
de as (select distinct e.earlier, e.later from ({EDGE_SQL}) e join dt a on a.profile_id = e.earlier join dt b on b.profile_id = e.later where len(a.t) = 0 or len(b.t) = 0 or list_has_any(a.t, b.t)),
dn as (select row_number() over (order by id) as k, id, ups from (select later as id, list(earlier) as ups from de group by 1)),
dr as (select cast(0 as bigint) as k, cast([] as bigint[]) as taken, cast(null as bigint) as id, cast(null as bigint) as target
  union all select dn.k, case when len(list_filter(ups, lambda u: not list_contains(taken, u))) > 0 then list_append(taken, dn.id) else taken end, dn.id, list_min(list_filter(ups, lambda u: not list_contains(taken, u))) from dr join dn on dn.k = dr.k + 1),
dd as (select id, target, case when len(a.words) = 0 or len(b.words) = 0 or len(list_intersect(a.words, b.words)) >= {CONTENT} * len(list_distinct(list_concat(a.words, b.words))) then 'duplicate' else 'conflict' end as outcome
  from dr join dt a on a.profile_id = dr.id join dt b on b.profile_id = dr.target where target is not null)"""


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, target, outcome): profiles that an earlier one takes in; a duplicate if their words are alike, else a conflict for a person to resolve."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("full_text", F.lit(""))), F.lit("([a-z0-9ء-ي]{2,})"), 1))
    c = current_profiles(spark, sf_dir, {"t": F.filter(F.split(F.lower(F.coalesce("identity.full_name.value", F.lit(""))), r"[^\p{L}\p{M}]+"), lambda x: F.length(x) > 1)})
    e = contact_key_edges(spark, sf_dir).select("earlier", "later").distinct()
    both = e.join(c.select(F.col("profile_id").alias("earlier"), F.col("t").alias("ta")), "earlier").join(c.select(F.col("profile_id").alias("later"), F.col("t").alias("tb")), "later")
    taken = absorb(both.where("size(ta) = 0 or size(tb) = 0 or arrays_overlap(ta, tb)").select("earlier", "later"))
    # Words only of profiles that meet another.
    w = current_profiles(spark, sf_dir, {"w": words}).join(taken.select(F.explode(F.array("id", "target")).alias("profile_id")).distinct(), "profile_id", "left_semi")
    met = taken.join(w.select(F.col("profile_id").alias("id"), F.col("w").alias("wa")), "id").join(w.select(F.col("profile_id").alias("target"), F.col("w").alias("wb")), "target")
    alike = (F.size("wa") == 0) | (F.size("wb") == 0) | (F.size(F.array_intersect("wa", "wb")) >= CONTENT * F.size(F.array_union("wa", "wb")))
    return met.select("id", "target", F.when(alike, "duplicate").otherwise("conflict").alias("outcome"))


@R.query(f"with recursive {DUP_SQL} select id, target, outcome from dd")
def dup_resolution(spark, sf_dir):
    """Profiles that an earlier one with the same rare contact and a common name token takes in, as duplicates or, where their words differ, as conflicts."""
    return duplicates(spark, sf_dir)


@R.query(f"with recursive {DUP_SQL} select dd.id, upper(outcome) || ' of #' || coalesce(cast(b.display_no as varchar), '?') || coalesce(' (' || nullif(b.name, '') || ')', '') as label from dd join dt b on b.profile_id = dd.target")
def dup_labels(spark, sf_dir):
    """What a duplicate or a conflict is of, in words: the number and name of the profile that took it in."""
    named = current_profiles(spark, sf_dir, {"display_no": F.col("display_no"), "name": F.trim("identity.full_name.value")}).withColumnRenamed("profile_id", "target")
    label = F.concat(F.upper("outcome"), F.lit(" of #"), F.coalesce(F.col("display_no").cast("string"), F.lit("?")), F.coalesce(F.concat(F.lit(" ("), F.nullif("name", F.lit("")), F.lit(")")), F.lit("")))
    return duplicates(spark, sf_dir).join(named, "target").select("id", label.alias("label"))


@R.query(f"""
with recursive {DUP_SQL} select chat_id, case when dd.outcome = 'duplicate' then 'duplicate' when dd.outcome = 'conflict' or st = 'NEEDS_REVIEW' then 'review' when st = 'OK' then 'pool' else 'other' end as lane, cast(count(*) as bigint) as n
from (select profile_id, chat_id, extraction.status as st from {CURRENT}) c left join dd on dd.id = c.profile_id group by all""")
def lanes_without_duplicates(spark, sf_dir):
    """Profiles of each session by lane, duplicates apart and conflicts among those to be looked at."""
    c = current_profiles(spark, sf_dir, {"chat_id": F.col("chat_id"), "st": F.col("extraction.status")})
    o, st = F.col("outcome"), F.col("st")
    lane = F.when(o == "duplicate", "duplicate").when((o == "conflict") | (st == "NEEDS_REVIEW"), "review").when(st == "OK", "pool").otherwise("other")
    return c.join(duplicates(spark, sf_dir).select(F.col("id").alias("profile_id"), "outcome"), "profile_id", "left").groupBy("chat_id", lane.alias("lane")).agg(F.count("*").alias("n"))


_TOP_KEYS = "gender sex age dob date_of_birth birthdate birth_date nationality religion marital marital_status ethnicity race photo".split()  # fixed values: keys of protected attributes


@R.query(f"""
with p as (select distinct reply_id, regexp_replace(trim(payload), '^```[A-Za-z]*\\s*|\\s*```$', '', 'g') as j from model_replies where payload is not null),
k as (select reply_id, unnest(json_keys(j)) as key from p where json_valid(j) and json_type(j) = 'OBJECT')
select key, lower(key) in ({', '.join(f"'{k}'" for k in _TOP_KEYS)}) as protected, cast(count(distinct reply_id) as bigint) as replies from k group by all""")
def reply_keys(spark, sf_dir):
    """Outermost keys of model replies, with a mark on those that hold protected attributes."""
    p = latest(table(spark, sf_dir, "model_replies").where("payload is not null"), "reply_id", ["received_at"], {"j": F.regexp_replace(F.trim("payload"), r"(?s)^```[A-Za-z]*\s*|\s*```$", "")})
    k = p.select("reply_id", F.explode(F.json_object_keys("j")).alias("key"))
    return k.groupBy("key", F.lower("key").isin(*_TOP_KEYS).alias("protected")).agg(F.countDistinct("reply_id").alias("replies"))


@R.query(f"""
with c as (select profile_id, lower(trim(identity.full_name.value, ' ')) as name, list_sort(list_distinct(list_transform(list_filter(skills, lambda s: s.name is not null), lambda s: lower(s.name)))) as s from {CURRENT}
  where length(trim(identity.full_name.value, ' ')) >= 5 and contains(trim(identity.full_name.value, ' '), ' ')),
r as (select name, s, min(profile_id) as id from c where len(s) > 0 group by all)
select a.id as earlier, b.id as later, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) as similarity from r a join r b on a.name = b.name and a.id < b.id where len(list_intersect(a.s, b.s)) >= 0.7 * len(list_distinct(list_concat(a.s, b.s)))""")
def same_name_same_skills(spark, sf_dir):
    """Profiles of one full name whose skills are alike by 0.7 or more; profiles with the same name and skills count as one, the earliest."""
    skills = F.array_sort(F.array_distinct(F.transform(F.filter("skills", lambda s: s["name"].isNotNull()), lambda s: F.lower(s["name"]))))
    c = current_profiles(spark, sf_dir, {"v": F.trim("identity.full_name.value"), "s": skills}).where("length(v) >= 5 and contains(v, ' ') and size(s) > 0")
    r = c.groupBy(F.lower("v").alias("name"), "s").agg(F.min("profile_id").alias("id"))
    a, b = r.alias("a"), r.alias("b")
    p = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.id") < F.col("b.id")))
    both, all_ = F.size(F.array_intersect("a.s", "b.s")), F.size(F.array_union("a.s", "b.s"))
    return p.where(both >= 0.7 * all_).select(F.col("a.id").alias("earlier"), F.col("b.id").alias("later"), F.round(both / all_, 6).alias("similarity"))


@R.query(f"""
with q as (select profile_id, page, count(*) as quotes from (select profile_id, unnest(skills).evidence.page as page from {CURRENT} union all select profile_id, unnest(experiences).evidence.page from {CURRENT} union all select profile_id, unnest(education).evidence.page from {CURRENT}) where page is not null group by all),
p as (select profile_id, page, max(source) as source from {PAGES} group by all)
select q.profile_id, q.page, cast(q.quotes as bigint) as quotes, coalesce(p.source, 'text') as source from q left join p on q.profile_id = p.profile_id and q.page = p.page""")
def evidence_sources(spark, sf_dir):
    """What kind of page the evidence of skills, roles and schools stands on, text where that isn't known."""
    every = F.concat(*[F.coalesce(f"{x}.evidence.page", F.array().cast("array<int>")) for x in ("skills", "experiences", "education")])
    q = current_profiles(spark, sf_dir, {"p": every}).select("profile_id", F.explode("p").alias("page")).where("page is not null").groupBy("profile_id", "page").agg(F.count("*").alias("quotes"))
    p = latest(table(spark, sf_dir, "cv_pages"), "page_id", ["ingested_at"], ["profile_id", "page", "source"]).groupBy("profile_id", "page").agg(F.max("source").alias("source"))
    return q.join(p, ["profile_id", "page"], "left").na.fill("text", ["source"])


@R.query("""
select coalesce(status, 'none') as status, cast(count(distinct chat_id) as bigint) as sessions, cast(coalesce(sum(n_files), 0) as bigint) as files,
  cast(coalesce(sum(if(last_seen_at < timestamp '2026-06-01' - interval 120 minutes, 1, 0)), 0) as bigint) as idle from chat_sessions group by 1""")
def session_counts(spark, sf_dir):
    """Sessions by status, with those that nobody has touched for two hours."""
    s = table(spark, sf_dir, "chat_sessions")
    idle = F.col("last_seen_at") < F.expr("timestamp_ntz'2026-05-31 22:00:00'")
    return s.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.countDistinct("chat_id").alias("sessions"), F.coalesce(F.sum(F.col("n_files").cast("long")), F.lit(0)).alias("files"), F.count_if(idle).alias("idle"))


@R.query(f"""
with n as (select profile_id, trim(identity.full_name.value, ' ') as v from {CURRENT} where trim(identity.full_name.value, ' ') <> ''),
w as (select profile_id, v, unnest(string_split(v, ' ')) as w, generate_subscripts(string_split(v, ' '), 1) as k from n)
select profile_id, string_agg(case when w = upper(w) or w = lower(w) then array_to_string(list_transform(regexp_extract_all(w, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda x: upper(left(x, 1)) || lower(x[2:])), '') else w end, ' ' order by k) as name from w group by profile_id""")
def name_case(spark, sf_dir):
    """Names with words that are all large or all small in proper case, their parts between hyphens and apostrophes too, in any script; mixed ones stay."""
    c = current_profiles(spark, sf_dir, {"v": F.trim("identity.full_name.value")}).where("v <> ''")
    proper = lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))
    fix = lambda w: F.when((w == F.upper(w)) | (w == F.lower(w)), F.array_join(F.transform(F.regexp_extract_all(w, F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"), 1), proper), "")).otherwise(w)
    return c.select("profile_id", F.array_join(F.transform(F.split("v", " "), fix), " ").alias("name"))


@R.query("""
with v as (select request_id, req_id, kind from requirements), judged as (select request_id, req_id, 'met' as verdict from requirements where rtype = 'skill' and label is not null)
select coalesce(j.verdict, 'unverified') as verdict, v.kind, cast(count(*) as bigint) as n from v left join judged j on v.request_id = j.request_id and v.req_id = j.req_id group by all""")
def default_verdicts(spark, sf_dir):
    """Requirements with the verdict of a partial judgement, unverified where it has none."""
    v = table(spark, sf_dir, "requirements").select("request_id", "req_id", "kind")
    judged = table(spark, sf_dir, "requirements").where("rtype = 'skill' and label is not null").select("request_id", "req_id", F.lit("met").alias("verdict"))
    return v.join(judged, ["request_id", "req_id"], "left").groupBy(F.coalesce("verdict", F.lit("unverified")).alias("verdict"), "kind").agg(F.count("*").alias("n"))


_NAME_LINE = r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.'-]+( [A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.'-]*){1,3}$"
_NOT_NAMES = r"(curriculum|vitae|engineer|developer|analyst|manager|clerk|assistant|technician|coordinator|planner|lead|summary|experience|education|skills|profile|confidential|page|personal|details|application)"


@R.query(f"""
with l as (select profile_id, page_id, unnest(string_split(text, chr(10))[1:8]) as line, generate_subscripts(string_split(text, chr(10))[1:8], 1) as k from {PAGES} where page = 1 and text is not null and profile_id is not null),
g as (select * from l where regexp_matches(line, '{_NAME_LINE.replace("'", "''")}') and not regexp_matches(lower(line), '{_NOT_NAMES}') and length(line) between 3 and 60)
select profile_id, arg_min(line, k * 1000000000 + page_id) as name from g group by 1""")
def heuristic_name(spark, sf_dir):
    """The first of the eight top lines of a first page that may be a name: two to four words, no heading and no job."""
    p = table(spark, sf_dir, "cv_pages").where("page_id is not null and page = 1 and text is not null and profile_id is not null")
    lines = p.select("profile_id", "page_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 8)).alias("k", "line"))
    good = lines.where(F.col("line").rlike(_NAME_LINE) & ~F.lower("line").rlike(_NOT_NAMES) & F.length("line").between(3, 60))
    return good.groupBy("profile_id").agg(F.min_by("line", F.struct("k", "page_id")).alias("name"))


@R.query(f"with {REQUESTS_SQL} select request_id, profile_id, string_agg(case when verdict = 'met' then req_id end, ',' order by req_id) as met, string_agg(case when verdict = 'missing' and kind = 'required' then req_id end, ',' order by req_id) as missing_required, string_agg(case when verdict = 'unverified' then req_id end, ',' order by req_id) as unverified from v group by all")
def verdict_lists_requests(spark, sf_dir):
    """Which requirements of every request each profile of its session meets, misses and leaves open, as lists."""
    some = lambda f: F.nullif(F.array_join(F.transform(F.filter("vs", f), lambda x: x["req_id"]), ","), F.lit(""))
    return request_pairs(spark, sf_dir).select("request_id", "profile_id", some(lambda x: x["code"] == 2).alias("met"), some(lambda x: (x["code"] == 0) & (x["kind"] == "required")).alias("missing_required"), some(lambda x: x["code"] == 3).alias("unverified"))


@R.query(f"""
with c as (select profile_id, list_transform(list_filter(skills, lambda s: s.name is not null), lambda s: s.name) as n from {CURRENT})
select profile_id, array_to_string(n[1:4], ', ') || case when len(n) > 4 then ' …' else '' end as cell, repeat('█', least(10, len(n))) as bar from c where len(n) > 0""")
def skill_cells(spark, sf_dir):
    """Skills as a cell of a report: four of them and a mark for more, with a bar of their number."""
    c = current_profiles(spark, sf_dir, {"n": F.transform(F.filter("skills", lambda s: s["name"].isNotNull()), lambda s: s["name"])}).where("size(n) > 0")
    return c.select("profile_id", F.concat(F.array_join(F.slice("n", 1, 4), ", "), F.when(F.size("n") > 4, " …").otherwise("")).alias("cell"), F.repeat(F.lit("█"), F.least(F.lit(10), F.size("n"))).alias("bar"))


@R.query("""
with r as (select request_id, req_id, lower(text) as t from requirements where text is not null)
select request_id, req_id, arg_min(s.term, s.term_id) as term from r join skill_terms s on contains(r.t, lower(s.term)) and length(s.term) > 3 group by all""")
def first_needle(spark, sf_dir):
    """The first reference skill that the text of each requirement contains; the list of skills is small and fixed."""
    r = table(spark, sf_dir, "requirements").where("text is not null").select("request_id", "req_id", F.lower("text").alias("t"))
    s = table(spark, sf_dir, "skill_terms").where("length(term) > 3")
    return r.join(small(s), F.col("t").contains(F.lower("term"))).groupBy("request_id", "req_id").agg(F.min_by("term", "term_id").alias("term"))


@R.query(f"""
with p as (select event_id, unnest(json_keys(props)) as k, props from events where props is not null)
select k as key, cast(count(*) as bigint) as uses, cast(sum(try_cast(json_extract_string(props, '$.' || k) as double)) as bigint) as total from p where lower(k) not in ({', '.join(f"'{k}'" for k in _TOP_KEYS)}) group by 1""")
def scrubbed_props(spark, sf_dir):
    """Keys of the events' open fields without protected ones, with the sum of what they hold."""
    m = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: ~F.lower(k).isin(*_TOP_KEYS))
    e = table(spark, sf_dir, "events").where("props is not null").select(F.explode(m).alias("key", "v"))
    return e.groupBy("key").agg(F.count("*").alias("uses"), F.sum(F.expr("try_cast(v as double)")).cast("long").alias("total"))


QUERIES, SQL = R.queries, R.sql
