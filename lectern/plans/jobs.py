"""Queries from job descriptions to requirements, and of profiles against the last request of their session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.dates import ascii_digits
from lectern.operators.intervals import periods_and_gaps
from lectern.plans.records import role_months
from lectern.plans.records_sql import P6
from lectern.plans.registry import CURRENT, Registry
from lectern.sources.shared import small
from lectern.sources.tables import current_profiles, latest, table

R = Registry()
_DIG = "translate({}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
# Labels before a colon or headings over a list of what is wanted and of what is welcome; in the corpus languages.
WELCOME = "nice|prefer|bonus|plus|desirable|advantage|good to have|von vorteil|wünschenswert|un plus|souhait|deseable|valor|desejáve|mais-valia|يفضل|ميزة"
WANTED = "required|must|requirement|skill|technolog|stack|proficient|experience with|knowledge of|responsibilit|qualification|competenc|erforderlich|anforderung|requis|exig|requisito|obrigat|مطلوب|المتطلبات"
_ROLE_LABEL = "^(?:role|position|title|job *title) *[:-] *(.+)$"
_YEARS = "([0-9]{1,2})\\+? *(?:years|yrs|jahre|ans|années|años|anos|سنوات|سنة|عاما)"
_CUT = "[,،;/|•·]| and | or "
#: Entries of one list, at most: the feature of the parser.
LISTED = 20
_ORDER = [T.DEGREES[k] for k in (1, 2, 3, 0)]  # bachelor, master, doctorate, diploma: the first that is named counts


def _degree(low: Column) -> Column:
    named = lambda p: low.rlike(rf"(^|[^{T.WORD_CLASS}])({p})($|[^{T.WORD_CLASS}])")
    return F.coalesce(*[F.when(named(p), F.lit(n)) for n, _, p in _ORDER])


_DEGREE_SQL = "case " + " ".join(f"when regexp_matches(low, '(^|[^{T.WORD_CLASS}])({p})($|[^{T.WORD_CLASS}])') then '{n}'" for n, _, p in _ORDER) + " end"
_JD = "(select * from score_requests where request_id is not null and jd_text is not null qualify row_number() over (partition by request_id order by ingested_at desc nulls last) = 1)"
_LINE_SQL = "list_filter(list_transform(string_split(jd_text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
JOBS_SQL = f"""
jl as (select request_id, lower(jd_text) as low, {_LINE_SQL} as ls from {_JD}),
jr as (select request_id, low, ls, list_filter(list_transform(ls, lambda x: trim(regexp_extract(x, '(?i){_ROLE_LABEL}', 1), ' ')), lambda x: x <> '') as named from jl),
jline as (select request_id, unnest(ls) as line, generate_subscripts(ls, 1) as k from jl),
jmark as (select *, lower(regexp_extract(line, '^([^:]{{1,50}}): *(.+)$', 1)) as label, regexp_extract(line, '^([^:]{{1,50}}): *(.+)$', 2) as rest, regexp_matches(line, '^[-•*·]') as bullet from jline),
jhead as (select *, case when not bullet and label = '' then case when length(line) > 60 then 'none' when regexp_matches(lower(line), '{WELCOME}') then 'nice' when regexp_matches(lower(line), '{WANTED}') then 'must' else 'none' end end as head from jmark),
jfill as (select *, last_value(head ignore nulls) over (partition by request_id order by k rows unbounded preceding) as under from jhead),
jside as (select request_id, k, case when regexp_matches(label, '{WELCOME}') then 'nice' when regexp_matches(label, '{WANTED}') then 'must' when bullet and under in ('nice', 'must') then under end as side,
  case when regexp_matches(label, '{WELCOME}|{WANTED}') then rest else regexp_replace(line, '^[-•*· ]+', '') end as said from jfill),
jpart as (select request_id, side, k, unnest(regexp_split_to_array(said, '{_CUT}')) as raw, generate_subscripts(regexp_split_to_array(said, '{_CUT}'), 1) as n from jside where side is not null),
jtrim as (select request_id, side, k, n, trim(raw, ' .:-') as item from jpart),
jfirst as (select * from jtrim where length(item) between 2 and 60 qualify row_number() over (partition by request_id, side, lower(item) order by k, n) = 1),
jlist as (select request_id, side, item, row_number() over (partition by request_id, side order by k, n) as place from jfirst qualify place <= {LISTED})"""


def job_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, low, role, must, nice) of every job description, in one pass over its text: role line, listed items by what their label or heading says, each once, at most LISTED."""
    lines = F.filter(F.transform(F.split("jd_text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    named = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, f"(?i){_ROLE_LABEL}", 1))), lambda x: x != "")
    start = F.struct(F.lit("none").alias("under"), F.array().cast("array<struct<side:string,item:string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        pattern = "^([^:]{1,50}): *(.+)$"
        label, bullet = F.lower(F.regexp_extract(line, pattern, 1)), line.rlike("^[-•*·]")
        by_label = F.when(label.rlike(WELCOME), "nice").when(label.rlike(WANTED), "must")
        low = F.lower(line)
        head = F.when(F.length(line) > 60, "none").when(low.rlike(WELCOME), "nice").when(low.rlike(WANTED), "must").otherwise("none")
        under = F.when(~bullet & (label == ""), head).otherwise(acc["under"])
        side = F.coalesce(by_label, F.when(bullet & under.isin("nice", "must"), under))
        said = F.when(by_label.isNotNull(), F.regexp_extract(line, pattern, 2)).otherwise(F.regexp_replace(line, "^[-•*· ]+", ""))
        parts = F.filter(F.transform(F.split(said, _CUT), lambda x: F.trim(x, F.lit(" .:-"))), lambda x: F.length(x).between(2, 60))
        return F.struct(under.alias("under"), F.when(side.isNotNull(), F.concat(acc["out"], F.transform(parts, lambda x: F.struct(side.alias("side"), x.alias("item"))))).otherwise(acc["out"]).alias("out"))

    listed = F.aggregate(lines, start, step, lambda acc: acc["out"])
    keep = {"low": F.lower("jd_text"), "role": F.coalesce(F.get(named, F.lit(0)), F.get(lines, F.lit(0))), "listed": listed}
    j = latest(table(spark, sf_dir, "score_requests").where("jd_text is not null"), "request_id", ["ingested_at"], keep)
    none = F.array().cast("array<string>")

    def side(name: str) -> Column:
        items = F.transform(F.filter("listed", lambda x: x["side"] == name), lambda x: x["item"])
        once = F.aggregate(items, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
        return F.slice(once, 1, LISTED)

    return j.select("request_id", "low", F.left("role", F.lit(120)).alias("role"), side("must").alias("must"), side("nice").alias("nice"))


def _floor(low: Column) -> Column:
    return F.expr("try_cast(nullif(y, '') as int)") if low is None else F.nullif(F.regexp_extract(ascii_digits(low), _YEARS, 1), F.lit("")).cast("int")


@R.query(f"""
with {JOBS_SQL}, g as (select request_id, string_agg(item, '; ' order by place) filter (side = 'must') as must, string_agg(item, '; ' order by place) filter (side = 'nice') as nice from jlist group by 1)
select request_id, left(coalesce(named[1], ls[1]), 120) as role, try_cast(nullif(regexp_extract({_DIG.format('low')}, '{_YEARS}', 1), '') as int) as min_years, {_DEGREE_SQL} as degree, coalesce(must, '') as must, coalesce(nice, '') as nice from jr left join g using (request_id)""")
def jobs_parsed(spark, sf_dir):
    """Every job description as a role, the years and the degree that it asks for, and what it requires and welcomes."""
    j = job_parts(spark, sf_dir)
    return j.select("request_id", "role", _floor(F.col("low")).alias("min_years"), _degree(F.col("low")).alias("degree"), F.array_join("must", "; ").alias("must"), F.array_join("nice", "; ").alias("nice"))


@R.query(f"""
with {JOBS_SQL}, one as (select request_id, try_cast(nullif(regexp_extract({_DIG.format('low')}, '{_YEARS}', 1), '') as int) as y, {_DEGREE_SQL} as degree from jr),
q as (select request_id, case side when 'must' then 1 else 2 end as part, place, item as text, case side when 'must' then 'required' else 'preferred' end as kind, 'skill' as rtype from jlist
  union all select request_id, 3, 1, y || '+ years', 'required', 'years' from one where y between 1 and 40 union all select request_id, 4, 1, degree || ' degree', 'required', 'education' from one where degree is not null)
select request_id, 'r' || row_number() over (partition by request_id order by part, place) as req_id, text, kind, rtype from q""")
def job_requirements(spark, sf_dir):
    """The requirements that every job description states, numbered: what it requires, what it welcomes, years, degree."""
    j = job_parts(spark, sf_dir).withColumn("y", _floor(F.col("low"))).withColumn("degree", _degree(F.col("low")))
    row = lambda text, kind, rtype: F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(rtype).alias("rtype"))
    none = F.array().cast("array<struct<text:string,kind:string,rtype:string>>")
    rows = F.concat(
        F.transform("must", lambda x: row(x, "required", "skill")), F.transform("nice", lambda x: row(x, "preferred", "skill")),
        F.when(F.col("y").between(1, 40), F.array(row(F.concat(F.col("y").cast("string"), F.lit("+ years")), "required", "years"))).otherwise(none),
        F.when(F.col("degree").isNotNull(), F.array(row(F.concat("degree", F.lit(" degree")), "required", "education"))).otherwise(none),
    )
    return j.select("request_id", F.posexplode(rows).alias("k", "r")).select("request_id", F.concat(F.lit("r"), (F.col("k") + 1).cast("string")).alias("req_id"), "r.*")


_SEEN = "(select * from requirements qualify row_number() over (partition by request_id, req_id order by text, rtype, kind) = 1)"


@R.query(f"""
select request_id, req_id, case when rtype = 'years' and min_years > 0 then cast(min_years as int) || '+ yrs experience' when rtype = 'education' and degree_level is not null then upper(left(degree_level, 1)) || lower(degree_level[2:]) || ' degree'
  else case when length(lab) <= 34 then lab when contains(left(lab, 34)[21:], ' ') then regexp_replace(left(lab, 34), ' [^ ]*$', '') || '…' else left(lab, 34) || '…' end end as label
from (select *, case when len(keywords) > 1 and length(keywords[2]) >= 3 and length(keywords[1]) + length(keywords[2]) < 18 then keywords[1] || '/' || keywords[2] when len(keywords) > 0 then keywords[1]
  else array_to_string(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:4], ' ') end as lab from {_SEEN})""")
def short_labels(spark, sf_dir):
    """A label for each requirement that fits a cell: years, degree, keywords, or the first words, cut at a word."""
    r = table(spark, sf_dir, "requirements").groupBy("request_id", "req_id").agg(F.min(F.struct("text", "rtype", "kind", "keywords", "min_years", "degree_level")).alias("x")).select("request_id", "req_id", "x.*")
    a, b = F.get("keywords", F.lit(0)), F.get("keywords", F.lit(1))
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 4), " ")
    lab = F.when((F.size("keywords") > 1) & (F.length(b) >= 3) & (F.length(a) + F.length(b) < 18), F.concat(a, F.lit("/"), b)).when(F.size("keywords") > 0, a).otherwise(words)
    head = F.left("lab", F.lit(34))
    cut = F.when(F.length("lab") <= 34, F.col("lab")).when(F.substr(head, F.lit(21)).contains(" "), F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("…"))).otherwise(F.concat(head, F.lit("…")))
    years = F.when((F.col("rtype") == "years") & (F.col("min_years") > 0), F.concat(F.col("min_years").cast("int").cast("string"), F.lit("+ yrs experience")))
    degree = F.when((F.col("rtype") == "education") & F.col("degree_level").isNotNull(), F.concat(F.upper(F.left("degree_level", F.lit(1))), F.lower(F.substr("degree_level", F.lit(2))), F.lit(" degree")))
    return r.withColumn("lab", lab).select("request_id", "req_id", F.coalesce(years, degree, cut).alias("label"))


@R.query(f"""
with s as (select *, try_cast(req_id[2:] as int) as pos from {_SEEN}), g as (select *, coalesce(nullif(lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))), ''), '#' || req_id) as lab from s),
w as (select request_id, rtype, lab, list(x order by pos, i) as ws from (select request_id, rtype, lab, pos, unnest(keywords) as x, generate_subscripts(keywords, 1) as i from g) where x is not null group by all),
d as (select request_id, rtype, lab, list_filter(ws, lambda x, i: len(list_filter(ws[1:i - 1], lambda y: lower(y) = lower(x))) = 0) as ws from w),
m as (select request_id, rtype, lab, min(pos) as first_pos, max(case when kind = 'required' then 'required' else 'preferred' end) as kind, arg_min(min_years, pos) filter (min_years is not null) as floor, arg_min(degree_level, pos) filter (degree_level is not null) as degree, max(length(text)) as longest, count(*) as merged from g group by all)
select m.request_id, 'r' || row_number() over (partition by m.request_id order by first_pos) as req_id, m.rtype, m.kind, m.floor, m.degree, cast(m.longest as bigint) as longest, cast(m.merged as bigint) as merged, coalesce(array_to_string(d.ws[1:14], ','), '') as keywords
from m left join d on m.request_id = d.request_id and m.rtype is not distinct from d.rtype and m.lab = d.lab""")
def merged_by_request(spark, sf_dir):
    """Requirements of one request with one type and label as one, numbered anew: the stronger kind, the first floor and degree, the longest text, fourteen keywords."""
    r = table(spark, sf_dir, "requirements").groupBy("request_id", "req_id").agg(F.min(F.struct("text", "rtype", "kind", "keywords", "min_years", "degree_level", "label")).alias("x")).select("request_id", "req_id", "x.*")
    pos = F.expr("try_cast(substr(req_id, 2) as int)")
    lab = F.coalesce(F.nullif(F.lower(F.trim(F.regexp_replace("label", r"\s+", " "))), F.lit("")), F.concat(F.lit("#"), "req_id"))
    g = r.withColumn("pos", pos).withColumn("lab", lab)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    each = F.transform(F.array_sort(F.collect_list(F.struct("pos", "keywords"))), lambda x: F.coalesce(x["keywords"], F.array().cast("array<string>")))  # the requirements of one request
    m = g.groupBy("request_id", "rtype", "lab").agg(
        F.min("pos").alias("first_pos"), F.max(F.when(F.col("kind") == "required", "required").otherwise("preferred")).alias("kind"), first("min_years").alias("floor"), first("degree_level").alias("degree"),
        F.max(F.length("text").cast("long")).alias("longest"), F.count("*").alias("merged"), F.array_compact(F.flatten(each)).alias("ws"),
    )
    once = F.aggregate("ws", F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    whole = m.select("request_id", "first_pos", F.struct("rtype", "kind", "floor", "degree", "longest", "merged", F.array_join(F.slice(once, 1, 14), ",").alias("keywords")).alias("x"))
    numbered = whole.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("first_pos", "x"))).alias("xs"))  # the requirements of one request
    return numbered.select("request_id", F.posexplode("xs").alias("k", "r")).select("request_id", F.concat(F.lit("r"), (F.col("k") + 1).cast("string")).alias("req_id"), "r.x.*")


# The last request of each session, and its requirements.
LAST_SQL = f"""
lq as (select chat_id, request_id from (select * from score_requests where request_id is not null and chat_id is not null qualify row_number() over (partition by request_id order by ingested_at desc nulls last) = 1)
  qualify row_number() over (partition by chat_id order by requested_at desc nulls last, request_id desc) = 1),
lr as (select lq.chat_id, lq.request_id, r.req_id, r.kind, r.rtype, coalesce(r.keywords, []) as kws, r.text, r.min_years, r.degree_level from lq join {_SEEN} r using (request_id))"""


def last_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chat_id, request_id, reqs) of the last request of each session; reqs: its requirements, a handful."""
    own = latest(table(spark, sf_dir, "score_requests"), "request_id", ["ingested_at"], ["chat_id", "requested_at"]).where("chat_id is not null")
    last = own.groupBy("chat_id").agg(F.max(F.struct("requested_at", "request_id"))["request_id"].alias("request_id"))
    r = table(spark, sf_dir, "requirements").groupBy("request_id", "req_id").agg(F.min(F.struct("text", "rtype", "kind", "keywords", "min_years", "degree_level")).alias("x")).select("request_id", "req_id", "x.*")
    kws = F.coalesce("keywords", F.array().cast("array<string>")).alias("kws")
    return r.join(last, "request_id").groupBy("chat_id", "request_id").agg(F.sort_array(F.collect_list(F.struct("req_id", "kind", "rtype", kws, "text", "min_years", "degree_level"))).alias("reqs"))  # at most a request's requirements


_BAG_SQL = "select {id}, b, count(*)::double as n from (select {id}, ('0x' || left(sha1(tok), 12))::bigint % 128 as b from (select {id}, unnest(regexp_extract_all(lower({text}), '[a-z][a-z0-9+#./]{{0,29}}')) as tok from {rel})) group by all"
_BLOB_SQL = "concat_ws(' ', headline, array_to_string(list_transform(skills, lambda s: s.name), ' '), array_to_string(list_transform(experiences, lambda e: e.title), ' '), summary)"


def bag(text: Column) -> Column:
    """A text as counts of its words' buckets among 128: map<long, double>."""
    toks = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9+#./]{0,29})"), 1), lambda t: F.conv(F.substring(F.sha1(t), 1, 12), 16, 10).cast("long") % 128)
    empty = F.create_map().cast("map<bigint,double>")
    return F.aggregate(toks, empty, lambda m, b: F.map_concat(F.map_filter(m, lambda k, v: k != b), F.create_map(b, F.coalesce(F.try_element_at(m, b), F.lit(0.0)) + 1)))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of two bags; 0 if one is empty."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    length = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(dot / F.nullif(length(a) * length(b), F.lit(0.0)), F.lit(0.0))


@R.query(f"""
with {LAST_SQL},
crit as (select chat_id, request_id, list_distinct(flatten(list(kws) filter (rtype = 'skill' and kind = 'required'))) as must, max(min_years) as floor, string_agg(array_to_string(kws, ' '), ' ' order by req_id) as role from lr group by all),
c as (select profile_id, chat_id, coalesce(total_years_experience.value, 0) as years, extraction.status = 'NEEDS_REVIEW' as review, coalesce(list_transform(list_filter(skills, lambda s: s.name is not null), lambda s: lower(s.name)), []) as names, {_BLOB_SQL} as blob from {CURRENT} where chat_id is not null),
cb as ({_BAG_SQL.format(id='profile_id', text='blob', rel='c')}), rb as ({_BAG_SQL.format(id='chat_id', text='role', rel='crit')}),
cn as (select profile_id, sqrt(sum(n * n)) as l from cb group by 1), rn as (select chat_id, sqrt(sum(n * n)) as l from rb group by 1),
sem as (select c.profile_id, sum(cb.n * rb.n) / (any_value(cn.l) * any_value(rn.l)) as s from c join cb using (profile_id) join rb on c.chat_id = rb.chat_id and cb.b = rb.b join cn using (profile_id) join rn on c.chat_id = rn.chat_id group by 1),
f as (select c.profile_id, crit.request_id, c.review, coalesce(sem.s, 0.0) as sem, least(1.0, years / case when floor > 0 then floor else 10.0 end) as fit,
  case when len(must) > 0 then len(list_filter(must, lambda m: len(list_filter(names, lambda n: contains(n, lower(m)) or contains(lower(m), n))) > 0)) / len(must) end as cover from c join crit using (chat_id) left join sem using (profile_id))
select request_id, profile_id, round((case when cover is null then 0.6 * sem + 0.4 * fit else 0.5 * cover + 0.25 * fit + 0.25 * sem end) * case when review then 0.85 else 1.0 end + 1e-9, 4) as score, round(sem, 3) as semantic, round(cover, 4) as coverage from f""")
def role_fit(spark, sf_dir):
    """How each profile fits the last request of its session: required skills that it has (either name in the other), years, likeness of words; less for profiles to be looked at."""
    reqs = last_requirements(spark, sf_dir)
    wanted = F.filter("reqs", lambda r: (r["rtype"] == "skill") & (r["kind"] == "required"))
    must = F.array_distinct(F.flatten(F.transform(wanted, lambda r: r["kws"])))
    floor = F.array_max(F.transform("reqs", lambda r: r["min_years"]))
    role = F.array_join(F.transform("reqs", lambda r: F.array_join(r["kws"], " ")), " ")
    crit = reqs.select("chat_id", "request_id", must.alias("must"), floor.alias("floor"), bag(role).alias("role"))
    blob = F.concat_ws(" ", "headline", F.array_join("skills.name", " "), F.array_join("experiences.title", " "), "summary")
    keep = {
        "chat_id": F.col("chat_id"), "years": F.coalesce("total_years_experience.value", F.lit(0.0)), "review": F.coalesce(F.col("extraction.status") == "NEEDS_REVIEW", F.lit(False)), "blob": bag(blob),
        "names": F.coalesce(F.transform(F.filter("skills", lambda s: s["name"].isNotNull()), lambda s: F.lower(s["name"])), F.array().cast("array<string>")),
    }
    c = current_profiles(spark, sf_dir, keep).where("chat_id is not null").join(small(crit), "chat_id")
    has = lambda m: F.exists("names", lambda n: n.contains(F.lower(m)) | F.lower(m).contains(n))
    cover = F.when(F.size("must") > 0, F.size(F.filter("must", has)) / F.size("must"))
    fit = F.least(F.lit(1.0), F.col("years") / F.when(F.col("floor") > 0, F.col("floor")).otherwise(10.0))
    c = c.select("request_id", "profile_id", "review", bag_cosine(F.col("blob"), F.col("role")).alias("sem"), fit.alias("fit"), cover.alias("cover"))
    base = F.when(F.col("cover").isNull(), 0.6 * F.col("sem") + 0.4 * F.col("fit")).otherwise(0.5 * F.col("cover") + 0.25 * F.col("fit") + 0.25 * F.col("sem"))
    return c.select("request_id", "profile_id", F.round(base * F.when(F.col("review"), 0.85).otherwise(1.0) + 1e-9, 4).alias("score"), F.round("sem", 3).alias("semantic"), F.round("cover", 4).alias("coverage"))


_RANK = f"greatest({', '.join(f'''case when regexp_matches(lower(d), '(^|[^{T.WORD_CLASS}])({p})($|[^{T.WORD_CLASS}])') then {k} end''' for _, k, p in T.DEGREES)})"
_WANT = "case degree_level " + " ".join(f"when '{n}' then {k}" for n, k, _ in T.DEGREES) + " end"
# The months of every role, with its title.
_DATED = P6.replace('x."end" as b from', 'x."end" as b, x.title as title from').partition("spans as (")[0].rstrip().rstrip(",")
#: Share of the years asked for that is nearly enough.
NEARLY = 0.75


@R.query(f"""
with {LAST_SQL},
c as (select profile_id, chat_id, total_years_experience.value as years, coalesce(list_transform(experiences, lambda e: {{'t': lower(coalesce(e.title, '')), 's': e.start, 'e': e."end"}}), []) as roles, coalesce(list_transform(education, lambda e: concat_ws(' ', e.degree, e.field, e.institution)), []) as edu from {CURRENT} where chat_id is not null),
dates as ({_DATED} select r.profile_id, lower(coalesce(r.title, '')) as title, a.i as s, b.i as e from roles r join idx a on r.rid = a.rid and not a.is_end join idx b on r.rid = b.rid and b.is_end where b.i >= a.i),
q as (select * from lr where rtype = 'years'),
hit as (select q.chat_id, q.req_id, d.profile_id, min(s) as s0, d.s, d.e from q join c using (chat_id) join dates d on c.profile_id = d.profile_id where len(list_filter(q.kws, lambda k: contains(d.title, lower(k)))) > 0 group by all),
marked as (select *, max(e) over (partition by profile_id, req_id order by s, e rows between unbounded preceding and 1 preceding) as reach from hit),
months as (select profile_id, req_id, sum(greatest(0, e - greatest(s, coalesce(reach + 1, s)) + 1)) as m from marked group by all)
select q.request_id, c.profile_id, q.req_id, case when q.min_years is null or c.years is null then 'unverified'
  when len(q.kws) > 0 then case when least(round(coalesce(m.m, 0) / 12.0, 1), c.years) >= q.min_years then 'met' when c.years >= q.min_years then 'partial' when c.years >= {NEARLY} * q.min_years then 'partial' else 'missing' end
  when c.years >= q.min_years then 'met' when c.years >= {NEARLY} * q.min_years then 'partial' else 'missing' end as verdict
from q join c using (chat_id) left join months m on m.profile_id = c.profile_id and m.req_id = q.req_id""")
def years_verdicts(spark, sf_dir):
    """Years asked for by the last request of its session against each profile: years in roles whose title names the field meet it, years in all only in part."""
    q = last_requirements(spark, sf_dir).select("chat_id", "request_id", F.inline("reqs")).where("rtype = 'years'").select("chat_id", "request_id", "req_id", "kws", "min_years")
    roles = role_months(F.col("experiences"), title=True)
    c = current_profiles(spark, sf_dir, {"chat_id": F.col("chat_id"), "years": F.col("total_years_experience.value"), "roles": roles}).where("chat_id is not null")
    pairs = c.join(small(q), "chat_id")
    in_field = F.filter("roles", lambda r: (r["e"] >= r["s"]) & F.exists("kws", lambda k: r["title"].contains(F.lower(k))))
    # Months of the roles in the field, overlaps counted once: sorted by start, what lies beyond the reach so far.
    spans = F.array_sort(F.transform(in_field, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("m"), F.lit(-1).cast("bigint").alias("reach"))
    months = F.aggregate(spans, zero, lambda a, x: F.struct((a["m"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"].cast("bigint"), a["reach"] + 1) + 1)).cast("bigint").alias("m"), F.greatest(a["reach"], x["e"].cast("bigint")).alias("reach")), lambda a: a["m"])
    field = F.least(F.round(months / F.lit(12.0), 1), F.col("years"))
    need, years = F.col("min_years"), F.col("years")
    verdict = F.when(need.isNull() | years.isNull(), "unverified").when((F.size("kws") > 0) & (field >= need), "met").when((F.size("kws") == 0) & (years >= need), "met").when(years >= NEARLY * need, "partial").otherwise("missing")
    return pairs.select("request_id", "profile_id", "req_id", verdict.alias("verdict"))


@R.query(f"""
with {LAST_SQL}, c as (select profile_id, chat_id, coalesce(list_transform(education, lambda e: lower(concat_ws(' ', e.degree, e.field, e.institution))), []) as edu from {CURRENT} where chat_id is not null),
d as (select profile_id, unnest(edu) as d from c), best as (select profile_id, max({_RANK}) as rank from d group by 1),
q as (select *, {_WANT} as want, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}]{{4,}}'), lambda w: not regexp_matches(w, '^({'|'.join(p for _, _, p in T.DEGREES)}|degree|diplom[ae]?|abschluss|diplôme|título|grau|شهادة|درجة)$')) as field from lr where rtype = 'education')
select q.request_id, c.profile_id, q.req_id, case when len(edu) = 0 then 'unverified' when best.rank is null or want is not null and best.rank < want then 'missing'
  when len(field) = 0 or len(list_filter(field, lambda f: len(list_filter(edu, lambda e: contains(e, f))) > 0)) > 0 then 'met' else 'partial' end as verdict
from q join c using (chat_id) left join best using (profile_id)""")
def education_verdicts(spark, sf_dir):
    """The degree that the last request of its session asks for against each profile: level and field meet it, the level alone in part."""
    q = last_requirements(spark, sf_dir).select("chat_id", "request_id", F.inline("reqs")).where("rtype = 'education'")
    want = F.coalesce(*[F.when(F.col("degree_level") == n, F.lit(k)) for n, k, _ in T.DEGREES])
    words = "|".join(p for _, _, p in T.DEGREES)
    field = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), 1), lambda w: ~w.rlike(f"^({words}|degree|diplom[ae]?|abschluss|diplôme|título|grau|شهادة|درجة)$"))
    q = q.select("chat_id", "request_id", "req_id", want.alias("want"), field.alias("field"))
    blobs = F.coalesce(F.transform("education", lambda e: F.lower(F.concat_ws(" ", e["degree"], e["field"], e["institution"]))), F.array().cast("array<string>"))
    c = current_profiles(spark, sf_dir, {"chat_id": F.col("chat_id"), "edu": blobs, "rank": F.array_max(F.transform(blobs, T.degree_rank))}).where("chat_id is not null")
    named = F.exists("field", lambda f: F.exists("edu", lambda e: e.contains(f)))
    verdict = F.when(F.size("edu") == 0, "unverified").when(F.col("rank").isNull() | F.coalesce(F.col("rank") < F.col("want"), F.lit(False)), "missing").when((F.size("field") == 0) | named, "met").otherwise("partial")
    return c.join(small(q), "chat_id").select("request_id", "profile_id", "req_id", verdict.alias("verdict"))


_CAREER = P6.replace("s > reach + 1", "s > reach + 2").replace("where b.i >= a.i)", "where b.i >= a.i and a.i >= 1950 * 12 and b.i <= 2027 * 12 + 5)")


@R.query(f"""
with career as ({_CAREER}), m as (select profile_id, sum((cast(left(last_month, 4) as int) * 12 + cast(right(last_month, 2) as int)) - (cast(left(first_month, 4) as int) * 12 + cast(right(first_month, 2) as int)) + 1) as n from career where kind = 'period' group by 1),
t as (select profile_id, total_years_experience.value as given, (select max(y) from (select unnest(list_transform(regexp_extract_all(lower({_DIG.format('full_text')}), '{_YEARS}', 1), lambda x: cast(x as int))) as y) where y between 1 and 45) as said from {CURRENT})
select profile_id, case when n is not null then round(n / 12.0, 1) when given is not null then given else cast(said as double) end as years, case when n is not null then 'dated roles' when given is not null then 'given' when said is not null then 'text' else 'unknown' end as basis,
  coalesce(n is not null and said is not null and abs(round(n / 12.0, 1) - said) >= greatest(2.0, 0.3 * round(n / 12.0, 1)), false) as contradicts from t left join m using (profile_id)""")
def years_basis(spark, sf_dir):
    """Years of experience and where they come from: dated roles since 1950 with pauses of a month counted in, else the value given, else the text; and whether the text says something quite different."""
    said = F.regexp_extract_all(F.lower(ascii_digits(F.col("full_text"))), F.lit(_YEARS), 1)
    most = F.array_max(F.filter(F.transform(said, lambda x: x.cast("int")), lambda n: n.between(1, 45)))
    c = current_profiles(spark, sf_dir, {"given": F.col("total_years_experience.value"), "said": most, "roles": role_months(F.col("experiences"))})
    dated = c.select("profile_id", F.inline("roles")).where("s >= 1950 * 12 and e <= 2027 * 12 + 5 and e >= s").select("profile_id", "s", (F.col("e") + 1).alias("e"))
    spans = periods_and_gaps(dated, "profile_id", "s", "e").where("kind = 'period'").groupBy("profile_id").agg(F.sum(F.col("last") - F.col("first")).alias("n"))
    j = c.select("profile_id", "given", "said").join(spans, "profile_id", "left").withColumn("y", F.round(F.col("n") / F.lit(12.0), 1))
    basis = F.when(F.col("n").isNotNull(), "dated roles").when(F.col("given").isNotNull(), "given").when(F.col("said").isNotNull(), "text").otherwise("unknown")
    apart = F.coalesce(F.abs(F.col("y") - F.col("said")) >= F.greatest(F.lit(2.0), 0.3 * F.col("y")), F.lit(False))
    return j.select("profile_id", F.coalesce("y", "given", F.col("said").cast("double")).alias("years"), basis.alias("basis"), apart.alias("contradicts"))


@R.query("select request_id, req_id, label, kind, rtype from " + _SEEN)
def public_requirements(spark, sf_dir):
    """What may be shown of requirements."""
    r = table(spark, sf_dir, "requirements").groupBy("request_id", "req_id").agg(F.min(F.struct("text", "rtype", "kind", "label")).alias("x"))
    return r.select("request_id", "req_id", "x.label", "x.kind", "x.rtype")


@R.query(f"""
with s as (select profile_id, full_text, unnest(skills).name as name from {CURRENT}), d as (select profile_id, lower(trim(name)) as skill, any_value(full_text) as t from s where trim(name) <> '' group by all),
e as (select *, regexp_replace(skill, '([\\\\.+*?()\\[\\]{{}}|^$#-])', '\\\\\\1', 'g') as k from d)
select profile_id, skill, case when regexp_matches(coalesce(t, ''), '(?i)(?:^|[^{T.WORD_CLASS}])' || k || '(?:$|[^{T.WORD_CLASS}])') then 'stated' else 'inferred' end as basis from e""")
def skill_basis(spark, sf_dir):
    """Distinct skills of each profile: stated if the text of the profile has them as whole words, else inferred."""
    skills = F.array_distinct(F.transform(F.filter("skills", lambda s: F.trim(s["name"]) != ""), lambda s: F.lower(F.trim(s["name"]))))
    plain = lambda s: F.regexp_replace(s, r"([\\.+*?()\[\]{}|^$#-])", r"\\$1")
    stated = lambda s: F.call_function("rlike", F.coalesce("full_text", F.lit("")), F.concat(F.lit(f"(?i)(?:^|[^{T.WORD_CLASS}])"), plain(s), F.lit(f"(?:$|[^{T.WORD_CLASS}])")))
    judged = F.transform(skills, lambda s: F.struct(s.alias("skill"), F.when(stated(s), "stated").otherwise("inferred").alias("basis")))
    return current_profiles(spark, sf_dir, {"x": judged}).select("profile_id", F.inline("x"))


QUERIES, SQL = R.queries, R.sql
