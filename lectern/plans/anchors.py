"""Queries on text: anchors, terms, quotes, instruction-like lines, sections, parsed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.dates import ascii_digits, bind
from lectern.plans.registry import CURRENT, PAGES, Registry
from lectern.sources.shared import small
from lectern.sources.tables import current_profiles, latest, table

R = Registry()
#: Terms of which the patterns are part of a plan, at most.
MOST_TERMS = 500
_DIG = "translate({}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"
_NORM = "lower(trim(regexp_replace({}, '[ \\t\\n\\r\\f]+', ' ', 'g')))"


def pages(spark: SparkSession, sf_dir: str, **keep: Column) -> DataFrame:
    """Every page once, with what is computed from it; re-deliveries are exact, so that the results meet and not the texts."""
    return latest(table(spark, sf_dir, "cv_pages").where("text is not null"), "page_id", ["ingested_at"], keep)


def _lines(text: str = "text") -> Column:
    return F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line")))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@R.query(f"select page_id, md5({_NORM.format(_DIG.format('text'))}) as form, cast(length({_DIG.format('text')}) as bigint) as chars from {PAGES} where text is not null")
def normalized_pages(spark, sf_dir):
    """Page texts with plain digits, collapsed blanks and small letters, as a hash."""
    t = ascii_digits(F.col("text"))
    return pages(spark, sf_dir, form=F.md5(T.norm(t)), chars=F.length(t).cast("long"))


@R.query(f"""
with m as (select page_id, unnest(regexp_extract_all(text, {_q(T.EMAIL)})) as raw from {PAGES}),
e as (select distinct page_id, lower(rtrim(raw, '.')) as email from m)
select page_id, email, regexp_matches(regexp_extract(email, '@([^@]*)$', 1), {_q(T.PLACEHOLDER_DOMAIN)}) or regexp_matches(regexp_extract(email, '^([^@]*)@', 1), {_q(T.PLACEHOLDER_LOCAL)}) as placeholder from e""")
def emails_flagged(spark, sf_dir):
    """E-mail addresses of pages, with a mark on those that stand for no real one."""
    found = pages(spark, sf_dir, e=T.emails(F.col("text"))).select("page_id", F.explode("e").alias("email"))
    return found.select("page_id", "email", T.is_placeholder(F.col("email")).alias("placeholder"))


@R.query(f"""
select distinct page_id, regexp_replace(raw, '[.,);:\\]]+$', '') as link from (select page_id, unnest(regexp_extract_all(text, {_q(T.LINK)})) as raw from {PAGES})""")
def links_found(spark, sf_dir):
    """Links on pages."""
    return pages(spark, sf_dir, x=T.links(F.col("text"))).select("page_id", F.explode(F.array_distinct("x")).alias("link"))


@R.query(f"""
with p as (select page_id, {_DIG.format('text')} as t from {PAGES}),
k as (select page_id, regexp_extract_all(t, {_q(T.PHONE_KEYED)}, 1) as a, regexp_extract_all(t, {_q(T.PHONE_INTL)}) as b from p),
x as (select page_id, unnest(list_concat(a, b)) as raw, generate_subscripts(list_concat(a, b), 1) as k from k),
d as (select page_id, raw, k, regexp_replace(raw, '[^0-9]', '', 'g') as digits from x)
select page_id, right(digits, 9) as key, arg_min(raw, k) as raw from d where length(digits) between 8 and 15 group by page_id, right(digits, 9)""")
def phones_found(spark, sf_dir):
    """Telephone numbers of pages: keyed and international forms, one for each key."""
    return pages(spark, sf_dir, x=T.phones(F.col("text"))).select("page_id", F.inline("x"))


@R.query()
def phones_all(spark, sf_dir):
    """Telephone numbers of pages in all forms: keyed, international with + or 00 and local ones, one for each key. Its lookbehinds have no form in SQL."""
    return pages(spark, sf_dir, x=T.all_phones(F.col("text"))).select("page_id", F.inline("x"))


@R.query(f"""
with c as (select profile_id, list_filter(identity.emails, lambda x: trim(x) <> '') as e, list_filter(identity.phones, lambda x: length(regexp_replace({_DIG.format('x')}, '[^0-9]', '', 'g')) >= 8) as p from {CURRENT})
select profile_id, case when len(e) > 0 then 'email:' || lower(trim(e[1])) when len(p) > 0 then 'phone:' || right(regexp_replace({_DIG.format('p[1]')}, '[^0-9]', '', 'g'), 9) end as anchor from c""")
def primary_anchor(spark, sf_dir):
    """The contact that a profile is known by: its first e-mail address, or else its first number."""
    c = current_profiles(spark, sf_dir, {"e": F.col("identity.emails"), "p": F.col("identity.phones")})
    e, p = F.filter("e", lambda x: F.trim(x) != ""), F.filter("p", lambda x: F.length(F.regexp_replace(ascii_digits(x), "[^0-9]", "")) >= 8)
    anchor = F.when(F.size(e) > 0, F.concat(F.lit("email:"), F.lower(F.trim(F.get(e, F.lit(0)))))).when(F.size(p) > 0, F.concat(F.lit("phone:"), T.phone_key(F.get(p, F.lit(0)))))
    return c.select("profile_id", anchor.alias("anchor"))


@R.query(f"""
with q as (select profile_id, 'skill' as part, unnest(skills).evidence as e from {CURRENT} union all select profile_id, 'experience', unnest(experiences).evidence from {CURRENT} union all select profile_id, 'education', unnest(education).evidence from {CURRENT}),
d as (select distinct profile_id, part, e.quote as quote from q where length(trim(e.quote)) >= 8),
p as (select profile_id, page, {_NORM.format('text')} as t from {PAGES} where text is not null)
select d.profile_id, d.part, d.quote, cast(min(p.page) as int) as page from d left join p on d.profile_id = p.profile_id and contains(p.t, {_NORM.format('d.quote')}) group by all""")
def quote_verify(spark, sf_dir):
    """The first page of its profile that each evidence quote stands on, null if it stands on none."""
    tagged = lambda part, col: F.coalesce(F.transform(f"{col}.evidence.quote", lambda q: F.struct(F.lit(part).alias("part"), q.alias("quote"))), F.array().cast("array<struct<part:string,quote:string>>"))
    c = current_profiles(spark, sf_dir, {"q": F.concat(tagged("skill", "skills"), tagged("experience", "experiences"), tagged("education", "education"))})
    quotes = c.select("profile_id", F.inline("q")).where("length(trim(quote)) >= 8").distinct()
    p = table(spark, sf_dir, "cv_pages").where("page_id is not null and text is not null").select(F.col("profile_id").alias("pid"), "page", T.norm(F.col("text")).alias("t"))
    joined = quotes.join(p, (F.col("profile_id") == F.col("pid")) & F.col("t").contains(T.norm(F.col("quote"))), "left")
    return joined.groupBy("profile_id", "part", "quote").agg(F.min("page").alias("page"))


@R.query(f"""
with s as (select term_id, term, regexp_replace({_NORM.format('term')}, '([\\\\.+*?()\\[\\]{{}}|^$#-])', '\\\\\\1', 'g') as t from skill_terms),
st as (select *, case when length(t) > 3 and t like '%s' and t not like '%ss' then left(t, length(t) - 1) else t end as stem from s),
pt as (select term_id, term, '(?i)(^|[^{T.WORD_CLASS}])' || stem || case when regexp_matches(stem, '[a-z]$') then '(e?s)?' else '' end || '($|[^{T.WORD_CLASS}])' as pattern from st)
select term_id, term, cast(count(distinct p.page_id) as bigint) as pages, cast(count(distinct p.profile_id) as bigint) as profiles from pt left join {PAGES} p on regexp_matches(p.text, pattern) group by all""")
def term_verify(spark, sf_dir):
    """Pages and profiles on which each reference skill stands as whole words, in singular or plural; the list of terms is small and fixed."""
    terms = table(spark, sf_dir, "skill_terms").select("term_id", "term", T.term_pattern(F.col("term")).alias("pattern"), T.term_stem(F.col("term")).alias("stem"))
    few = terms.limit(MOST_TERMS + 1).collect()
    p = table(spark, sf_dir, "cv_pages").where("page_id is not null and text is not null")
    if few and len(few) <= MOST_TERMS:  # each pattern is compiled once; a page is read once for all terms
        found = bind(F.lower("text"), lambda low: F.array_compact(F.array(*[F.when(low.contains(t.stem) & low.rlike(t.pattern), F.lit(t.term_id)) for t in few if t.pattern])))
        met = pages(spark, sf_dir, profile_id=F.col("profile_id"), t=found).select("page_id", "profile_id", F.explode("t").alias("term_id"))
    else:
        met = p.join(terms, F.expr("text rlike pattern")).select("page_id", "profile_id", "term_id")
    hits = met.groupBy("term_id").agg(F.countDistinct("page_id").alias("pages"), F.countDistinct("profile_id").alias("profiles"))
    return terms.select("term_id", "term").join(hits, "term_id", "left").na.fill(0, ["pages", "profiles"])


@R.query(f"""
with h as (select page_id, lower(text) as t from {PAGES} where text is not null),
x as (select page_id, unnest(list_concat({", ".join(f"regexp_extract_all(t, {_q('(' + p + ')')})" for p in T.INJECTION)})) as hit from h)
select page_id, hit, cast(count(*) as bigint) as times from x group by all""")
def injection_flags(spark, sf_dir):
    """Fragments of pages that speak to a model."""
    low = F.lower(F.col("text"))
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(f"({p})"), 1) for p in T.INJECTION]))
    return pages(spark, sf_dir, x=found).select("page_id", F.explode("x").alias("hit")).groupBy("page_id", "hit").agg(F.count("*").alias("times"))


@R.query(f"""
select request_id, md5(array_to_string(list_transform(string_split(jd_text, chr(10)), lambda l: case when regexp_matches(lower(l), {_q('|'.join(T.INJECTION))}) then '[redacted]' else l end), chr(10))) as form
from (select * from score_requests where jd_text is not null qualify row_number() over (partition by request_id order by ingested_at desc nulls last) = 1)""")
def redacted_jobs(spark, sf_dir):
    """Job descriptions without lines that speak to a model, as a hash."""
    return latest(table(spark, sf_dir, "score_requests").where("jd_text is not null"), "request_id", ["ingested_at"], {"form": F.md5(T.redact_lines(F.col("jd_text")))})


@R.query(
    "select * from ("
    + " union all ".join(f"select page_id, '{k}' as attribute, trim(regexp_extract(text, '(?i)(?:^|\\n) *{p} *: *([^\\n]+)', 2)) as found from {PAGES} where regexp_matches(text, '(?i)(?:^|\\n) *{p} *: *[^\\n]')" for k, p in T.PROTECTED.items())
    + ")"
)
def label_leak_scan(spark, sf_dir):
    """Labelled fields of protected attributes on pages."""
    found = F.array(*[F.when(F.col("text").rlike(rf"(?i)(?:^|\n) *{p} *: *[^\n]"), F.struct(F.lit(k).alias("attribute"), F.trim(F.regexp_extract("text", rf"(?i)(?:^|\n) *{p} *: *([^\n]+)", 2)).alias("found"))) for k, p in T.PROTECTED.items()])
    return pages(spark, sf_dir, x=F.array_compact(found)).select("page_id", F.inline("x"))


@R.query("select doc_id, round(coalesce(len(regexp_extract_all(text, '[ء-غف-يٮ-ۓ]')) / nullif(len(regexp_extract_all(text, '\\p{L}')), 0), 0.0), 6) as ratio from documents where text is not null")
def arabic_share(spark, sf_dir):
    """Share of Arabic letters of documents."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.round(T.arabic_ratio(F.col("text")), 6).alias("ratio"))


_SECTION_SQL = "case " + " ".join(f"when regexp_full_match(h, '{w}') then '{n}'" for n, w in T.SECTIONS.items()) + " end"


@R.query(f"""
with l as (select page_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from {PAGES} where text is not null),
h as (select *, lower(trim(rtrim(line, ': '), ' ')) as h from l),
s as (select page_id, line_no, line, {_SECTION_SQL} as head from h),
f as (select *, last_value(head ignore nulls) over (partition by page_id order by line_no rows unbounded preceding) as section from s)
select page_id, coalesce(section, 'top') as section, cast(count(*) as bigint) as lines, cast(sum(length(line)) as bigint) as chars from f where head is null and trim(line, ' ') <> '' group by all""")
def section_sizes(spark, sf_dir):
    """Lines and characters of the sections of each page: headings fill forward over the lines below them."""
    sizes = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), T.section_of(x).alias("head"), (F.trim(x) != "").alias("filled"), F.length(x).cast("long").alias("n")))
    lines = pages(spark, sf_dir, x=sizes).select("page_id", F.inline("x"))
    w = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("section", F.last("head", ignorenulls=True).over(w))
    return filled.where("head is null and filled").groupBy("page_id", F.coalesce("section", F.lit("top")).alias("section")).agg(F.count("*").alias("lines"), F.sum("n").alias("chars"))


_ROLE = r"^[-•* ]*([^,\n(]{2,60}), ([^(\n]{2,60}) \(([^()\n]{3,40}) (?:-|–|to) ([^()\n]{2,40})\)$"


@R.query(f"""
with l as (select page_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from {PAGES} where text is not null)
select page_id, cast(line_no as bigint) as line_no, trim(regexp_extract(line, {_q(_ROLE)}, 1)) as title, trim(regexp_extract(line, {_q(_ROLE)}, 2)) as organization, trim(regexp_extract(line, {_q(_ROLE)}, 3)) as started, trim(regexp_extract(line, {_q(_ROLE)}, 4)) as ended
from l where regexp_matches(line, {_q(_ROLE)})""")
def experience_lines(spark, sf_dir):
    """Dated roles as lines of pages give them."""
    lines = pages(spark, sf_dir, x=F.filter(_lines(), lambda x: x["line"].rlike(_ROLE))).select("page_id", F.inline("x"))
    part = lambda i: F.trim(F.regexp_extract("line", _ROLE, i))
    return lines.select("page_id", "line_no", part(1).alias("title"), part(2).alias("organization"), part(3).alias("started"), part(4).alias("ended"))


@R.query(f"""
with l as (select page_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from {PAGES} where text is not null)
select page_id, cast(line_no as bigint) as line_no, cast(greatest({", ".join(f"case when regexp_matches(lower(line), '(^|[^{T.WORD_CLASS}])({p})($|[^{T.WORD_CLASS}])') then {r} end" for _, r, p in T.DEGREES)}) as int) as rank, try_cast(nullif(regexp_extract(line, '((?:19|20)[0-9]{{2}})$', 1), '') as int) as year
from l where rank is not null""")
def education_lines(spark, sf_dir):
    """Lines that name a degree, with its rank and the year that they end in, if any."""
    ranked = F.filter(F.transform(_lines(), lambda x: F.struct(x["line_no"].alias("line_no"), T.degree_rank(x["line"]).alias("rank"), F.nullif(F.regexp_extract(x["line"], "((?:19|20)[0-9]{2})$", 1), F.lit("")).cast("int").alias("year"))), lambda x: x["rank"].isNotNull())
    return pages(spark, sf_dir, x=ranked).select("page_id", F.inline("x"))


@R.query(f"""
with l as (select page_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from {PAGES} where text is not null),
h as (select page_id, k, line, {_SECTION_SQL.replace("(h,", "(lower(trim(rtrim(line, ': '), ' ')),")} as head from l),
f as (select *, last_value(head ignore nulls) over (partition by page_id order by k rows unbounded preceding) as section from h),
s as (select page_id, unnest(regexp_split_to_array(line, '[,،;/|•·]')) as raw from f where section = 'skills' and head is null)
select page_id, lower(trim(raw, ' ')) as skill, cast(count(*) as bigint) as times from s where length(trim(raw, ' ')) between 1 and 40 group by all""")
def skill_items(spark, sf_dir):
    """Skills that pages list under their heading."""
    start = F.struct(F.lit(None).cast("string").alias("section"), F.array().cast("array<string>").alias("raw"))

    def step(acc: Column, line: Column) -> Column:
        head = T.section_of(line)
        return F.struct(F.coalesce(head, acc["section"]).alias("section"), F.when(head.isNull() & (acc["section"] == "skills"), F.concat(acc["raw"], F.split(line, "[,،;/|•·]"))).otherwise(acc["raw"]).alias("raw"))

    listed = F.aggregate(F.split("text", "\n"), start, step, lambda acc: acc["raw"])
    items = pages(spark, sf_dir, x=listed).select("page_id", F.explode("x").alias("raw")).where("length(trim(raw)) between 1 and 40")
    return items.groupBy("page_id", F.lower(F.trim("raw")).alias("skill")).agg(F.count("*").alias("times"))


@R.query(f"select profile_id, array_to_string(en, '; ') as reasons, array_to_string(ar, '; ') as reasons_ar from (select profile_id, list_transform(extraction.reasons, lambda c: coalesce(map([{', '.join(map(_q, T.REASONS))}], [{', '.join(map(_q, T.REASONS.values()))}])[c], c)) as en, list_transform(extraction.reasons, lambda c: coalesce(map([{', '.join(map(_q, T.REASONS_AR))}], [{', '.join(map(_q, T.REASONS_AR.values()))}])[c], c)) as ar from {CURRENT} where len(extraction.reasons) > 0)")
def reason_phrases(spark, sf_dir):
    """What the reasons of profiles to be looked at say, in English and Arabic."""
    return current_profiles(spark, sf_dir, {"r": F.col("extraction.reasons")}).where("size(r) > 0").select("profile_id", T.reason_text(F.col("r")).alias("reasons"), T.reason_text(F.col("r"), arabic=True).alias("reasons_ar"))


@R.query("select chat_id, 's_' || left(sha1(chat_id), 10) as hashed, left(regexp_replace(chat_id, '[^A-Za-z0-9_.:+-]', '_', 'g'), 48) as slug, cast(count(*) as bigint) as n from chat_sessions where chat_id is not null group by all")
def session_slugs(spark, sf_dir):
    """Names of sessions that may stand in logs."""
    c = F.col("chat_id")
    return table(spark, sf_dir, "chat_sessions").where("chat_id is not null").groupBy("chat_id", T.session_hash(c).alias("hashed"), T.slug(c).alias("slug")).agg(F.count("*").alias("n"))


@R.query("select left(sha256(trim(jd_text)), 16) as jd_hash, cast(count(distinct request_id) as bigint) as requests from score_requests where jd_text is not null group by 1")
def jd_hashes(spark, sf_dir):
    """Job descriptions by their hash, with the requests that bring them."""
    return table(spark, sf_dir, "score_requests").where("jd_text is not null").groupBy(T.text_hash(F.col("jd_text")).alias("jd_hash")).agg(F.countDistinct("request_id").alias("requests"))


@R.query(f"""
select profile_id, case when regexp_matches(lower(source.file), '\\.pdf$') then 'pdf' when regexp_matches(lower(source.file), '\\.docx$') then 'docx' when regexp_matches(lower(source.file), '\\.(png|jpe?g|tiff?|bmp|webp)$') then 'image' else 'unsupported' end as kind,
  regexp_replace(source.file, '^.*[/\\\\]', '') as base from {CURRENT}""")
def file_kinds(spark, sf_dir):
    """Kind of the file of each profile."""
    c = current_profiles(spark, sf_dir, {"f": F.col("source.file")})
    return c.select("profile_id", T.file_kind(F.col("f")).alias("kind"), F.regexp_replace("f", r"^.*[/\\]", "").alias("base"))


@R.query("""
with p as (select distinct reply_id, regexp_replace(trim(payload), '^```[A-Za-z]*\\s*|\\s*```$', '', 'g') as j from model_replies where payload is not null)
select reply_id, case when json_valid(j) then json_type(j) = 'OBJECT' else false end as readable from p""")
def reply_readable(spark, sf_dir):
    """Whether a model reply is a JSON object once its code fence is off."""
    p = latest(table(spark, sf_dir, "model_replies").where("payload is not null"), "reply_id", ["received_at"], ["payload"])
    j = F.try_parse_json(F.regexp_replace(F.trim("payload"), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))
    return p.select("reply_id", F.coalesce(F.schema_of_variant(j).startswith("OBJECT"), F.lit(False)).alias("readable"))


@R.query(f"""
with p as (select profile_id, {_DIG.format('full_text')} as t from {CURRENT}),
x as (select profile_id, unnest(regexp_extract_all(t, '((?:19|20)[0-9]{{2}}) *[-–—] *((?:19|20)[0-9]{{2}})', 1)) as a, unnest(regexp_extract_all(t, '((?:19|20)[0-9]{{2}}) *[-–—] *((?:19|20)[0-9]{{2}})', 2)) as b from p)
select profile_id, cast(a as int) as first_year, cast(b as int) as last_year, cast(count(*) as bigint) as times from x where a <= b group by all""")
def year_ranges(spark, sf_dir):
    """Ranges of years in the texts of profiles."""
    c = current_profiles(spark, sf_dir, ["full_text"]).select("profile_id", F.inline(T.year_spans(F.col("full_text")))).where("a <= b")
    return c.groupBy("profile_id", F.col("a").alias("first_year"), F.col("b").alias("last_year")).agg(F.count("*").alias("times"))


@R.query(f"""
with x as (select request_id, unnest(regexp_extract_all(lower({_DIG.format('left(jd_text, 900)')}), '([0-9]{{1,2}})\\+? *(?:years|yrs|jahre|ans|años|anos|سنوات|سنة|عاما)', 1)) as n from (select distinct request_id, jd_text from score_requests))
select request_id, cast(max(cast(n as int)) as int) as years from x where cast(n as int) between 1 and 45 group by 1""")
def stated_year_claims(spark, sf_dir):
    """The most years that the head of a job description asks for."""
    j = latest(table(spark, sf_dir, "score_requests"), "request_id", ["ingested_at"], ["jd_text"])
    return j.select("request_id", T.stated_years(F.col("jd_text")).alias("years")).where("years is not null")


QUERIES, SQL = R.queries, R.sql
