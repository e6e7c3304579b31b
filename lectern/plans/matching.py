"""Queries of matching: vectors, verdicts on requirements, weighted scores and ranks, agreement, rates by group, near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.dates import ascii_digits
from lectern.operators.neighbours import cosine_top_k
from lectern.operators.similar_sets import similar_texts
from lectern.plans.records import p6_found
from lectern.plans.records_sql import P6
from lectern.plans.registry import CURRENT, Registry
from lectern.sources.shared import small, stored
from lectern.sources.tables import current_profiles, latest, table

R = Registry()


@R.query("""
with q as (select vec_id as q, embedding::double[] as v from embeddings where vec_id % 20 = 0), r as (select vec_id as n, embedding::double[] as v from embeddings),
s as (select q, n, round(list_cosine_similarity(q.v, r.v), 12) as c from q join r on q <> n)
select q as query, n as neighbour, round(c, 6) as cosine, cast(row_number() over (partition by q order by c desc, n) as int) as place from s qualify place <= 5""")
def cosine_topk(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 20, among all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cosine_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("query", "neighbour", F.round("cosine", 6).alias("cosine"), "place")


@R.query("""
with t as (select term_id, unnest(regexp_extract_all(lower(term), '[a-z][a-z0-9+#./]{0,29}')) as tok from skill_terms)
select term_id, tok as token, cast(('0x' || left(sha1(tok), 12))::bigint % 128 as bigint) as bucket, cast(count(*) as bigint) as n from t group by all""")
def hash_embed_buckets(spark, sf_dir):
    """Buckets of a hashed bag of words: the place of each token of a skill among 128."""
    t = table(spark, sf_dir, "skill_terms").select("term_id", F.explode(F.regexp_extract_all(F.lower("term"), F.lit("([a-z][a-z0-9+#./]{0,29})"), 1)).alias("token"))
    return t.groupBy("term_id", "token", (F.conv(F.substring(F.sha1("token"), 1, 12), 16, 10).cast("long") % 128).alias("bucket")).agg(F.count("*").alias("n"))


_BAG = "select {id}, ('0x' || left(sha1(tok), 12))::bigint % 128 as b, count(*)::double as n from (select {id}, unnest(regexp_extract_all(lower({text}), '[a-z][a-z0-9+#./]{{0,29}}')) as tok from {rel}) group by all"


@R.query(f"""
with names as (select distinct s.name as name from (select unnest(skills) as s from {CURRENT}) where s.name is not null),
t as ({_BAG.format(id='term_id', text='term', rel='skill_terms')}), k as ({_BAG.format(id='name', text='name', rel='names')}),
tn as (select term_id, sqrt(sum(n * n)) as l from t group by 1), kn as (select name, sqrt(sum(n * n)) as l from k group by 1),
d as (select k.name, t.term_id, sum(k.n * t.n) as dot from k join t using (b) group by all)
select name, term_id, round(dot / (tn.l * kn.l), 6) as similarity from d join tn using (term_id) join kn using (name) qualify row_number() over (partition by name order by round(dot / (tn.l * kn.l), 6) desc, term_id) = 1""")
def semantic_best(spark, sf_dir):
    """The reference skill that each distinct skill name is nearest to, by cosine of hashed bags of words; the list of reference skills is small and fixed."""
    names = current_profiles(spark, sf_dir, {"s": F.col("skills.name")}).select(F.explode("s").alias("name")).where("name is not null").distinct()

    def bag(df: DataFrame, key: str, text: str) -> DataFrame:
        t = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9+#./]{0,29})"), 1)).alias("tok"))
        n = t.groupBy(key, (F.conv(F.substring(F.sha1("tok"), 1, 12), 16, 10).cast("long") % 128).alias("b")).agg(F.count("*").cast("double").alias("n"))
        return n.withColumn("l", F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key))))

    a, b = bag(names, "name", "name"), bag(table(spark, sf_dir, "skill_terms"), "term_id", "term").withColumnsRenamed({"n": "m", "l": "r"})
    s = a.join(small(b), "b").groupBy("name", "term_id", "l", "r").agg(F.sum(F.col("n") * F.col("m")).alias("dot")).select("name", "term_id", F.round(F.col("dot") / (F.col("l") * F.col("r")), 6).alias("similarity"))
    return s.groupBy("name").agg(F.max_by("term_id", F.struct("similarity", -F.col("term_id"))).alias("term_id"), F.max("similarity").alias("similarity"))


_CASE = """case
  when rtype = 'years' and years is null then 'unverified' when rtype = 'years' and list_has_any(names, kws) and years >= min_years then 'met' when rtype = 'years' and list_has_any(names, kws) and years >= 0.75 * min_years then 'partial' when rtype = 'years' then 'missing'
  when list_has_any(names, kws) then 'met' when len(list_filter(kws, lambda k: contains(t, k))) > 0 then 'partial' else 'missing' end as verdict"""


_CREDIT = "case verdict when 'met' then 2 when 'partial' then 1 when 'missing' then 0 end * case when kind = 'required' then 5 else 2 end"


REQUESTS_SQL = f"""
c as (select profile_id, chat_id, total_years_experience.value as years, coalesce(list_transform(list_filter(skills, lambda s: s.name is not null), lambda s: lower(s.name)), []) as names, lower(coalesce(full_text, '')) as t from {CURRENT} where extraction.status = 'OK'),
o as (select request_id, chat_id from score_requests where request_id is not null qualify row_number() over (partition by request_id order by ingested_at desc nulls last) = 1),
q as (select distinct request_id, chat_id, req_id, kind, rtype, coalesce(list_transform(keywords, lambda k: lower(k)), []) as kws, min_years from requirements join o using (request_id)),
v as (select request_id, profile_id, req_id, kind, {_CASE} from c join q using (chat_id))"""
#: Profiles and requests of one session that meet in one task.
PROFILE_BLOCK, REQUEST_BLOCK = 500, 200
_VERDICTS = ["missing", "partial", "met", "unverified"]


def _block(n: str, size: int) -> Column:
    return F.ceil(F.col(n) / size).cast("int")


def session_verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, requests, sizes): each readable profile's verdicts on the distinct tests of its session's requirements, and the requirements of every request as places in them.

    profiles: chat_id, a, profile_id, codes (by test, index into _VERDICTS). requests: chat_id, b, request_id, reqs (req_id, kind, test). sizes: chat_id, as, bs, the numbers of blocks
    that a session's profiles and requests are hashed into. Many requirements are one test (kind of test, keywords, years), which is judged once for each profile.
    """
    kws = F.coalesce(F.transform("keywords", F.lower), F.array().cast("array<string>"))
    own = latest(table(spark, sf_dir, "score_requests"), "request_id", ["ingested_at"], ["chat_id"]).where("chat_id is not null")
    reqs = table(spark, sf_dir, "requirements").select("request_id", "req_id", "kind", F.struct("rtype", kws.alias("kws"), "min_years").alias("test")).distinct().join(own, "request_id")
    tests = reqs.groupBy("chat_id").agg(F.array_sort(F.collect_set("test")).alias("tests"), F.count_distinct("request_id").alias("requests"))  # the distinct tests of a session
    keep = {
        "chat_id": F.col("chat_id"), "years": F.col("total_years_experience.value"), "st": F.col("extraction.status"), "t": F.lower(F.coalesce("full_text", F.lit(""))),
        "names": F.coalesce(F.transform(F.filter("skills", lambda s: s["name"].isNotNull()), lambda s: F.lower(s["name"])), F.array().cast("array<string>")),
    }
    c = stored(current_profiles(spark, sf_dir, keep).where("st = 'OK' and chat_id is not null"))
    tests = stored(tests.join(c.groupBy("chat_id").agg(F.count("*").alias("profiles")), "chat_id").select("chat_id", "tests", _block("profiles", PROFILE_BLOCK).alias("as"), _block("requests", REQUEST_BLOCK).alias("bs")))
    sizes = tests.select("chat_id", "as", "bs")

    def code(x: Column) -> Column:
        listed, enough = F.arrays_overlap("names", x["kws"]), lambda share: F.col("years") >= share * x["min_years"]
        of_years = F.when(F.col("years").isNull(), 3).when(listed & enough(1.0), 2).when(listed & enough(0.75), 1).otherwise(0)
        return F.when(x["rtype"] == "years", of_years).when(listed, 2).when(F.exists(x["kws"], lambda k: F.col("t").contains(k)), 1).otherwise(0).cast("byte")

    sided = c.join(small(sizes), "chat_id").withColumn("a", F.pmod(F.xxhash64("profile_id"), F.col("as")).cast("int")).drop("as", "bs")
    spread = tests.select("chat_id", "tests", F.explode(F.sequence(F.lit(0), F.col("as") - 1)).alias("a"))  # a session's tests to each block of its profiles
    profiles = sided.join(spread, ["chat_id", "a"]).select("chat_id", "a", "profile_id", F.transform("tests", code).alias("codes"))
    placed = reqs.join(tests, "chat_id").select("chat_id", F.pmod(F.xxhash64("request_id"), F.col("bs")).cast("int").alias("b"), "request_id", "req_id", "kind", F.array_position("tests", F.col("test")).cast("int").alias("test"))
    requests = placed.groupBy("chat_id", "b", "request_id").agg(F.sort_array(F.collect_list(F.struct("req_id", "kind", (F.col("test") - 1).alias("test")))).alias("reqs"))  # at most a request's requirements
    return profiles, requests, sizes


def request_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, profile_id, vs) of every request with every readable profile of its session; vs: (req_id, kind, code) of each requirement, the code an index into _VERDICTS.

    A block of profiles meets a block of requests, so that a large session is spread over many tasks.
    """
    profiles, requests, sizes = session_verdicts(spark, sf_dir)
    sizes = small(sizes)
    p = stored(profiles).join(sizes, "chat_id").select("chat_id", "a", F.explode(F.sequence(F.lit(0), F.col("bs") - 1)).alias("b"), "profile_id", "codes")
    r = requests.join(sizes, "chat_id").select("chat_id", F.explode(F.sequence(F.lit(0), F.col("as") - 1)).alias("a"), "b", "request_id", "reqs")
    return p.join(r.hint("shuffle_hash"), ["chat_id", "a", "b"]).select("request_id", "profile_id", F.transform("reqs", lambda x: F.struct(x["req_id"].alias("req_id"), x["kind"].alias("kind"), F.get("codes", x["test"]).alias("code"))).alias("vs"))


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, req_id, verdict, n): how many readable profiles of its session get each verdict on each requirement; counted by test, then given to the requirements."""
    profiles, requests, _ = session_verdicts(spark, sf_dir)
    n = profiles.select("chat_id", F.posexplode("codes").alias("test", "code")).groupBy("chat_id", "test", "code").agg(F.count("*").alias("n"))
    each = requests.select("chat_id", "request_id", F.inline("reqs")).select("chat_id", "request_id", "req_id", "test").distinct()
    names = F.array(*map(F.lit, _VERDICTS))
    return each.join(n, ["chat_id", "test"]).groupBy("request_id", "req_id", F.get(names, F.col("code")).alias("verdict")).agg(F.sum("n").alias("n"))


@R.query(f"""with {REQUESTS_SQL},
s as (select request_id, profile_id, sum({_CREDIT}) as got, sum(case when verdict <> 'unverified' then 2 * case when kind = 'required' then 5 else 2 end end) as possible, count_if(verdict = 'met') as met, count_if(verdict = 'missing' and kind = 'required') as missing_required from v group by all),
z as (select request_id, profile_id, cast(round_even(100.0 * got / possible, 0) as bigint) as score, cast(met as bigint) as met, cast(missing_required as bigint) as missing_required from s where possible > 0)
select *, cast(rank() over (partition by request_id order by score desc) as bigint) as place from z qualify place <= 50""")
def fit_score_requests(spark, sf_dir):
    """Profiles scored against every request of their session and ranked within it, ties sharing a place, down to place 50; unverified requirements leave both sums."""
    weight = lambda x: F.when(x["kind"] == "required", 5).otherwise(2)
    total = lambda f: F.aggregate("vs", F.lit(0), lambda acc, x: acc + f(x))
    z = request_pairs(spark, sf_dir).select(
        "request_id", "profile_id", total(lambda x: F.when(x["code"] < 3, x["code"] * weight(x)).otherwise(0)).alias("got"), total(lambda x: F.when(x["code"] < 3, 2 * weight(x)).otherwise(0)).alias("possible"),
        total(lambda x: F.when(x["code"] == 2, 1).otherwise(0)).cast("long").alias("met"), total(lambda x: F.when((x["code"] == 0) & (x["kind"] == "required"), 1).otherwise(0)).cast("long").alias("missing_required"),
    )
    z = z.where("possible > 0").select("request_id", "profile_id", F.bround(100.0 * F.col("got") / F.col("possible"), 0).cast("long").alias("score"), "met", "missing_required")
    # Spark keeps the first 50 places of each task before the shuffle.
    return z.withColumn("place", F.rank().over(Window.partitionBy("request_id").orderBy(F.desc("score"))).cast("long")).where("place <= 50")


@R.query(f"with {REQUESTS_SQL} select request_id, req_id, verdict, cast(count(*) as bigint) as n from v group by all")
def verdict_matrix_requests(spark, sf_dir):
    """How often each requirement of every request gets each verdict in its session."""
    return request_counts(spark, sf_dir)


@R.query(f"with {REQUESTS_SQL} select request_id, req_id, cast(count(*) as bigint) as n from v where verdict = 'missing' group by 1, 2 qualify row_number() over (partition by request_id order by n desc, req_id) <= 3")
def gap_counts_requests(spark, sf_dir):
    """The three requirements of every request that most profiles of its session miss."""
    n = request_counts(spark, sf_dir).where("verdict = 'missing'").select("request_id", "req_id", "n")
    return n.withColumn("k", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("n"), "req_id"))).where("k <= 3").drop("k")


@R.query(f"""
with x as (select coalesce(extraction.status = 'OK', false) as a, coalesce(extraction.field_coverage >= 0.6, false) as b from {CURRENT}),
m as (select count(*)::double as n, sum(if(a = b, 1, 0))::double as same, sum(if(a, 1, 0))::double as pa, sum(if(b, 1, 0))::double as pb from x)
select cast(n as bigint) as n, round(same / n, 6) as agreement, round((same / n - (pa * pb + (n - pa) * (n - pb)) / (n * n)) / (1 - (pa * pb + (n - pa) * (n - pb)) / (n * n)), 3) as kappa from m""")
def cohens_kappa(spark, sf_dir):
    """Agreement of two judgements on profiles beyond chance: the status given and a coverage of 0.6."""
    c = current_profiles(spark, sf_dir, {"a": F.coalesce(F.col("extraction.status") == "OK", F.lit(False)), "b": F.coalesce(F.col("extraction.field_coverage") >= 0.6, F.lit(False))})
    m = c.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("a") == F.col("b")).cast("double").alias("same"), F.count_if("a").cast("double").alias("pa"), F.count_if("b").cast("double").alias("pb"))
    chance = "(pa * pb + (n - pa) * (n - pb)) / (n * n)"
    return m.select(F.col("n").cast("long").alias("n"), F.expr("round(same / n, 6)").alias("agreement"), F.expr(f"round((same / n - {chance}) / nullif(1 - {chance}, 0), 3)").alias("kappa"))


@R.query(f"""
with c as (select coalesce(lang, 'none') as lang, coalesce(cast(extraction.ocr_used as varchar), 'none') as ocr, coalesce(extraction.status = 'OK', false) as sel from {CURRENT}),
x as (select 'lang' as axis, lang as label, sel from c union all select 'ocr', ocr, sel from c),
g as (select axis, label, count(*)::double as total, sum(if(sel, 1, 0))::double as selected from x group by all),
r as (select *, selected / total as rate, max(selected / total) over (partition by axis) as best from g)
select axis, label, cast(total as bigint) as total, cast(selected as bigint) as selected, round(rate, 3) as rate, round(case when best = 0 then 1.0 else rate / best end, 3) as ratio, best > 0 and rate / best < 0.8 as adverse from r""")
def group_rates(spark, sf_dir):
    """Share of profiles that pass by label on two axes, against the best label of the axis; a ratio under four fifths is marked, judged before rounding."""
    keep = {"lang": F.coalesce("lang", F.lit("none")), "ocr": F.coalesce(F.col("extraction.ocr_used").cast("string"), F.lit("none")), "sel": F.coalesce(F.col("extraction.status") == "OK", F.lit(False))}
    x = current_profiles(spark, sf_dir, keep).unpivot(["sel"], ["lang", "ocr"], "axis", "label")
    g = x.groupBy("axis", "label").agg(F.count("*").alias("total"), F.count_if("sel").alias("selected"))
    rate = F.col("selected") / F.col("total")
    best = F.max(rate).over(Window.partitionBy("axis"))
    return g.withColumn("_r", rate).withColumn("_b", best).select("axis", "label", "total", "selected", F.round("_r", 3).alias("rate"), F.round(F.when(F.col("_b") == 0, 1.0).otherwise(F.col("_r") / F.col("_b")), 3).alias("ratio"), ((F.col("_b") > 0) & (F.col("_r") / F.nullif("_b", F.lit(0.0)) < 0.8)).alias("adverse"))


@R.query(f"""
with x as (select profile_id, unnest(education).degree as d from {CURRENT}),
r as (select profile_id, greatest({", ".join(f"case when regexp_matches(lower(d), '(^|[^{T.WORD_CLASS}])({p})($|[^{T.WORD_CLASS}])') then {k} end" for _, k, p in T.DEGREES)}) as rank from x)
select profile_id, cast(max(rank) as int) as highest from r where rank is not null group by 1""")
def highest_degree(spark, sf_dir):
    """The highest degree of each profile's education."""
    c = current_profiles(spark, sf_dir, {"d": F.col("education.degree")})
    return c.select("profile_id", F.array_max(F.transform("d", T.degree_rank)).alias("highest")).where("highest is not null")


@R.query(f"""
with p6 as ({P6}), m as (select profile_id, (cast(left(last_month, 4) as int) * 12 + cast(right(last_month, 2) as int)) - (cast(left(first_month, 4) as int) * 12 + cast(right(first_month, 2) as int)) + 1 as n from p6 where kind = 'period')
select profile_id, cast(sum(n) as bigint) as months, round(sum(n) / 12.0, 1) as years, cast(count(*) as bigint) as periods from m group by 1""")
def interval_union_years(spark, sf_dir):
    """Years of employment of each profile, overlaps counted once."""
    n = lambda c: F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    m = p6_found(spark, sf_dir).where("kind = 'period'").select("profile_id", (n("last_month") - n("first_month") + 1).alias("n"))
    return m.groupBy("profile_id").agg(F.sum("n").alias("months"), F.round(F.sum("n") / 12.0, 1).alias("years"), F.count("*").alias("periods"))


@R.query("""
with n as (select request_id, req_id, min_years, try_cast(regexp_extract(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '([0-9]{1,2})\\+? *(?:years|yrs|jahre|Jahre|ans|años|anos|سنوات|سنة|عاما)', 1) as double) as said from requirements where rtype = 'years')
select case when said is null then 'not stated' when said = min_years then 'agrees' else 'differs' end as outcome, cast(count(*) as bigint) as n from n group by 1""")
def threshold_parse(spark, sf_dir):
    """Whether the number of years in a requirement's text is its floor."""
    said = F.expr("try_cast(nullif(s, '') as double)")
    n = table(spark, sf_dir, "requirements").where("rtype = 'years'").select("min_years", F.regexp_extract(ascii_digits(F.col("text")), r"([0-9]{1,2})\+? *(?:years|yrs|jahre|Jahre|ans|años|anos|سنوات|سنة|عاما)", 1).alias("s"))
    return n.groupBy(F.when(said.isNull(), "not stated").when(said == F.col("min_years"), "agrees").otherwise("differs").alias("outcome")).agg(F.count("*").alias("n"))


@R.query("""
with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents where text is not null),
h as (select doc_id, ws, array_to_string(ws, ' ') as t from w),
c as (select t, min(doc_id) as class_id, count(*) as copies, any_value(ws) as ws from h group by t),
s as (select class_id, list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) else [t] end) as s from c where len(ws) > 0),
x as (select class_id, len(s) as n, unnest(s) as g from s),
p as (select a.class_id as i, b.class_id as j, a.n as ni, b.n as nj, count(*) as common from x a join x b on a.g = b.g and a.class_id < b.class_id and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n group by all),
l as (select i, j from p where common >= 0.8 * (ni + nj - common)),
k as (select class_id, count(*) as links from (select i as class_id from l union all select j from l) group by 1)
select h.doc_id, c.class_id, cast(c.copies as bigint) as copies, cast(coalesce(k.links, 0) as bigint) as links from h join c on h.t = c.t left join k on c.class_id = k.class_id""")
def similar_documents(spark, sf_dir):
    """Classes of equal documents and their near-duplicates: five-word shingles, similarity 0.8 or more."""
    return similar_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES, SQL = R.queries, R.sql
