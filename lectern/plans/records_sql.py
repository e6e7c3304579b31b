"""DuckDB SQL for the queries of ``records``."""

from lectern.functions.dates import MONTH_NAMES, NOW_WORDS

_names = ", ".join(f"('{w}', {m})" for m, ws in MONTH_NAMES.items() for w in ws.split(","))
_now = ", ".join("'" + w.replace("'", "''") + "'" for w in NOW_WORDS)

P6 = f"""
with names(name, m) as (values {_names}),
cur as (
  select profile_id, experiences from profiles where profile_id is not null
  qualify row_number() over (partition by profile_id order by revision desc nulls last, ingested_at desc nulls last) = 1),
roles as (select row_number() over () as rid, profile_id, x."start" as a, x."end" as b from (select profile_id, unnest(experiences) as x from cur)),
raw as (select rid, profile_id, false as is_end, a as s from roles union all select rid, profile_id, true, b from roles),
clean as (select rid, profile_id, is_end, lower(trim(regexp_replace(translate(s, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[\\s\\x{{00a0}}]+', ' ', 'g'))) as s from raw),
cut as (
  select *,
    case when regexp_full_match(s, '\\d{{4}}') then s
         when regexp_full_match(s, '\\d{{4}} ?[-/.] ?\\d{{1,2}}( ?[-/.] ?\\d{{1,2}})?') then s[1:4]
         when regexp_full_match(s, '(\\d{{1,2}} ?[-/.] ?)?\\d{{1,2}} ?[-/.] ?\\d{{4}}') then right(s, 4)
         when regexp_full_match(s, '(\\d{{1,2}}\\.? )?(de )?\\p{{L}}+( \\p{{L}}+)?\\.?,?[ /-](de |del )?\\d{{4}}') then right(s, 4)
         when regexp_full_match(s, '\\d{{4}}[ /-]\\p{{L}}+\\.?') then s[1:4] end as y,
    case when regexp_full_match(s, '\\d{{4}}') then if(is_end, '12', '1')
         when regexp_full_match(s, '\\d{{4}} ?[-/.] ?\\d{{1,2}}( ?[-/.] ?\\d{{1,2}})?') then regexp_extract(s, '^\\d{{4}} ?[-/.] ?(\\d{{1,2}})', 1)
         when regexp_full_match(s, '(\\d{{1,2}} ?[-/.] ?)?\\d{{1,2}} ?[-/.] ?\\d{{4}}') then regexp_extract(s, '(\\d{{1,2}}) ?[-/.] ?\\d{{4}}$', 1) end as m,
    case when regexp_full_match(s, '(\\d{{1,2}}\\.? )?(de )?\\p{{L}}+( \\p{{L}}+)?\\.?,?[ /-](de |del )?\\d{{4}}')
           then regexp_extract(s, '^(?:\\d{{1,2}}\\.? )?(?:de )?(\\p{{L}}+(?: \\p{{L}}+)??)\\.?,?[ /-](?:de |del )?\\d{{4}}$', 1)
         when regexp_full_match(s, '\\d{{4}}[ /-]\\p{{L}}+\\.?') then regexp_extract(s, '(\\p{{L}}+)\\.?$', 1) end as word
  from clean),
idx as (
  select rid, profile_id, is_end,
    case when is_end and rtrim(s, '.') in ({_now}) then 2026 * 12 + 5
         when coalesce(try_cast(c.m as int), n.m) between 1 and 12 and cast(c.y as int) between 1900 and 2100 then cast(c.y as int) * 12 + coalesce(try_cast(c.m as int), n.m) - 1 end as i
  from cut c left join names n on c.word = n.name),
spans as (
  select a.profile_id, a.i as s, b.i as e from idx a join idx b on a.rid = b.rid and not a.is_end and b.is_end where b.i >= a.i),
marked as (select *, max(e) over (partition by profile_id order by s, e rows between unbounded preceding and 1 preceding) as reach from spans),
islands as (select *, sum(if(reach is null or s > reach + 1, 1, 0)) over (partition by profile_id order by s, e rows unbounded preceding) as g from marked),
periods as (select profile_id, min(s) as s, max(e) as e from islands group by profile_id, g),
both_kinds as (
  select profile_id, 'period' as kind, s, e from periods
  union all
  select profile_id, 'gap', e + 1, nxt - 1 from (select *, lead(s) over (partition by profile_id order by s) as nxt from periods) where nxt is not null)
select profile_id, kind, lpad(cast(s // 12 as varchar), 4, '0') || '-' || lpad(cast(s % 12 + 1 as varchar), 2, '0') as first_month,
  lpad(cast(e // 12 as varchar), 4, '0') || '-' || lpad(cast(e % 12 + 1 as varchar), 2, '0') as last_month
from both_kinds
"""



def _filled(x: str) -> str:
    """SQL: a JSON value is neither null nor blank."""
    return f"coalesce(json_type({x}) <> 'NULL' and case when json_type({x}) = 'VARCHAR' then trim({x} ->> '$') <> '' when json_type({x}) = 'ARRAY' then len(list_filter(json_extract_string({x}, '$[*]'), lambda q: trim(coalesce(q, '')) <> '')) > 0 when json_type({x}) = 'OBJECT' then len(list_filter(json_extract_string({x}, '$.*'), lambda q: trim(coalesce(q, '')) <> '')) > 0 else true end, false)"


def _first(holder: str, *keys: str) -> str:
    """SQL: the first of several keys that holds something."""
    return "coalesce(" + ", ".join(f"case when json_type({holder}, '$.{k}') <> 'NULL' then json_extract({holder}, '$.{k}') end" for k in keys) + ")"


def _fields(item: str, *keys: str) -> str:
    plain = f"json_type({item}) <> 'OBJECT' and {_filled(item)}"
    return f"({plain} or json_type({item}) = 'OBJECT' and (" + " or ".join(_filled(f"json_extract({item}, '$.{k}')") for k in keys) + "))"


def _tagged() -> str:
    """SQL over records (origin, id, j): every present item. j has small letters only, so that key names ignore case."""
    listed = "select origin, id, {path} as path, 0 as parent_pos, unnest(case when json_type(v) = 'ARRAY' then json_extract(v, '$[*]') when json_type(v) <> 'NULL' then [v] end) as item, unnest(case when json_type(v) = 'ARRAY' then range(1, json_array_length(v)::bigint + 1) when json_type(v) <> 'NULL' then [1] end) as pos from (select origin, id, {value} as v from {rel})"
    top = {
        "experiences": (_first("j", "experiences", "experience", "work_experience"), "records", ("title", "organization", "company", "start", "end")),
        "education": (_first("j", "education", "educations"), "records", ("degree", "field", "institution", "year")),
        "skills": (_first("j", "skills"), "records", ("name", "source")),
        "identity.full_name": (_first("i", "full_name", "name"), "identities", ("value",)),
        "identity.emails": (_first("i", "emails", "email"), "identities", ("value",)),
        "identity.phones": (_first("i", "phones", "phone"), "identities", ("value",)),
        "identity.links": (_first("i", "links"), "identities", ("value",)),
    }
    out, ctes = [], []
    for k, (path, (value, rel, keys)) in enumerate(top.items()):
        ctes.append(f"t{k} as (select * from ({listed.format(path=repr(path), value=value, rel=rel)}) where json_type(item) <> 'NULL' and {_fields('item', *keys)})")
        out.append(f"select origin, id, path, parent_pos, pos from t{k}")
        if path in ("experiences", "education", "skills", "identity.full_name"):
            e = "json_extract(item, '$.evidence')"
            out.append(f"select origin, id, path || '.evidence', pos, 1 from t{k} where json_type(item) = 'OBJECT' and json_type({e}) <> 'NULL' and {_fields(e, 'page', 'quote')}")
        if path == "experiences":
            p = "json_extract(item, '$.projects')"
            ctes.append(f"pr as (select origin, id, pos as parent_pos, unnest(case when json_type({p}) = 'ARRAY' then json_extract({p}, '$[*]') when json_type({p}) <> 'NULL' then [{p}] end) as item, unnest(case when json_type({p}) = 'ARRAY' then range(1, json_array_length({p})::bigint + 1) when json_type({p}) <> 'NULL' then [1] end) as pos from t{k} where json_type(item) = 'OBJECT' and origin = 'reply')")
            out.append(f"select origin, id, 'experiences.projects', parent_pos, pos from pr where json_type(item) <> 'NULL' and {_fields('item', 'name', 'role', 'tools')}")
    return ", ".join(ctes) + " select distinct origin, id as record_id, path, cast(parent_pos as int) as parent_pos, cast(pos as int) as pos from (" + " union all ".join(out) + ")"


_wrap = lambda j: f"case when json_type({j}, '$.result') = 'OBJECT' then json_extract({j}, '$.result') when json_type({j}, '$.candidate') = 'OBJECT' then json_extract({j}, '$.candidate') else {j} end"
P3 = f"""
with cur as (select profile_id, identity, experiences, education, skills from profiles where profile_id is not null
  qualify row_number() over (partition by profile_id order by revision desc nulls last, ingested_at desc nulls last) = 1),
raw as (select distinct reply_id, lower(regexp_replace(trim(payload), '^```[A-Za-z]*\\s*|\\s*```$', '', 'g')) as t from model_replies where payload is not null),
valid as (select reply_id, case when json_valid(t) then t::json end as j from raw),
un1 as (select reply_id, {_wrap('j')} as j from valid where json_type(j) = 'OBJECT'),
un2 as (select reply_id, {_wrap('j')} as j from un1),
records as (select 'reply' as origin, reply_id as id, j from un2
  union all select 'profile', profile_id, to_json({{'identity': identity, 'experiences': experiences, 'education': education, 'skills': skills}}) from cur),
identities as (select origin, id, json_extract(j, '$.identity') as i from records where json_type(j, '$.identity') = 'OBJECT'),
{_tagged()}
"""

_NOT_BLANK = lambda *cs: " or ".join(f"trim(coalesce(x.{c}, '')) <> ''" for c in cs)
_ITEMS = [("experiences", "title", ("title", "organization", '"start"', '"end"')), ("education", "degree", ("degree", "field", "institution", '"year"')), ("skills", "name", ("name", "source"))]
P3_EVIDENCE = "with cur as (select profile_id, experiences, education, skills from profiles where profile_id is not null qualify row_number() over (partition by profile_id order by revision desc nulls last, ingested_at desc nulls last) = 1) " + " union all ".join(
    f"select record_id, '{t}' as path, cast(pos as int) as pos, x.{n} as item, x.evidence.page as page, x.evidence.quote as quote from (select profile_id as record_id, unnest({t}) as x, generate_subscripts({t}, 1) as pos from cur) where ({_NOT_BLANK(*cs)}) and (x.evidence.page is not null or trim(coalesce(x.evidence.quote, '')) <> '')"
    for t, n, cs in _ITEMS
)

SQL = {"p3_found": P3, "p3_evidence": P3_EVIDENCE, "p6_found": P6}
