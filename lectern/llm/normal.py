"""Text that looks alike brought to one form: DuckDB over Arrow partitions.

Each Arrow batch is registered with a DuckDB connection of its task and rewritten by one SQL statement: invisible characters go (regular
expression), compatibility forms and odd spaces are mapped (translate; ligatures by a map), combining marks are composed (nfc_normalize), and
look-alike letters are replaced word by word, only in words that mix scripts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.chars import ARABIC_LOOKALIKES, LATIN_LOOKALIKES, PERSIAN_ONLY, PERSIAN_WORDS, SPACES, char_class, tables
from lectern.sources.tables import latest

#: What was changed in a line: a letter or digit in another form, a ligature, a combining mark, an invisible character, a space, a look-alike.
KINDS = ["styled", "combining", "invisible", "space", "lookalike"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql(by_line: bool, only_changed: bool) -> str:
    t = tables()
    one = {k: v for k, v in {**t["styled"], **t["marks"]}.items() if len(v) == 1}
    many = {k: v for k, v in t["styled"].items() if len(v) > 1}
    styled, invisible, space = char_class(t["styled"]), char_class(t["invisible"]), char_class(SPACES)
    fold = f"translate(c0, {_q(''.join(one) + SPACES)}, {_q(''.join(one.values()) + ' ' * len(SPACES))})"
    latin, arabic = char_class(LATIN_LOOKALIKES), char_class(ARABIC_LOOKALIKES)
    other = r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]"
    mixed = f"regexp_matches(w, '\\p{{Latin}}') and regexp_matches(w, '{other}')"
    whole = f"regexp_full_match(w, '{latin}+') and (length(w) = 1 or length(w) = 2 and regexp_matches(c3, '\\p{{Latin}}'))"
    persian = f"regexp_matches(w, '{arabic}') and not regexp_matches(w, '{char_class(PERSIAN_ONLY)}') and w not in ({', '.join(map(_q, PERSIAN_WORDS))})"
    fixed = (
        "array_to_string(list_transform(regexp_extract_all(c3, '[\\p{L}\\p{M}\\p{N}]+|[^\\p{L}\\p{M}\\p{N}]+'), lambda w: "
        f"case when {mixed} or {whole} then translate(w, {_q(''.join(LATIN_LOOKALIKES))}, {_q(''.join(LATIN_LOOKALIKES.values()))}) "
        f"when {persian} then translate(w, {_q(''.join(ARABIC_LOOKALIKES))}, {_q(''.join(ARABIC_LOOKALIKES.values()))}) else w end), '')"
    )
    # One class of all characters that any later step could change: most lines have none and pass through.
    odd = _q(char_class({**t["styled"], **t["marks"]})[:-1] + invisible[1:-1] + space[1:-1] + arabic[1:-1] + r"\p{M}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]")
    texts = f"(select id, t from batch{f' where regexp_matches(t, {odd})' if only_changed else ''})"
    source = f"(select id, unnest(string_split(t, chr(10))) as t, generate_subscripts(string_split(t, chr(10)), 1) as line_no from {texts})" if by_line else f"(select id, t, 0 as line_no from {texts})"
    return f"""
    with l as (select id, line_no, t, regexp_matches(t, {odd}) as odd from {source} {'where odd' if only_changed else ''}),
    a as (select id, line_no, t, odd, if(odd, regexp_replace(t, {_q(invisible)}, '', 'g'), t) as c0 from l),
    b as (select *, if(odd, {fold}, c0) as c1 from a),
    c as (select *, if(odd and regexp_matches(c1, {_q(char_class(many))}),
            array_to_string(list_transform(string_split(c1, ''), lambda x: coalesce(many[x], x)), ''), c1) as c2 from b, (select map([{', '.join(map(_q, many))}], [{', '.join(map(_q, many.values()))}]) as many)),
    d as (select *, if(odd, nfc_normalize(c2), c2) as c3 from c),
    e as (select *, if(odd and regexp_matches(c3, '{other}|{arabic}'), {fixed}, c3) as c4 from d)
    select id, line_no::int as line_no, c4 as canonical,
      odd and regexp_matches(t, {_q(styled)}) as styled, odd and length(c3) < length(c2) as combining,
      odd and regexp_matches(t, {_q(invisible)}) as invisible, odd and regexp_matches(t, {_q(space)}) as space, odd and c4 <> c3 as lookalike
    from e"""


def canonical_text(df: DataFrame, id_col: str, text_col: str, *, by_line: bool = False, only_changed: bool = False) -> DataFrame:
    """(id, line_no, canonical, styled, combining, invisible, space, lookalike) of every text, or with by_line of every line.

    No shuffle: a batch is rewritten where it is read. line_no counts from 1 and is 0 without by_line. only_changed keeps rows of which
    at least one flag is set. Whole texts of any length are read. A null text gives no row, an empty text one row with an empty form; repeated
    rows give repeated results; an empty table an empty result; other columns aren't read, whatever their names.
    """
    sql = _sql(by_line, only_changed) + (" where styled or combining or invisible or space or lookalike" if only_changed else "")
    kind = df.select(id_col).schema[0].dataType.simpleString()
    ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema([("id", ids), ("line_no", pa.int32()), ("canonical", pa.string()), *((k, pa.bool_()) for k in KINDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                con.register("batch", pa.Table.from_batches([whole.slice(at, 2000)]))
                got = con.sql(sql).to_arrow_table().cast(out)
                con.unregister("batch")
                yield from got.to_batches()

    shape = f"id {kind}, line_no int, canonical string, " + ", ".join(f"{k} boolean" for k in KINDS)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").mapInArrow(run, shape)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages and job descriptions that hold text built from other characters."""
    pages, jobs = spark.read.parquet(f"{sf_dir}/cv_pages.parquet"), spark.read.parquet(f"{sf_dir}/score_requests.parquet")
    one = lambda df, i, t, o: canonical_text(df, i, t, by_line=True, only_changed=True).select(F.lit(o).alias("origin"), F.col("id").alias("item_id"), "line_no")
    return one(pages, "page_id", "text", "page").unionByName(one(jobs, "request_id", "jd_text", "jd")).distinct()


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page text and job description in its one form, with what was changed; re-delivered pages and requests once."""
    pages = spark.read.parquet(f"{sf_dir}/cv_pages.parquet").select("page_id", "text").dropDuplicates(["page_id"])
    jobs = latest(spark.read.parquet(f"{sf_dir}/score_requests.parquet"), "request_id", ["ingested_at"], {"text": F.col("jd_text")})
    one = lambda df, i, o: canonical_text(df, i, "text").select(F.lit(o).alias("origin"), F.col("id").alias("item_id"), "canonical", *KINDS)
    return one(pages, "page_id", "page").unionByName(one(jobs, "request_id", "jd"))


QUERIES = {"p5_found": p5_found, "p5_canonical": p5_canonical}
_LINES = """
select distinct 'page' as origin, page_id as item_id, text as t from cv_pages where text is not null
union select distinct 'jd', request_id, jd_text from score_requests where jd_text is not null"""
_WORDS = "regexp_extract_all(plain, '[\\p{L}\\p{M}\\p{N}]+')"
# Blocks of the Unicode charts, not the tables of the operator: full and half width, mathematical, letter-like, enclosed and small letters, ligatures, Arabic presentation forms.
_BLOCKS = "[\\x{ff10}-\\x{ff19}\\x{ff21}-\\x{ff3a}\\x{ff41}-\\x{ff5a}\\x{ff66}-\\x{ffdc}\\x{1d400}-\\x{1d7ff}\\x{2102}-\\x{2113}\\x{2115}\\x{2119}-\\x{211d}\\x{2124}-\\x{2139}\\x{2145}-\\x{2149}\\x{2460}-\\x{24ff}\\x{1f110}-\\x{1f149}\\x{fb00}-\\x{fb06}\\x{fb50}-\\x{fbff}\\x{fc00}-\\x{fd3d}\\x{fd50}-\\x{fdfb}\\x{fe70}-\\x{fefc}]"
SQL = {
    "p5_found": f"""
with texts as ({_LINES}),
lines as (select origin, item_id, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as line_no from texts),
seen as (select *, nfc_normalize(regexp_replace(l, '\\p{{Cf}}', '', 'g')) as plain from lines)
select distinct origin, item_id, cast(line_no as int) as line_no from seen
where regexp_matches(l, '\\p{{Cf}}') or regexp_matches(replace(l, ' ', ''), '\\p{{Zs}}')
  or length(nfc_normalize(l)) < length(l)
  or regexp_matches(l, '{_BLOCKS}')
  or len(list_filter({_WORDS}, lambda w: regexp_matches(w, '\\p{{Latin}}') and regexp_matches(w, '[\\p{{Greek}}\\p{{Cyrillic}}]')
       or regexp_matches(w, '[کی]') and not regexp_matches(w, '[پچژگ]') and w not in ('فارسی', 'کردی', 'کوردی', 'دری', 'اردو'))) > 0
""",
}
