"""Questions over a session's profiles: an utterance becomes an intent, an intent a plan over the profile table; the view of a session is an immutable value that holds its sets as frames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.jobs import bag, bag_cosine
from lectern.sources.shared import stored

# Words of each intent, in the order in which they are tried.
INTENTS = [
    ("reset", r"\b(reset|start over|start again|show all|clear (?:the )?filters?|everyone|everybody)\b"), ("count", r"\b(how many|count|number of|total of)\b"), ("compare", r"\b(compare|comparison|versus|vs\.?|side by side|difference between)\b"),
    ("match", r"\b(job description|jd|fit for|fits|suitable for|match(?:es)? (?:for|with|this))\b"), ("exclude", r"\b(exclude|remove|drop|without|leave out|except)\b"), ("years", r"\b(years?|yrs)\b"),
    ("shortlist", r"\b(short-?list|short list|top candidates)\b"), ("rank", r"\b(rank(?:ing)?|best|top|strongest|order by)\b"), ("who_has", r"\b(who has|who have|who knows?|with experience in|experienced in|skilled in|familiar with|knows|has)\b"),
]
# Words of ordinal numbers.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
_NUMBER = re.compile(r"(?:(more than|over|above|at least|≥|>=|min(?:imum)?(?: of)?)|(less than|fewer than|under|below|<))?\s*(\d{1,2})\s*(\+)?\s*(?:years?|yrs)")
_TOP = re.compile(r"(?:^|\W)(?:top|best|first)\s+(?P<n>\d+)(?=\W|$)")
_LISTED = re.compile(r"(?:candidates?|compare|cand\.?|#|\bno\.?|number|\bc_)\s*#?\s*0*(\d{1,4})")
_AND = re.compile(r"(?:\band\b|&|,|\bvs\.?|\bversus)\s*(?:candidate\s*)?#?\s*0*(\d{1,4})\b(?!\s*\+?\s*(?:years?|yrs))")
#: Least likeness of words at which a skill stands for another, and the share that a profile to be looked at keeps of its score.
LIKE, REVIEW = 0.62, 0.85


@dataclass(frozen=True)
class Intent:
    """What an utterance asks for. before: it points at the last answer (them, those); shortlist: at the last short list; names: words that may be names."""

    kind: str
    terms: tuple[str, ...] = ()
    years: float | None = None
    below: bool = False
    top: int | None = None
    refs: tuple[int, ...] = ()
    before: bool = False
    shortlist: bool = False
    text: str = ""


@dataclass(frozen=True)
class Criteria:
    """What a job asks for: skills that a candidate must have, years, and words of the role."""

    must: tuple[str, ...] = ()
    min_years: float | None = None
    role: str = ""


@dataclass(frozen=True)
class View:
    """What a session looks at: the working set (none: all), the last answer and the last short list as frames of profile_id, the job asked about, and what was asked."""

    current: DataFrame | None = None
    last: DataFrame | None = None
    shortlist: DataFrame | None = None
    job: Criteria | None = None
    history: tuple[str, ...] = field(default=())


def parse(text: str) -> Intent:
    """The intent of an utterance; the first that fits, rank if none does. "more than 5 years" includes 5."""
    low = text.lower().strip()
    kind = next((k for k, p in INTENTS if re.search(p, low)), "rank")
    m, top = _NUMBER.search(low), _TOP.search(low)
    refs = [int(x) for x in _LISTED.findall(low)] + [int(x) for x in _AND.findall(low)]
    refs += [k for k, w in enumerate(ORDINALS, 1) if re.search(rf"\b{w}\b(?!\s+\d)", low)]
    after = re.search(r"(?:who has|who have|who knows?|knows|has|with experience in|experienced in|skilled in|familiar with)\s+(.+?)[?.!]*$", low)
    terms = tuple(t.strip() for t in re.split(r",| and | or ", after.group(1)) if t.strip() and not _NUMBER.search(t))[:6] if after else ()
    return Intent(
        kind, terms, float(m.group(3)) if m else None, bool(m and m.group(2)), int(top["n"]) if top else None, tuple(dict.fromkeys(refs)),
        bool(re.search(r"\b(those|them|these|that group|the same)\b", low)), bool(re.search(r"\b(?:the|last|previous|my) short-? ?list\b", low)), low,
    )


def like(names: Column, term: str) -> Column:
    """Skills of an array that are meant by a term: either contains the other, case aside, or failing that the one whose words are most alike, from LIKE on."""
    low = term.lower()
    literal = F.filter(names, lambda n: F.lower(n).contains(low) | F.lit(low).contains(F.lower(n)))
    scored = F.filter(F.transform(names, lambda n: F.struct(bag_cosine(bag(n), bag(F.lit(low))).alias("s"), n.alias("n"))), lambda x: x["s"] >= LIKE)
    near = F.slice(F.transform(F.reverse(F.array_sort(scored)), lambda x: x["n"]), 1, 1)
    return F.when(F.size(literal) > 0, literal).otherwise(near)


def fit(profiles: DataFrame, job: Criteria) -> DataFrame:
    """The profiles with coverage, semantic and score: half for the required skills covered, a quarter each for years and likeness of words; without required skills 0.6 and 0.4."""
    names = F.coalesce(F.filter("skills", lambda s: s.isNotNull()), F.array().cast("array<string>"))
    hits = [F.size(like(names, m)) > 0 for m in job.must]
    cover = sum((h.cast("int") for h in hits), F.lit(0)) / len(hits) if hits else F.lit(None).cast("double")
    years = F.least(F.lit(1.0), F.coalesce("years", F.lit(0.0)) / (job.min_years or 10.0))
    words = F.concat_ws(" ", F.array_join(names, " "), *[c for c in ("headline", "summary") if c in profiles.columns])
    sem = bag_cosine(bag(words), bag(F.lit(job.role or " ".join(job.must))))
    base = 0.5 * cover + 0.25 * years + 0.25 * sem if hits else 0.6 * sem + 0.4 * years
    return profiles.withColumns({"coverage": cover, "semantic": F.round(sem, 3), "score": F.round(base * F.when(F.coalesce("weak", F.lit(False)), REVIEW).otherwise(1.0), 4)})


def referred(profiles: DataFrame, intent: Intent, view: View) -> DataFrame | None:
    """profile_id of those that an utterance points at: by number or ordinal, by full or first name, by "them" or "the short list"; None if it points at nobody in particular."""
    found: list[DataFrame] = []
    if intent.refs:
        found.append(profiles.where(F.col("display_no").isin(*intent.refs)).select("profile_id"))
    if "name" in profiles.columns and intent.text:
        name, said = F.lower(F.trim("name")), F.lit(intent.text)
        first = F.substring_index(name, " ", 1)
        words = F.array(*map(F.lit, dict.fromkeys(re.findall(r"[^\W\d_]+", intent.text)))).cast("array<string>")
        named = profiles.where((name != "") & (said.contains(name) | (F.length(first) >= 3) & F.array_contains(words, first))).select("profile_id")
        found.append(named)
    if intent.before and view.last is not None:
        found.append(view.last)
    if intent.shortlist and view.shortlist is not None:
        found.append(view.shortlist)
    if not found:
        return None
    ids = found[0]
    for f in found[1:]:
        ids = ids.unionByName(f)
    ids = ids.distinct()
    return ids if intent.refs or not ids.isEmpty() else None


def plan(profiles: DataFrame, intent: Intent, view: View | None = None) -> DataFrame:
    """The profiles (profile_id, display_no, years, skills array<string>, weak boolean; optional: name, headline, summary) that answer, in order, from the working set."""
    view = view or View()
    df = profiles.join(view.current, "profile_id", "left_semi") if view.current is not None else profiles
    years = F.coalesce("years", F.lit(0.0))
    roster = ["display_no", "profile_id"]
    order = [F.desc_nulls_last("years"), *map(F.asc, roster)]
    if intent.kind == "reset":
        return profiles.orderBy(*roster)
    if intent.kind == "count":
        return df.agg(F.count("*").alias("n"), F.count_if("weak").alias("weak"))
    if intent.kind == "years" and intent.years is not None:
        return df.where(years < intent.years if intent.below else years >= intent.years).orderBy(*order)
    ids = referred(profiles, intent, view)
    if intent.kind == "exclude":
        if ids is not None:
            return df.join(ids, "profile_id", "left_anti").orderBy(*roster)
        return df.where(years >= intent.years if intent.years is not None else ~F.coalesce("weak", F.lit(False))).orderBy(*roster)
    if intent.kind == "compare" and ids is not None:
        return df.join(ids, "profile_id", "left_semi").orderBy(*roster).limit(2)
    if intent.kind == "who_has" and intent.terms:
        any_hit = F.lit(False)
        for t in intent.terms:
            any_hit = any_hit | (F.size(like(F.coalesce("skills", F.array().cast("array<string>")), t)) > 0)
        return df.where(any_hit).orderBy(*roster)
    if ids is not None and (intent.before or intent.shortlist):
        df = df.join(ids, "profile_id", "left_semi")
    most = intent.top or (3 if intent.kind == "shortlist" else 10)
    if view.job is not None:
        return fit(df, view.job).orderBy(F.desc("score"), *roster).limit(most)  # equal scores keep the order of the roster
    return df.orderBy(F.coalesce("weak", F.lit(False)), *order).limit(most)


def answer(profiles: DataFrame, text: str, view: View | None = None, job: Criteria | None = None) -> tuple[DataFrame, View]:
    """The answer to an utterance, and the view after it. A filter that finds nobody leaves the next turn with everybody; who-has without a hit leaves the working set as it was.

    job: what a job description asks for, if one came with the utterance; it stays for the turns after. The ids of an answer are written to the shared folder, never brought to the driver.
    """
    view = view or View()
    intent = parse(text)
    view = replace(view, history=(*view.history, text), job=job or view.job)
    found = plan(profiles, intent, view)
    if intent.kind == "reset":
        return found, replace(view, current=None, last=None, shortlist=None, job=None)
    if intent.kind == "count":
        return found, view
    ids = stored(found.select("profile_id"))
    some = not ids.isEmpty()
    if intent.kind in ("years", "exclude") or intent.kind == "who_has" and some:
        view = replace(view, current=ids if some else None)
    return found, replace(view, last=ids, shortlist=ids if intent.kind == "shortlist" else view.shortlist)
