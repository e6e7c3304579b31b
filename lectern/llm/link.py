"""Profiles of one person under different spellings of the name.

1. Every profile is sent to the places where its evidence stands: contacts that belong to no crowd, dated roles.
2. There a prefix-filtered set-similarity join on the q-grams of name tokens finds the names that may be spellings of one. Where few names meet they are compared each with each; where many do,
   tokens that are alike without common q-grams (initials, swapped letters, short words) are found by keys that all alike tokens share.
3. Each pair is verified by soft weighted token similarity, in which rare tokens count more, and by what contacts and careers say together.
"""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations, groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.dates import parse_month
from lectern.llm.names import _first_sound, alike, nicknames, parse, similarity, skeleton
from lectern.sources.shared import small, stored
from lectern.sources.tables import current_profiles

#: Least Jaccard similarity of the q-grams of two tokens that may be spellings of one, and the length of the grams. One edit in four letters and two in six stay above it.
TOKEN_SIMILARITY, Q = 0.25, 2
#: Least soft similarity of two names, and the least where contacts and career agree both.
NAME_SIMILARITY, NAME_FLOOR = 0.8, 0.4
#: A contact with more families than this on it belongs to no person and is no evidence; spellings of a family name count once.
SHARED_BY = 4
#: Names of one piece of evidence up to which each is compared with each. Letters of a token from which only tokens of about its length are compared with it, instead of by what letters left out leave.
FEW_NAMES, LONG_TOKEN = 12, 16
#: Profiles of one piece of evidence that meet in one task, and places of the table of gram frequencies.
BLOCK, GRAM_PLACES = 2_000, 1 << 16
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
_ROLE = "struct<org:string,s:int,sm:boolean,e:int,em:boolean>"
_PERSON = f"id bigint, tokens array<string>, contacts array<string>, roles array<{_ROLE}>, edu array<string>"


def grams(form: str) -> frozenset[str]:
    """Distinct q-grams of a padded token; those of consonants (~) are told from those of letters, a class of short forms (#) is one gram."""
    if form[0] == "#":
        return frozenset((form,))
    mark, w = ("~", form[1:]) if form[0] == "~" else ("", form)
    w = f"^{w}$"
    return frozenset(mark + w[i : i + Q] for i in range(len(w) - Q + 1))


def forms_of(token: str) -> list[str]:
    """What a token is compared as: itself, its consonants (the same in either script), its classes of short forms. An initial is compared as nothing."""
    if len(token) < 2:
        return []
    bone = skeleton(token)
    return [token, *([f"~{bone}"] if len(bone) > 1 else []), *sorted(f"#{k}" for k in nicknames(token))]


def _contacts(emails: list | None, phones: list | None, links: list | None) -> list[str]:
    out = []
    for x in emails or []:
        x = re.sub(r"\s*[\[(]\s*at\s*[\])]\s*", "@", (x or "").strip().lower())
        x = re.sub(r"\s*[\[(]\s*dot\s*[\])]\s*", ".", x).replace(" ", "").removeprefix("<mailto:").removeprefix("mailto:").strip("<>.")
        if "@" in x:
            out.append("e" + x)
    for x in phones or []:
        digits = re.sub(r"\D", "", re.split(r"(?i)\s*(?:ext|x|durchwahl)\b", (x or "").translate(_DIGITS))[0])
        if len(digits) >= 7:
            out.append("p" + digits[-9:])
    out += ["l" + x.strip().lower().rstrip("/") for x in links or [] if x and x.strip()]
    return sorted(set(out))


def people(df: DataFrame) -> DataFrame:
    """Persons as they are compared: tokens of the name, contact keys, dated roles, schools; from (id, name, emails, phones, links, roles, edu). Rows without a name drop out."""
    out = pa.schema([
        ("id", pa.int64()), ("tokens", pa.list_(pa.string())), ("contacts", pa.list_(pa.string())),
        ("roles", pa.list_(pa.struct([("org", pa.string()), ("s", pa.int32()), ("sm", pa.bool_()), ("e", pa.int32()), ("em", pa.bool_())]))), ("edu", pa.list_(pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("id", "name", "emails", "phones", "links", "roles", "edu")]
            rows = []
            for i, name, emails, phones, links, roles, edu in zip(*cols, strict=True):
                tokens = parse(name)
                if not tokens:
                    continue
                own = [{**r, "org": " ".join(re.findall(r"[^\W_]+", (r["org"] or "").lower()))} for r in roles or [] if r and r["s"] is not None]
                schools = sorted({f"{' '.join(re.findall(r'[^\W_]+', (x['inst'] or '').lower()))}|{(x['year'] or '').translate(_DIGITS).strip()}" for x in edu or [] if x and (x["inst"] or x["year"])} - {"|"})
                rows.append((i, tokens, _contacts(emails, phones, links), own, schools))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, out, strict=True)], schema=out)

    return df.where("id is not null and trim(name) <> ''").mapInArrow(run, _PERSON)


def token_stats(persons: DataFrame) -> DataFrame:
    """(token, n, family) of the distinct tokens of more than one letter: their uses, and whether they stand last at least as often as not."""
    places = persons.select(F.posexplode("tokens").alias("k", "token"), F.size("tokens").alias("of")).where("length(token) > 1")
    stats = places.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("k") == F.col("of") - 1).alias("last"))
    return stats.select("token", "n", (F.col("last") * 2 >= F.col("n")).alias("family"))


def gram_counts(stats: DataFrame) -> list[int]:
    """How many forms of distinct tokens have each gram, by a place among GRAM_PLACES; the order of the prefix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * GRAM_PLACES
        for b in batches:
            for t in b.column(0).to_pylist():
                for f in forms_of(t):
                    for g in grams(f):
                        n[crc32(g.encode()) % GRAM_PLACES] += 1
        some = [(k, x) for k, x in enumerate(n) if x]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.int64())], names=["k", "n"])

    out = [0] * GRAM_PLACES
    for r in stats.select("token").mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most GRAM_PLACES rows
        out[r.k] = r.n
    return out


def weighed(persons: DataFrame, stats: DataFrame, people_count: int) -> DataFrame:
    """(id, tokens, w, fam): the weight of each token by its place (rare ones more, initials little) and the family name: the last token that stands last in most names."""
    each = persons.select("id", F.posexplode("tokens").alias("k", "token")).join(stats, "token", "left")
    w = F.when(F.col("n").isNull(), F.lit(0.3)).otherwise(F.log(F.lit(people_count + 1.0) / F.col("n")))
    last = F.struct(F.coalesce("family", F.lit(False)).alias("family"), F.col("k"), F.col("token"))
    own = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "token", w.alias("w")))).alias("t"), F.max(F.when(F.col("n").isNotNull(), last)).alias("f"), F.count("n").alias("spelled"))  # at most a name's tokens
    fam = F.when(F.col("f.family") | (F.col("spelled") > 1), F.col("f.token"))
    return own.select("id", F.col("t.token").alias("tokens"), F.col("t.w").alias("w"), fam.alias("fam"))


def contact_uses(persons: DataFrame, names: DataFrame) -> DataFrame:
    """(key, f, g): how many families stand on each contact, up to one more than SHARED_BY, and how many first letters of given names; tells a household and an agency from a person.

    The distinct family names of a contact pass by once, the frequent ones first; a name that is a spelling of one seen before counts with it.
    """
    use = persons.select("id", F.explode("contacts").alias("key"), F.substring(F.element_at("tokens", 1), 1, 1).alias("g")).join(names.select("id", "fam"), "id")
    each = use.groupBy("key", "fam").agg(F.count("*").alias("n"), F.collect_set("g").alias("g"))  # at most the letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        out = []
        for key, group in groupby(rows, key=lambda r: r[0]):
            leaders, letters = [], set()
            for _, fam, g in group:
                letters.update(g)
                if fam and len(leaders) <= SHARED_BY and not any(alike(fam, x) > 0.5 for x in leaders):
                    leaders.append(fam)
            out.append((key, len(leaders), len(letters)))
            if len(out) == 10_000:
                yield _batch(out, _USES)
                out = []
        yield _batch(out, _USES)

    return each.repartition("key").sortWithinPartitions("key", F.desc("n"), "fam").select("key", "fam", "g").mapInArrow(run, "key string, f int, g int")


_USES = pa.schema([("key", pa.string()), ("f", pa.int32()), ("g", pa.int32())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _year(m: Column) -> Column:
    return F.floor(m / 12).cast("int")


def evidence(persons: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, h): what a profile can share with another of the same person, hashed: a contact that no crowd has, a role at an employer by its years, a role by its months.

    A contact that a crowd has is none by itself; it counts together with a piece of a career, for which a role without an end and a school are enough.
    """
    known = persons.select("id", F.explode("contacts").alias("key")).join(uses.select("key", (F.col("f") > SHARED_BY).alias("crowd")), "key")
    r = F.col("r")
    at = F.when((r["org"] != "") & r["e"].isNotNull(), F.concat_ws("|", F.lit("o"), r["org"], _year(r["s"]), _year(r["e"])))
    exact = F.when(r["sm"] & r["em"], F.concat_ws("|", F.lit("d"), r["s"], r["e"]))
    since = F.when(r["org"] != "", F.concat_ws("|", F.lit("s"), r["org"], _year(r["s"])))
    each = persons.select("id", F.explode("roles").alias("r"))
    roles = each.select("id", F.explode(F.array_compact(F.array(at, exact))).alias("key"))
    pieces = each.select("id", F.explode(F.array_compact(F.array(exact, since))).alias("piece")).unionByName(persons.select("id", F.explode("edu").alias("piece")))
    beside = known.where("crowd").join(pieces, "id").select("id", F.xxhash64("key", "piece").alias("h"))
    return known.where("not crowd").select("id", "key").unionByName(roles).select("id", F.xxhash64("key").alias("h")).unionByName(beside).distinct()


class NameJoin:
    """The set-similarity join of names on token q-grams: an index of the rarest grams of all tokens, asked with those of each name's heaviest tokens."""

    def __init__(self, counts: Sequence[int]) -> None:
        self.counts = counts
        self._of = lru_cache(200_000)(lambda token: [self._prefix(f) for f in forms_of(token)])

    def _prefix(self, form: str) -> tuple[frozenset[str], tuple[str, ...]]:
        """Grams of a form, and of them the rarest size - ceil(t * size) + 1: two forms that are so similar share one of those."""
        g = grams(form)
        o = sorted(g, key=lambda x: (self.counts[crc32(x.encode()) % GRAM_PLACES], x))
        return g, tuple(o[: len(g) - math.ceil(TOKEN_SIMILARITY * len(g)) + 1])

    def pairs(self, names: list[tuple[tuple[str, ...], tuple[float, ...]]]) -> Iterator[tuple[int, int]]:
        """(i, j), i < j, of the distinct names (tokens, weights) with a token in common or alike and a soft similarity of NAME_FLOOR or more.

        The matched weight of the shorter name has to be NAME_FLOOR of its whole, so one of its heaviest tokens, of which the others are less than that, is matched: these ask.
        """
        index: dict[str, list[tuple[int, frozenset[str]]]] = {}
        own = []
        for i, (tokens, _) in enumerate(names):
            forms = [self._of(t) for t in tokens]
            own.append(forms)
            for g, first in (x for fs in forms for x in fs):
                for p in first:
                    index.setdefault(p, []).append((i, g))
        seen = set()
        for i, (tokens, weights) in enumerate(names):
            heavy = sorted(range(len(tokens)), key=lambda k: -weights[k])
            rest, least = sum(weights), NAME_FLOOR * sum(weights)
            for k in heavy:
                if rest < least:
                    break
                rest -= weights[k]
                for g, first in own[i][k]:
                    for p in first:
                        for j, other in index[p]:
                            if j == i or (pair := (i, j) if i < j else (j, i)) in seen:
                                continue
                            both = len(g & other)
                            if both >= TOKEN_SIMILARITY * (len(g) + len(other) - both):
                                seen.add(pair)
                                w = dict(zip(tokens, weights, strict=True)) | dict(zip(*names[j], strict=True))
                                if similarity(list(tokens), list(names[j][0]), w.__getitem__) >= NAME_FLOOR:
                                    yield pair


def _left_out(w: str, most: int) -> set[str]:
    """What is left of a word by leaving out up to ``most`` letters: words so many edits apart have one of these in common."""
    out = last = {w}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


@lru_cache(50_000)
def alike_keys(token: str) -> tuple[frozenset, frozenset]:
    """Keys of which any two tokens that are ``alike`` by more than a half have one in common: those of whole tokens, and those that count where one of the two is an initial."""
    bone = skeleton(token)
    first = {("=", token[0]), *(("s", c) for c in _first_sound(token)), *((("b", x[0]),) if (x := bone if not token.isascii() else token) else ())}
    if len(token) == 1:
        return frozenset({("=", token)}), frozenset(first)
    keys = {("=", token), *(("#", k) for k in nicknames(token)), *((("~", bone),) if bone else ())}
    if len(token) >= LONG_TOKEN - 2:
        keys |= {("n", n) for n in range(len(token) - 2, len(token) + 3)}
    if 3 <= len(token) < LONG_TOKEN:
        keys |= {("e", x) for x in _left_out(token, 2 if len(token) > 5 else 1)}
    if len(bone) > 2:
        keys |= {("n~", n) for n in range(len(bone) - 1, len(bone) + 2)} if len(bone) >= LONG_TOKEN - 1 else set()
        keys |= {("e~", x) for x in _left_out(bone, 1)} if len(bone) < LONG_TOKEN else set()
    return frozenset(keys), frozenset(first)


def alike_names(join: NameJoin, names: list[tuple[tuple[str, ...], tuple[float, ...]]]) -> Iterator[tuple[int, int]]:
    """(i, j), i < j, of all distinct names (tokens, weights) with a soft similarity of NAME_FLOOR or more; what the join on q-grams finds, and the others."""

    def similar(i: int, j: int) -> bool:
        w = dict(zip(*names[i], strict=True)) | dict(zip(*names[j], strict=True))
        return similarity(list(names[i][0]), list(names[j][0]), w.__getitem__) >= NAME_FLOOR

    if len(names) <= FEW_NAMES:
        yield from (p for p in combinations(range(len(names)), 2) if similar(*p))
        return
    found = set(join.pairs(names))
    yield from found
    having: dict[str, set[int]] = {}
    for i, (tokens, _) in enumerate(names):
        for t in tokens:
            having.setdefault(t, set()).add(i)
    whole: dict[tuple, list[str]] = {}
    spelled: dict[tuple, list[str]] = {}
    for t in having:
        keys, first = alike_keys(t)
        for k in keys:
            whole.setdefault(k, []).append(t)
        for k in first:
            spelled.setdefault(k, []).append(t)
    near: dict[str, set[int]] = {}
    for t in having:
        keys, first = alike_keys(t)
        others = {u for k in keys for u in whole[k]} | {u for k in first for u in spelled[k] if len(t) == 1 or len(u) == 1}
        near[t] = set().union(*(having[u] for u in others if alike(t, u) > 0.5))
    tried = set()
    for i, (tokens, weights) in enumerate(names):
        # A token that is matched with an initial counts by its own weight, or by an initial's where that stands in the shorter name: one of the heaviest is matched in the shorter.
        rest, least = sum(weights), NAME_FLOOR * sum(weights)
        for k in sorted(range(len(tokens)), key=lambda k: -weights[k]):
            if rest < least - 1e-9:
                break
            rest -= weights[k]
            for j in near[tokens[k]]:
                pair = (i, j) if i < j else (j, i)
                if j != i and pair not in found and pair not in tried:
                    tried.add(pair)
                    if similar(*pair):
                        yield pair


def candidates(names: DataFrame, keys: DataFrame, counts: Sequence[int]) -> DataFrame:
    """Distinct (a, b), a < b, of profiles that share evidence and whose names are softly similar by NAME_FLOOR or more; names (id, tokens, w), keys (id, h).

    What a piece of evidence brings together passes through one task, or, where more than BLOCK profiles have it, in pairs of blocks through as many tasks as it takes. Equal names
    are compared once, and their profiles paired without a comparison.
    """
    crowd = keys.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = keys.join(small(crowd), "h", "left").withColumn("mine", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("id", "h"), F.col("blocks"))).otherwise(0).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda k: F.struct(F.least("mine", k).alias("lo"), F.greatest("mine", k).alias("hi")))
    spread = placed.select("id", "h", "mine", F.inline(cell)).join(names, "id").select("h", "lo", "hi", "mine", "id", "tokens", "w")
    shared = names.sparkSession.sparkContext.broadcast(counts)  # GRAM_PLACES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join, out = NameJoin(shared.value), []
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True))
        for (_, lo, hi), group in groupby(rows, key=lambda r: r[:3]):
            by_name: dict[tuple, list[tuple[int, int]]] = {}
            for *_, mine, i, tokens, w in group:
                by_name.setdefault((tuple(tokens), tuple(w)), []).append((i, mine))
            if len(by_name) == 1 and len(next(iter(by_name.values()))) == 1:
                continue
            held = list(by_name.values())
            met = ((x, y) for ids in held for k, x in enumerate(ids) for y in ids[:k])
            similar = ((x, y) for i, j in alike_names(join, list(by_name)) for x in held[i] for y in held[j])
            for (a, ma), (b, mb) in (p for ps in (met, similar) for p in ps):
                if lo == hi or ma != mb:
                    out.append((a, b) if a < b else (b, a))
                    if len(out) == 20_000:
                        yield _batch(out, _PAIRS)
                        out = []
        yield _batch(out, _PAIRS)

    return spread.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi", "id").mapInArrow(run, "a bigint, b bigint").distinct()


def _months_agree(x: int | None, xm: bool, y: int | None, ym: bool) -> int:
    """2 same month, 1 same year where one names no month, 0 unknown, -1 different."""
    if x is None or y is None:
        return 0
    if xm and ym:
        return 2 if x == y else -1
    return 1 if x // 12 == y // 12 else -1


def career(ra: list, rb: list, ea: list, eb: list) -> float:
    """Agreement of two careers: the roles and schools that they share."""
    agree, used = 0.0, set()
    for x in ra:
        best, at = 0.0, None
        for k, y in enumerate(rb):
            if k in used:
                continue
            s, e = _months_agree(x["s"], x["sm"], y["s"], y["sm"]), _months_agree(x["e"], x["em"], y["e"], y["em"])
            if s < 0 or e < 0 or s == 0 and e == 0:
                continue
            org = 1.0 if x["org"] and x["org"] == y["org"] else 0.5 if not x["org"] or not y["org"] or x["org"].isascii() != y["org"].isascii() else 0.0
            v = org * (0.4 + 0.15 * (s + e))
            if v > best:
                best, at = v, k
        if at is not None:
            used.add(at)
            agree += best
    shared = set(ea) & set(eb)
    agree += 0.5 * len([x for x in shared if not x.startswith("|") and not x.endswith("|")])
    years = lambda es: {x.rpartition("|")[2] for x in es} - {""}
    if not shared and years(ea) & years(eb):
        agree += 0.2 * len(years(ea) & years(eb))
    return agree


def given_conflict(a: list[str], b: list[str]) -> bool:
    """Whether a name has a given name without a partner on the other side, and the other one too: names of two persons. Initials count where no given name is spelled out."""
    lone = lambda x, y: [t for t in x if max((alike(t, u) for u in y), default=0) <= 0.5]
    spelled = lambda x, y: [t for t in lone(x, y) if len(t) > 1 or sum(len(u) > 1 for u in x) < 2]
    return bool(spelled(a, b)) and bool(spelled(b, a))


def first_missing(a: list[str], b: list[str]) -> bool:
    """Whether the longer name's first given name has no partner, so that only a middle name agrees."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return len(long) > len(short) and max((alike(long[0], t) for t in short), default=0) <= 0.5


def same_person(a: dict, b: dict, weight, personal: int, crowded: int, mailed: bool) -> bool:
    """Whether two profiles are of one person: names that are spellings of one, and contacts or careers that agree.

    personal: shared contacts that only one family name stands on with one given name; crowded: shared contacts with several given names (a household). mailed: one of them is an e-mail address.
    """
    ta, tb = a["tokens"], b["tokens"]
    s = similarity(ta, tb, weight)
    if min(len(ta), len(tb)) < 2 and ta != tb:
        s = min(s, 0.79) if not max(alike(t, u) for t in ta for u in tb) >= 0.9 else s
    agree = career(a["roles"] or [], b["roles"] or [], a["edu"] or [], b["edu"] or [])
    family = max((alike(t, u) for t in ta for u in tb if len(t) > 2 and len(u) > 2), default=0)
    if s < NAME_SIMILARITY:
        # A short form that no list has: the family name, a personal contact and the career together leave no other reading; nor do a name in common and a personal address.
        if mailed and personal and s > NAME_FLOOR and family >= 0.95:
            return True
        return s > NAME_FLOOR and (family >= 0.7 and personal + crowded > 0 and agree >= 0.9 or family >= 0.9 and agree >= 1.8)
    full = [t for t in (ta if len(ta) <= len(tb) else tb) if len(t) > 1]
    sure = len(full) >= 2  # a given name is spelled out on both sides
    if given_conflict(ta, tb):
        return agree >= 1.5 and personal + crowded > 0
    if first_missing(ta, tb) and not mailed:
        return agree >= 0.5
    if personal:
        return True
    if crowded:
        return sure or agree >= 0.5
    return agree >= (0.9 if sure else 1.4)


def linked(persons: DataFrame) -> DataFrame:
    """(profile_a, profile_b), a < b, of one person.

    Profiles without a name are never linked; a profile without contacts and dated roles has no evidence and isn't either. Repeated rows (the same id) must be taken out
    before: see ``p2_found``. Ties don't matter, as each pair is judged by itself; an empty table gives an empty result.
    """
    persons = stored(persons)
    stats = token_stats(persons)
    names = stored(weighed(persons, stats, persons.count()))
    uses = stored(contact_uses(persons, names))
    pairs = stored(candidates(names.drop("fam"), evidence(persons, uses), gram_counts(stats)))
    both_ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    met = persons.drop("tokens").join(both_ids, "id", "left_semi").join(names.select("id", "tokens", F.map_from_arrays(F.array_distinct("tokens"), F.transform(F.array_distinct("tokens"), lambda t: F.get("w", F.array_position("tokens", t).cast("int") - 1))).alias("w")), "id")
    marked = met.select("id", F.explode("contacts").alias("key")).join(uses, "key").groupBy("id").agg(F.collect_list(F.struct("key", "f", "g")).alias("uses"))  # at most a profile's contacts
    side = met.join(marked, "id", "left")
    row = F.struct("id", "tokens", "roles", "edu", "w", "uses")
    both = pairs.join(side.select(F.col("id").alias("a"), row.alias("x")), "a").join(side.select(F.col("id").alias("b"), row.alias("y")), "b").select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = dict(x["w"] or ()) | dict(y["w"] or ())
                ux, uy = {u["key"]: u for u in x["uses"] or []}, {u["key"]: u for u in y["uses"] or []}
                shared = [ux[k] for k in ux.keys() & uy.keys()]
                personal = sum(1 for u in shared if u["f"] <= SHARED_BY and u["g"] <= 2)
                crowded = sum(1 for u in shared if u["f"] <= SHARED_BY and u["g"] > 2)
                if same_person(x, y, lambda t, w=w: w.get(t, 5.0), personal, crowded, any(u["key"][0] == "e" for u in shared)):
                    found.append((x["id"], y["id"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], names=["profile_a", "profile_b"])

    return both.mapInArrow(run, "profile_a bigint, profile_b bigint")


def _dated(today: datetime.date) -> Column:
    def one(x: Column) -> Column:
        bare = lambda c: ~F.coalesce(F.translate(F.trim(c), "٠١٢٣٤٥٦٧٨٩", "0123456789").rlike(r"^\d{4}$"), F.lit(True))
        return F.struct(x["organization"].alias("org"), parse_month(x["start"], end=False, today=today).alias("s"), bare(x["start"]).alias("sm"), parse_month(x["end"], end=True, today=today).alias("e"), bare(x["end"]).alias("em"))

    return F.transform("experiences", one)


def profile_people(spark: SparkSession, sf_dir: str, today: datetime.date = datetime.date(2026, 6, 1)) -> DataFrame:
    """The current profiles as persons."""
    keep = {
        "name": F.col("identity.full_name.value"), "emails": F.col("identity.emails"), "phones": F.col("identity.phones"), "links": F.col("identity.links"), "roles": _dated(today),
        "edu": F.transform("education", lambda x: F.struct(x["institution"].alias("inst"), x["year"].alias("year"))),
    }
    return people(current_profiles(spark, sf_dir, keep).withColumnRenamed("profile_id", "id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of profiles of one person."""
    return linked(profile_people(spark, sf_dir))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
