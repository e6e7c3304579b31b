"""Queries on nested records and employment periods."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.dates import month_label, parse_month
from lectern.operators.intervals import periods_and_gaps
from lectern.operators.nested import emit, read_table, write_tables
from lectern.plans.profile_spec import PROFILE, REPLY
from lectern.sources.shared import checkpoint_dir
from lectern.sources.tables import current_profiles, latest, table

TODAY = datetime.date(2026, 6, 1)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child item present in the current profiles and in the model replies."""
    parts = F.to_json(F.struct("identity", "experiences", "education", "skills"))
    profiles = emit(current_profiles(spark, sf_dir, {"record": parts}), "profile_id", F.col("record"), PROFILE)
    replies = emit(latest(table(spark, sf_dir, "model_replies"), "reply_id", ["received_at"], ["payload"]), "reply_id", F.col("payload"), REPLY)
    cols = ["record_id", F.col("tag").alias("path"), "parent_pos", "pos"]
    return profiles.where("present").select(F.lit("profile").alias("origin"), *cols).unionByName(replies.where("present").select(F.lit("reply").alias("origin"), *cols))


# What the flat tables hold, by tag.
SCHEMAS = {
    "experiences": "title string, organization string, start string, `end` string", "education": "degree string, field string, institution string, year string", "skills": "name string, source string", "identity.full_name": "value string",
    "experiences.evidence": "page int, quote string", "education.evidence": "page int, quote string", "skills.evidence": "page int, quote string", "identity.full_name.evidence": "page int, quote string",
    "identity.emails": "value string", "identity.phones": "value string", "identity.links": "value string",
}


def profile_tables(spark: SparkSession, sf_dir: str) -> str:
    """The folder, in the shared one, of the flat tables of all current profiles: tagged rows written once, a folder for each tag."""
    parts = F.to_json(F.struct("identity", "experiences", "education", "skills"))
    path = f"{checkpoint_dir(spark)}/nested-{uuid.uuid4()}"
    write_tables(emit(current_profiles(spark, sf_dir, {"record": parts}), "profile_id", F.col("record"), PROFILE), path)
    return path


def p3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of roles, schools and skills beside the item that it belongs to: child tables joined to their parents, each read from its tag's folder under its schema."""
    path = profile_tables(spark, sf_dir)
    out = []
    for tag, named in (("experiences", "title"), ("education", "degree"), ("skills", "name")):
        parent = read_table(spark, path, tag, SCHEMAS[tag]).where("present").select("pk", F.col(named).alias("item"))
        child = read_table(spark, path, f"{tag}.evidence", SCHEMAS[f"{tag}.evidence"]).where("present").select("record_id", "parent_pk", F.col("parent_pos").alias("pos"), "page", "quote")
        out.append(child.join(parent, F.col("parent_pk") == F.col("pk")).select("record_id", F.lit(tag).alias("path"), "pos", "item", "page", "quote"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def role_months(experiences: Column, title: bool = False) -> Column:
    """Roles as months counted from year 0: structs of s and e, null where they can't be read; with the title in small letters."""
    month = lambda x, end: parse_month(x, end=end, today=TODAY)
    named = lambda r: [F.lower(F.coalesce(r["title"], F.lit(""))).alias("title")] if title else []
    return F.transform(experiences, lambda r: F.struct(month(r["start"], False).alias("s"), month(r["end"], True).alias("e"), *named(r)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of employment and the gaps between them, by profile."""
    month = lambda x, end: parse_month(x, end=end, today=TODAY)
    roles = F.transform(
        F.arrays_zip(F.col("experiences.start").alias("s"), F.col("experiences.end").alias("e")),
        lambda r: F.struct(month(r["s"], False).alias("s"), month(r["e"], True).alias("e")),
    )
    months = current_profiles(spark, sf_dir, {"roles": roles}).select("profile_id", F.inline("roles"))
    found = periods_and_gaps(months, "profile_id", "s", "e")
    return found.select("profile_id", "kind", month_label(F.col("first")).alias("first_month"), month_label(F.col("last")).alias("last_month"))


QUERIES = {"p3_found": p3_found, "p3_evidence": p3_evidence, "p6_found": p6_found}
