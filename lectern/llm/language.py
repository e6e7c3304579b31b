"""The language of each text and of its paragraphs in another language, by Bayesian fusion of several kinds of evidence.

For a text t of host h with label d and address suffix s, the score of language l is

    temper * log P(words of t | l)  +  log P(d | l)  +  log P(s | l)  +  log P(l | h),

with the word likelihoods of ``langmodel``, the label likelihoods counted over the whole table (how often each label stands on texts of each language), and
host priors smoothed hierarchically (host towards its source, source towards the whole) from counts by grouped aggregation.

A paragraph of a text with main language m is fused in the same way: its own words, and as prior m with 1 - SWITCH, any other language with SWITCH times its share of what
label and host say of the languages besides m. It is in the language of the greatest posterior.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.chars import canonical
from lectern.llm.langmodel import LANGS, LanguageModel, label_language, train
from lectern.sources.shared import stored

#: Labelled rows that the word model is fitted on, at most, of each table.
SAMPLE_ROWS = 1_500
#: Words aren't independent: their log-likelihoods count by this much.
TEMPER = 0.3
#: Prior share of paragraphs in another language than the main one.
SWITCH = 0.05
#: Text evidence (in nats) beyond which label and host can't move the main language; below it all paragraphs are kept until it is known.
SURE = 15.0
#: Texts handled at once.
SLICE = 500
#: Weight of the broader level in a host's prior, in texts; rows of the label table are smoothed by one text.
PRIOR_WEIGHT = 5.0
# Address suffixes of countries with one of these languages.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es", "pt": "pt", "br": "pt", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "sa": "ar", "ae": "ar", "eg": "ar", "ma": "ar", "jo": "ar", "qa": "ar", "kw": "ar"}
_SUFFIX = re.compile(r"(?:@|https?://|www\.)[\w.-]*\.([a-z]{2})\b")
_N = len(LANGS)
_SIGNALS = "origin string, item_id bigint, source string, host string, label string, named boolean, ll array<float>, segments array<struct<seg_no:int,ll:array<float>>>"
_OUT = pa.schema([("origin", pa.string()), ("item_id", pa.int64()), ("source", pa.string()), ("host", pa.string()), ("label", pa.string()), ("named", pa.bool_()), ("ll", pa.list_(pa.float32())), ("segments", pa.list_(pa.struct([("seg_no", pa.int32()), ("ll", pa.list_(pa.float32()))])))])


def fit(texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """The word model, from the ``sample_rows`` labelled rows of each origin with the least hash (the same share of all parts of the table)."""
    labelled = texts.where("text is not null and label is not null").withColumn("_h", F.xxhash64("item_id").bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = {r.origin: r["count"] for r in labelled.groupBy("origin").count().collect()}
    if not counts:
        return train([])
    # Only rows below a hash of which about twice as many are expected go to the sort, so that it stays as small at any size of the table.
    parts = [labelled.where((F.col("origin") == o) & (F.col("_h") <= int(min(1.0, 2 * sample_rows / n) * 0xFFFFFFFF))).orderBy("_h").limit(sample_rows).select("text", "label") for o, n in sorted(counts.items())]
    return train((r.text, r.label) for r in reduce(DataFrame.union, parts).collect())


def _signals(texts: DataFrame, model: LanguageModel) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):  # a slice's texts and evidence are all that is held at once
                yield one(m, whole.slice(start, SLICE))

    def one(m: LanguageModel, b: pa.RecordBatch) -> pa.RecordBatch:
        labels, named, sums, segments = [], [], [], []
        for text, label in zip(b.column("text"), b.column("label"), strict=True):
            text, lang = text.as_py(), label_language(label.as_py())
            found = m.paragraphs(canonical(text))
            labels.append(lang)
            named.append(lang is not None)
            v = found[:, 0].sum(axis=0)
            if (s := _SUFFIX.search(text)) and s.group(1) in SUFFIXES:
                v[LANGS.index(SUFFIXES[s.group(1)])] += 2.0 / TEMPER  # e**2 times as likely
            sums.append(v)
            # Only paragraphs whose words could outweigh the prior of the main language move.
            own, (second, first) = found[:, 0], np.sort(v)[-2:]
            against = own[:, int(v.argmax())] if TEMPER * (first - second) > SURE else own.min(axis=1)
            strong = np.nonzero(TEMPER * (own.max(axis=1) - against) >= math.log((1 - SWITCH) / SWITCH))[0]
            segments.append([{"seg_no": int(k) + 1, "ll": own[k]} for k in strong])
        return pa.RecordBatch.from_arrays([b.column("origin").cast(pa.string()), b.column("item_id"), b.column("source").cast(pa.string()), b.column("host").cast(pa.string()), pa.array(labels, pa.string()), pa.array(named, pa.bool_()), pa.array(sums, _OUT.field("ll").type), pa.array(segments, _OUT.field("segments").type)], schema=_OUT)

    return texts.where("text is not null and item_id is not null").select("origin", "item_id", "source", "host", "text", "label").mapInArrow(run, _SIGNALS)


def _best(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)).cast("int")


def _softmax_top(v: Column) -> Column:
    return 1.0 / F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(v)))


def languages(texts: DataFrame, sample_rows: int = SAMPLE_ROWS, model: LanguageModel | None = None) -> DataFrame:
    """(origin, item_id, seg_no, lang, confidence, label, label_right) for texts (origin, item_id, source, host, text, label).

    seg_no 0 is the main language of the text, with one row for every item; seg_no k >= 1 the k-th paragraph (split at blank lines), where it is in
    another language. label_right is null on those, false where the label is null or names another or no language. Whole texts are read once, where they are; what moves is
    their evidence, a few hundred bytes an item. Items with the same origin and id are one; null texts give no row; a text without any word, or an empty one,
    gets its language from label and host. Null hosts and sources share the prior above them. Ties go to the language that comes first in ``LANGS``. Other columns aren't read; an empty table gives an empty result.
    """
    model = model or fit(texts, sample_rows)
    seen = stored(_signals(texts, model).dropDuplicates(["origin", "item_id"]))
    guess = seen.select("*", _best("ll").alias("g"))
    # How often each label stands on texts of each language: at most origins x labels x languages rows.
    table = {(r.origin, r.label, r.g): r.n for r in guess.groupBy("origin", "label", "g").agg(F.count("*").alias("n")).collect()}
    origins = sorted({o for o, _, _ in table})
    of_label = []
    for o in origins:
        totals = [sum(n for (x, _, g), n in table.items() if x == o and g == k + 1) for k in range(_N)]
        for label in [None, *LANGS]:
            odds = [math.log((table.get((o, label, k + 1), 0) + (1 if k == LANGS.index(label) else 0.2) if label else 1.0) / (totals[k] + 2) if label else 1.0) for k in range(_N)]
            of_label.append((o, label, odds))
    label_map = F.create_map(*[x for o, label, odds in of_label for x in (F.lit(f"{o}/{label}"), F.array(*map(F.lit, odds)))]) if of_label else F.create_map(F.lit(""), F.array(F.lit(0.0)))
    counts = lambda *by: guess.groupBy(*by).agg(F.array(*[F.count_if(F.col("g") == k + 1).cast("double") for k in range(_N)]).alias("c"))
    share = lambda c, up: F.zip_with(c, up, lambda n, p: (n + PRIOR_WEIGHT * p) / (F.aggregate(c, F.lit(0.0), lambda a, x: a + x) + PRIOR_WEIGHT))
    even = F.array(*[F.lit(1 / _N)] * _N)
    whole = counts("origin").select("origin", share(F.col("c"), even).alias("p0"))
    by_source = counts("origin", "source").join(F.broadcast(whole), "origin").select("origin", "source", share(F.col("c"), F.col("p0")).alias("p1"))
    by_host = (
        counts("origin", "source", "host")
        .join(by_source.withColumnRenamed("source", "s").withColumnRenamed("origin", "o"), (F.col("origin") == F.col("o")) & F.col("source").eqNullSafe(F.col("s")))
        .select("o", "s", F.col("host").alias("h"), F.when(F.col("host").isNull(), F.col("p1")).otherwise(share(F.col("c"), F.col("p1"))).alias("prior"))
    )
    joined = seen.join(by_host, (F.col("origin") == F.col("o")) & F.col("source").eqNullSafe(F.col("s")) & F.col("host").eqNullSafe(F.col("h")))
    of_label_col = F.coalesce(F.try_element_at(label_map, F.concat_ws("/", "origin", F.coalesce("label", F.lit("None")))), F.array(*[F.lit(0.0)] * _N))
    with_label = F.zip_with(F.transform("ll", lambda x: x.cast("double") * TEMPER), of_label_col, lambda a, b: a + b)
    scored = joined.select("origin", "item_id", "label", "segments", F.zip_with(with_label, "prior", lambda a, p: a + F.log(p)).alias("score"), F.zip_with(of_label_col, "prior", lambda o, p: F.exp(o) * p).alias("other"))
    names = F.array(*map(F.lit, LANGS))
    found = scored.select("origin", "item_id", "label", "segments", "other", _best(F.col("score")).alias("m"), _softmax_top(F.col("score")).alias("confidence")).withColumn("lang", F.element_at(names, F.col("m")))
    besides = F.aggregate("other", F.lit(0.0), lambda a, x: a + x) - F.element_at("other", F.col("m"))
    prior = F.transform("other", lambda x, i: F.when(i + 1 == F.col("m"), math.log(1 - SWITCH)).otherwise(math.log(SWITCH) + F.log(x / besides)))
    fused = F.transform("segments", lambda s: F.struct(s["seg_no"].alias("seg_no"), F.zip_with(s["ll"], "prior", lambda x, p: x.cast("double") * TEMPER + p).alias("post")))
    found = found.withColumn("prior", prior).withColumn("fused", fused)
    segments = F.transform(
        F.filter("fused", lambda s: _best(s["post"]) != F.col("m")),
        lambda s: F.struct(s["seg_no"].alias("seg_no"), F.element_at(names, _best(s["post"])).alias("lang"), _softmax_top(s["post"]).alias("confidence"), F.lit(None).cast("boolean").alias("label_right")),
    )
    first = F.struct(F.lit(0).alias("seg_no"), F.col("lang"), F.col("confidence"), F.coalesce(F.col("label") == F.col("lang"), F.lit(False)).alias("label_right"))
    return found.select("origin", "item_id", "label", F.explode(F.concat(F.array(first), segments)).alias("x")).select("origin", "item_id", "x.seg_no", "x.lang", "x.confidence", "label", "x.label_right")


def corpus_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with a label: profiles, job descriptions, documents; the session of the first two is their host, the organisation that of the last."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    row = lambda o, i, t, d, s, h: (F.lit(o).alias("origin"), F.col(i).alias("item_id"), s.alias("source"), F.col(h).alias("host"), F.col(t).alias("text"), F.col(d).alias("label"))
    none = F.lit(None).cast("string")
    return (
        read("profiles").select(*row("profile", "profile_id", "full_text", "lang", none, "chat_id"))
        .union(read("score_requests").select(*row("jd", "request_id", "jd_text", "jd_lang", none, "chat_id")))
        .union(read("documents").select(*row("document", "doc_id", "text", "lang", F.col("source"), "org_key")))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose label is missing or wrong, and paragraphs in another language than the main one."""
    return languages(corpus_texts(spark, sf_dir)).where("seg_no > 0 or not label_right").select("origin", "item_id", "seg_no", "lang")


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every item and the language of its other paragraphs, with confidence."""
    return languages(corpus_texts(spark, sf_dir)).drop("label")


QUERIES = {"p4_found": p4_found, "p4_languages": p4_languages}
SQL: dict[str, str] = {}
