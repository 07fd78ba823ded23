"""Queries that call operators on DataFrames; their SQL is written apart from them, over single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import inference, logs, selective
from ..sources import readers
from . import dual, scored

_SCORES = "with " + scored.SCORES + " select * from scores"
_PLAYED = "with " + scored.ROUTED + " select * from played"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return dual.query(_SCORES)(spark, sf).withColumn("hard", 1 - F.col("gate"))


def wn11_refusal(spark, sf):
    out = selective.refusal(_scores(spark, sf), "tier", "task_id", "conf", "correct", "hard", 0.8)
    return out.select("tier", *(F.round(c, 9).alias(c) for c in ("answered_accuracy", "refused_precision", "hard_recall")))


def wn15_choose_threshold(spark, sf):
    """A tier with a threshold, and one without: no risk is below zero."""
    s = _scores(spark, sf)
    return selective.choose_threshold(s, "tier", "conf", "correct", 0.3).join(selective.choose_threshold(s, "tier", "conf", "correct", -0.1).withColumnRenamed("threshold", "none"), "tier")


def wn16_taus(spark, sf):
    return selective.taus(_scores(spark, sf), "tier", "conf", "correct", alpha=0.3)


def wn16_taus_strict(spark, sf):
    return selective.taus(_scores(spark, sf), "tier", "conf", "correct")


def st04_mcnemar(spark, sf):
    played = dual.query(_PLAYED)(spark, sf)
    counts = played.groupBy("domain").agg(F.count_if((F.col("c0") == 1) & (F.col("c2") == 0)).alias("b"), F.count_if((F.col("c0") == 0) & (F.col("c2") == 1)).alias("c"))
    ps = {a: F.round(inference.mcnemar(F.col("b"), F.col("c"), w), 9).alias(a) for a, w in (("two_sided", "two-sided"), ("greater", "greater"), ("less", "less"))}
    return counts.select("domain", "b", "c", *ps.values())


def st06_wilson_interval(spark, sf):
    low, high = selective.wilson(F.col("k"), F.col("n"))
    counts = _scores(spark, sf).groupBy("tier").agg(F.sum("correct").alias("k"), F.count(F.lit(1)).alias("n"))
    return counts.select("tier", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def st07_certificate(spark, sf):
    return inference.certify(_scores(spark, sf), "tier", "conf", "correct")


def fl02_prefilter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    reason = F.when(F.contains("text", F.lit("NC 4.0")), "license").when(t.hash_mod(F.col("doc_id").cast("string"), 20) < 3, "reserved").when(F.col("n_chars") < 100, "trivial").otherwise("kept")
    return docs.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def fl05_split_bucket(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", t.hash_mod(F.concat("source", F.col("doc_id").cast("string")), 20).alias("bucket")).where("bucket < 3")


def wn25_chain_check(spark, sf):
    """Events of a user as a chained log, of which some records are changed, and some cut out, after they were written."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", logs.canonical("event_id", "event_type", "value").alias("body"))
    written = logs.chained(events, "user_id", "event_id", "body")
    damaged = written.where("event_id % 89 <> 0").withColumn("body", F.when(F.col("event_id") % 97 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return logs.verify_chain(damaged, "user_id", "event_id", "body")


def src16_text_chunks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return readers.text_chunks(docs, "doc_id", "text").select("doc_id", "chunk", F.length("chunk_text").cast("long").alias("n_chars"), "chunk_id")


QUERIES = {f.__name__: f for f in (wn11_refusal, wn15_choose_threshold, wn16_taus, wn16_taus_strict, st04_mcnemar, st06_wilson_interval, st07_certificate, fl02_prefilter, fl05_split_bucket, wn25_chain_check, src16_text_chunks)}

_S = "with " + scored.SCORES
_TAUS = """, cuts as (select distinct tier, conf as t from scores), h as (select c.tier, t, count(*) as n, sum(1 - correct) as w from cuts c join scores s on s.tier = c.tier and s.conf >= t group by 1, 2),
l as (select c.tier, t, count(*) as n, sum(1 - correct) as w from cuts c join scores s on s.tier = c.tier and s.conf <= t group by 1, 2)
select tier, coalesce((select min(t) from h where h.tier = g.tier and n >= 20 and (w + 1) / (n + 1) <= ALPHA), 'Infinity'::double) as tau_hi,
coalesce((select max(t) from l where l.tier = g.tier and n >= 20 and w / n >= 0.9), '-Infinity'::double) as tau_lo from (select distinct tier from scores) g"""
_HASH20 = "(16 * list_sum(list_transform(range(1, 64), lambda i: ('0x' || substr(d, i, 1))::bigint)) + ('0x' || substr(d, 64, 1))::bigint) % 20"
_CDF = "coalesce((select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) from (select unnest(range(0, ({k})::bigint + 1)) as i) u), 0)"
_DISCORDANT = "d as (select domain, count(*) filter (c0 = 1 and c2 = 0) as b, count(*) filter (c0 = 0 and c2 = 1) as c from played group by domain), m as (select *, b + c as n from d)"
_ORACLES = {
    "wn11_refusal": _S + """, o as (select *, 1 - gate as hard, row_number() over (partition by tier order by conf desc, task_id::varchar) as r, greatest(1, round_even(0.8 * count(*) over (partition by tier), 0)) as a from scores)
select tier, round(avg(correct) filter (r <= a), 9) as answered_accuracy, round(avg(1 - correct) filter (r > a), 9) as refused_precision, round(coalesce(sum(hard) filter (r > a), 0) / greatest(1, sum(hard)), 9) as hard_recall from o group by tier""",
    "wn15_choose_threshold": _S + """, o as (select tier, conf, avg(1 - correct) over w as risk, count(*) over w as k, lead(conf) over (partition by tier order by conf desc, task_id) as next_conf from scores window w as (partition by tier order by conf desc, task_id)),
best as (select tier, max(k) filter (k >= 30 and risk <= 0.3 and next_conf is distinct from conf) as k from o group by tier)
select b.tier, coalesce(o.conf, 'Infinity'::double) as threshold, 'Infinity'::double as "none" from best b left join o on o.tier = b.tier and o.k = b.k""",
    "wn16_taus": _S + _TAUS.replace("ALPHA", "0.3"),
    "wn16_taus_strict": _S + _TAUS.replace("ALPHA", "0.1"),
    "st04_mcnemar": f"with {scored.ROUTED}, {_DISCORDANT}, t as (select *, {_CDF.format(p=0.5, k='least(b, c)')} as two, {_CDF.format(p=0.5, k='b - 1')} as upper, {_CDF.format(p=0.5, k='b')} as lower from m) select domain, b, c, round(case when n = 0 then 1 else least(1, 2 * two) end, 9) as two_sided, round(case when n = 0 or b = 0 then 1 else least(1, 1 - upper) end, 9) as greater, round(case when n = 0 then 1 else least(1, lower) end, 9) as less from t",
    "st06_wilson_interval": _S + ", p as (select tier, avg(correct) as p, count(*) as n from scores group by tier) select tier, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) as low, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) as high from p",
    "st07_certificate": _S + f""", th as (select * from (values (1, 0.95), (2, 0.925), (3, 0.9), (4, 0.875), (5, 0.85)) v(k, t)),
c as (select g.tier, th.k, th.t, count(s.tier) as n, coalesce(sum(1 - s.correct), 0)::bigint as e from (select distinct tier from scores) g cross join th left join scores s on s.tier = g.tier and s.conf >= th.t::double group by 1, 2, 3),
j as (select *, n > 0 and {_CDF.format(p=0.1, k='e')} <= 0.1 as passed from c),
s as (select *, bool_and(passed) over (partition by tier order by k) as still from j)
select tier, min(t) filter (still)::double as certified from s group by tier""",
    "fl02_prefilter": f"select reason, count(*) as n from (select case when contains(text, 'NC 4.0') then 'license' when {_HASH20} < 3 then 'reserved' when n_chars < 100 then 'trivial' else 'kept' end as reason from (select *, sha256(doc_id::varchar) as d from documents) s) u group by reason",
    "fl05_split_bucket": f"select doc_id, bucket from (select doc_id, {_HASH20} as bucket from (select doc_id, sha256(source || doc_id::varchar) as d from documents) s) u where bucket < 3",
    "wn25_chain_check": """with n as (select *, lag(event_id) over (partition by user_id order by event_id) as before from events)
select user_id, event_id, coalesce(before % 89 = 0, false) as broken_link, event_id % 97 = 0 as broken_hash from n where event_id % 89 <> 0 and (coalesce(before % 89 = 0, false) or event_id % 97 = 0)""",
    "src16_text_chunks": """with l as (select doc_id, string_split(text, chr(10)) as x from documents where text is not null), c as (select doc_id, unnest(range(0, (len(x) - 1) // 40 + 1)) as chunk, x from l),
j as (select doc_id, chunk::int as chunk, array_to_string(x[chunk * 40 + 1:chunk * 40 + 40], chr(10)) as y from c)
select doc_id, chunk, length(y) as n_chars, sha256(concat(doc_id, ':', chunk, ':', y)) as chunk_id from j where length(trim(y, ' ')) > 40""",
}
ORACLES = {k: dual.for_oracle(v) for k, v in _ORACLES.items()}
