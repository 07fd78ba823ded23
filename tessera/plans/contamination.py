"""Contamination queries: DataFrame operators against plain SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import decontaminate as dc
from ..operators import knn
from .dual import for_oracle


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def dc01_exact(spark, sf):
    docs, evals = _read(spark, sf, "documents", "benchmark")
    return dc.exact_hits(docs, evals)


def dc01_exact_copies(spark, sf):
    (docs,) = _read(spark, sf, "documents")
    return docs.select(dc.exact_key(F.col("text")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and k is not null")


def dc05_ngram13(spark, sf):
    return dc.ngram_hits(*_read(spark, sf, "documents", "benchmark")).select("doc_id", "item_id")


def dc05_smallest_gram(spark, sf):
    return dc.ngram_hits(*_read(spark, sf, "documents", "benchmark"))


def dc06_max_df(spark, sf):
    return dc.ngram_hits(*_read(spark, sf, "documents", "benchmark"), max_df=1).select("doc_id", "item_id")


def dc07_jaccard(spark, sf):
    docs, evals = _read(spark, sf, "documents", "benchmark")
    return dc.jaccard_join(docs.selectExpr("doc_id as id", "text"), evals.selectExpr("item_id as id", "text"))


def jn11_jaccard_documents(spark, sf):
    (docs,) = _read(spark, sf, "documents")
    try:  # the llm subpackage may be absent; the join of two tables has the same rows, but shuffles all sets
        from ..llm import pairs
    except ModuleNotFoundError as error:
        if not (error.name or "").startswith("tessera.llm"):
            raise
        docs = docs.selectExpr("doc_id as id", "text")
        return dc.jaccard_join(docs, docs).where("a < b").select("a", "b", "overlap")
    return pairs.linked_pairs(docs, size=5, limit=Fraction(8, 10), least=3, plain=lambda name: t.spaced_words(F.col(name)))


def dc09_template(spark, sf):
    (docs,) = _read(spark, sf, "documents")
    masked = F.regexp_replace(t.normalize_text(F.col("text")), r"[0-9]+", "<n>")
    return docs.where(F.col("text").rlike("[0-9]")).select("doc_id", F.sha2(masked, 256).alias("template"))


def dc10_number_multiset(spark, sf):
    (docs,) = _read(spark, sf, "documents")
    nums = F.array_sort(F.regexp_extract_all("text", F.lit(r"([0-9]+)"), F.lit(1)))
    return docs.select("doc_id", F.size(nums).alias("n"), F.array_join(nums, ",").alias("nums")).where("n >= 2")


def dc09_template_hits(spark, sf):
    return dc.template_hits(*_read(spark, sf, "documents", "benchmark"))


def dc10_number_hits(spark, sf):
    return dc.number_hits(*_read(spark, sf, "documents", "benchmark"))


def dc13_source_rule(spark, sf):
    (docs,) = _read(spark, sf, "documents")
    return docs.select("doc_id", F.when(F.col("source").isNull(), "source_missing").when(F.col("source").rlike("^src[12]$"), "source").alias("hit")).where("hit is not null")


def dc15_dedup_sources(spark, sf):
    return dc.dedup_sources(*_read(spark, sf, "documents"))


def dc18_summary(spark, sf):
    docs, evals = _read(spark, sf, "documents", "benchmark")
    hits = dc.ngram_hits(docs, evals).join(docs.select("doc_id", "source"), "doc_id")
    return hits.groupBy("source").agg(F.countDistinct("doc_id").alias("train_items"), F.countDistinct("item_id").alias("eval_items"))


def dc19_verify_clean(spark, sf):
    docs, evals = _read(spark, sf, "documents", "benchmark")
    clean = docs.join(dc.ngram_hits(docs, evals).select("doc_id"), "doc_id", "left_anti")
    return dc.ngram_hits(clean, evals).agg(F.count(F.lit(1)).alias("left_over"))


def dc20_first_reason(spark, sf):
    docs, evals = _read(spark, sf, "documents", "benchmark")
    exact = dc.exact_hits(docs, evals).select("doc_id").distinct().withColumn("e", F.lit(True))
    gram = dc.ngram_hits(docs, evals).select("doc_id").distinct().withColumn("g", F.lit(True))
    reason = F.when(F.col("e"), "exact").when(F.col("g"), "ngram13").when(F.col("source") == "src1", "source")
    return docs.join(exact, "doc_id", "left").join(gram, "doc_id", "left").select("doc_id", reason.alias("reason")).where("reason is not null")


def dc21_containment(spark, sf):
    return dc.containment(*_read(spark, sf, "documents", "benchmark"), limit=0.05)


def dc21_containment_half(spark, sf):
    return dc.containment(*_read(spark, sf, "documents", "benchmark"))


def dc22_informative(spark, sf):
    return dc.ngram_hits(*_read(spark, sf, "documents", "benchmark"), only_informative=True).select("doc_id", "item_id")


def dc25_overlap_abort(spark, sf):
    docs, labels = _read(spark, sf, "documents", "labels")
    return docs.join(labels, "doc_id", "left_semi").select("doc_id")


def fn01_words(spark, sf):
    (docs,) = _read(spark, sf, "documents")
    return docs.select("doc_id", F.size(t.words(F.col("text"))).alias("n_words"), F.sha2(t.normalize_text(F.col("text")), 256).alias("normal"))


def rt06_knn_vote(spark, sf):
    """Exact cosine neighbours of the asked vectors: a stated query set against all rows."""
    from pyspark.sql.window import Window

    (e,) = _read(spark, sf, "embeddings")
    near = knn.neighbours(dc.spread(e), e.where("vec_id % 50 = 0"), 15)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))).where("r <= 15")
    return top.groupBy("q").agg(F.sum("same").alias("votes"))


QUERIES = {f.__name__: f for f in (dc01_exact, dc01_exact_copies, dc05_ngram13, dc05_smallest_gram, dc06_max_df, dc07_jaccard, jn11_jaccard_documents, dc09_template, dc09_template_hits, dc10_number_multiset, dc10_number_hits, dc13_source_rule, dc15_dedup_sources, dc18_summary, dc19_verify_clean, dc20_first_reason, dc21_containment, dc21_containment_half, dc22_informative, dc25_overlap_abort, fn01_words, rt06_knn_vote)}

_NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"
_KEYS = f"keys as (select 0 as side, doc_id as id, source, case when length(trim(text)) >= 20 then sha256({_NORM}) end as k from documents union all select 1, item_id, null, case when length(trim(text)) >= 20 then sha256({_NORM}) end from benchmark)"
_GRAMS = r"""texts as (select 0 as side, doc_id as id, @words[text] as w from documents union all select 1, item_id, @words[text] from benchmark),
grams as (select distinct side, id, array_to_string(g, ' ') as gram from (select side, id, unnest(case when len(w) >= 13 then list_filter(list_transform(range(1, len(w) - 11), lambda i: w[i:i+12]), lambda g: len(list_filter(g, lambda x: regexp_matches(x, '\p{L}'))) >= 4) when len(w) >= 8 then [w] else [] end) as g from texts) t),
hits as (select d.id as doc_id, e.id as item_id, min(d.gram) as gram from grams d join grams e on d.gram = e.gram and d.side = 0 and e.side = 1 group by 1, 2)"""
_SETS = """sets as (select side, id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) >= 3 then [array_to_string(w, ' ')] else [] end) as s from texts),
flat as (select side, id, len(s) as n, unnest(s) as g from sets)"""
_PROBLEMS = r"""toks as (select 0 as side, doc_id as id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[0-9]+(?:\.[0-9]+)?|[\p{L}\p{N}_]+|[-+*/^=<>()|!]') as w from documents union all
select 1, item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[0-9]+(?:\.[0-9]+)?|[\p{L}\p{N}_]+|[-+*/^=<>()|!]') from benchmark),
problems as (select *, list_filter(w, lambda x: regexp_matches(x, '^[0-9]+(\.[0-9]+)?$')) as nums, list_filter(w, lambda x: regexp_matches(x, '^\p{L}+$')) as alpha from toks)"""
_ORACLES = {
    "dc01_exact": f"with {_KEYS} select d.id as doc_id, e.id as item_id from keys d join keys e on d.k = e.k and d.side = 0 and e.side = 1",
    "dc01_exact_copies": f"with {_KEYS} select k, count(*) as n from keys where side = 0 and k is not null group by k having count(*) > 1",
    "dc05_ngram13": f"with {_GRAMS} select doc_id, item_id from hits",
    "dc05_smallest_gram": f"with {_GRAMS} select doc_id, item_id, gram from hits",
    "dc06_max_df": f"with {_GRAMS}, few as (select gram from grams where side = 1 group by gram having count(distinct id) <= 1) select distinct d.id as doc_id, e.id as item_id from grams d join grams e on d.gram = e.gram and d.side = 0 and e.side = 1 join few on few.gram = d.gram",
    "dc07_jaccard": f"with {_GRAMS}, {_SETS} select a.id as a, b.id as b, count(*) as overlap, any_value(a.n) as size_a, any_value(b.n) as size_b from flat a join flat b on a.g = b.g and a.side = 0 and b.side = 1 group by 1, 2 having count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9",
    "jn11_jaccard_documents": f"with {_GRAMS}, {_SETS} select a.id as a, b.id as b, count(*) as overlap from flat a join flat b on a.g = b.g and a.side = 0 and b.side = 0 and a.id < b.id group by 1, 2 having count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9",
    "dc09_template": f"select doc_id, sha256(regexp_replace({_NORM}, '[0-9]+', '<n>', 'g')) as template from documents where regexp_matches(text, '[0-9]')",
    "dc10_number_multiset": "select doc_id, n, nums from (select doc_id, len(x) as n, array_to_string(list_sort(x), ',') as nums from (select doc_id, regexp_extract_all(text, '[0-9]+') as x from documents) t) u where n >= 2",
    "dc09_template_hits": f"with {_PROBLEMS}, masked as (select side, id, list_transform(w, lambda x: case when regexp_matches(x, '^[0-9]+(\\.[0-9]+)?$') then '<n>' else x end) as m from problems where len(alpha) >= 10 and len(nums) >= 1) select d.id as doc_id, e.id as item_id from masked d join masked e on d.m = e.m and d.side = 0 and e.side = 1",
    "dc10_number_hits": f"with {_PROBLEMS}, kept as (select side, id, list_sort(nums) as n, list_distinct(alpha) as s from problems where len(alpha) >= 10 and len(nums) >= 2) select d.id as doc_id, e.id as item_id from kept d join kept e on d.n = e.n and d.side = 0 and e.side = 1 where len(list_intersect(d.s, e.s)) >= 0.5 * len(list_distinct(list_concat(d.s, e.s)))",
    "dc13_source_rule": "select doc_id, case when source is null then 'source_missing' else 'source' end as hit from documents where source is null or source in ('src1', 'src2')",
    "dc15_dedup_sources": f"with {_KEYS} select d.id as doc_id, d.source, f.first_source from keys d join (select k, min(source) as first_source from keys where side = 0 group by k) f on f.k = d.k where d.side = 0 and d.source > f.first_source",
    "dc18_summary": f"with {_GRAMS} select d.source, count(distinct h.doc_id) as train_items, count(distinct h.item_id) as eval_items from hits h join documents d on d.doc_id = h.doc_id group by d.source",
    "dc19_verify_clean": f"with {_GRAMS} select count(*) as left_over from grams d join grams e on d.gram = e.gram and d.side = 0 and e.side = 1 where d.id not in (select doc_id from hits)",
    "dc20_first_reason": f"with {_GRAMS}, {_KEYS}, e as (select distinct d.id from keys d join keys x on d.k = x.k and d.side = 0 and x.side = 1) select doc_id, reason from (select doc_id, case when doc_id in (select id from e) then 'exact' when doc_id in (select doc_id from hits) then 'ngram13' when source = 'src1' then 'source' end as reason from documents) t where reason is not null",
    "dc21_containment": f"with {_GRAMS}, s8 as (select side, id, list_distinct(case when len(w) >= 8 then list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) else [] end) as s from texts), f8 as (select side, id, len(s) as n, unnest(s) as g from s8), p as (select a.id as doc_id, b.id as item_id, a.n, b.n as m, count(*) as shared from f8 a join f8 b on a.g = b.g and a.side = 0 and b.side = 1 group by 1, 2, 3, 4) select doc_id, item_id, shared from (select *, row_number() over (partition by doc_id order by shared desc, item_id) as r from p) t where r = 1 and shared >= 0.05 * least(n, m)",
    "dc21_containment_half": f"with {_GRAMS}, s8 as (select side, id, list_distinct(case when len(w) >= 8 then list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) else [] end) as s from texts), f8 as (select side, id, len(s) as n, unnest(s) as g from s8), p as (select a.id as doc_id, b.id as item_id, a.n, b.n as m, count(*) as shared from f8 a join f8 b on a.g = b.g and a.side = 0 and b.side = 1 group by 1, 2, 3, 4) select doc_id, item_id, shared from (select *, row_number() over (partition by doc_id order by shared desc, item_id) as r from p) t where r = 1 and shared >= 0.5 * least(n, m)",
    "dc22_informative": f"with {_GRAMS} select distinct d.id as doc_id, e.id as item_id from grams d join grams e on d.gram = e.gram and d.side = 0 and e.side = 1 where len(list_distinct(string_split(d.gram, ' '))) >= 5 and len(list_filter(string_split(d.gram, ' '), lambda x: regexp_matches(x, '^\\p{{L}}{{3,}}$'))) >= 3",
    "dc25_overlap_abort": "select doc_id from documents where doc_id in (select doc_id from labels)",
    "fn01_words": f"select doc_id, len(@words[text]) as n_words, sha256({_NORM}) as normal from documents",
    "rt06_knn_vote": "with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), n as (select a.vec_id as q, a.label as ql, b.vec_id, b.label, round(list_cosine_similarity(a.v, b.v), 9) as s from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0) select q, sum(case when label = ql then 1 else 0 end)::bigint as votes from (select *, row_number() over (partition by q order by s desc, vec_id) as r from n) t where r <= 15 group by q",
}
ORACLES = {k: for_oracle(v) for k, v in _ORACLES.items()}
