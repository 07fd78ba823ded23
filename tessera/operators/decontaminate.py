"""Train-against-evaluation matches: each method is a join on keys derived from the text.

An evaluation table is small beside a corpus, but no size is assumed: no side is forced to be broadcast;
the optimizer does so where the statistics allow it. Word runs are built only for documents that hold the
first words of one of the evaluation side's runs, found by a semi-join on 64-bit hashes that loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

NGRAM, SHORT, ALPHA = 13, 8, 4


def grams13(text: Column) -> Column:
    """Word 13-grams with four words that hold a letter; a text of 8 to 12 words gives its whole sequence. They may
    repeat."""
    def of(ws: Column) -> Column:
        size = F.size(ws)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(size - NGRAM + 1, F.lit(1))), lambda i: F.slice(ws, i, NGRAM))
        lettered = F.filter(runs, lambda g: F.size(F.filter(g, lambda w: w.rlike(r"\p{L}"))) >= ALPHA)
        full = F.transform(lettered, lambda g: F.array_join(g, " "))
        return F.when(size >= NGRAM, full).when(size >= SHORT, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))

    return t.let(t.words(text), of)


def informative(gram: Column) -> Column:
    """Five distinct words, and three of letters only with three or more of them."""
    ws = F.split(gram, " ")
    return (F.size(F.array_distinct(ws)) >= 5) & (F.size(F.filter(ws, lambda w: w.rlike(r"^\p{L}{3,}$"))) >= 3)


def spread(frame: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, dealt to all of them; a larger one as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


#: Words at the start of a run that bring a document and an evaluation item together.
START = 4


def hashed_runs(ws: Column, k: int) -> Column:
    """Distinct 64-bit hashes of all runs of k words (of fewer words: none). Distinct numbers are found by hashing,
    distinct strings by comparing each with each."""
    some = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(*(F.element_at(w, i + j) for j in range(k))))
    return t.let(ws, lambda w: F.when(F.size(w) >= k, F.array_distinct(some(w))).otherwise(F.array().cast("array<bigint>")))


def with_shared_starts(docs: DataFrame, evals: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that share a run of START words with an item: all that share a longer one."""
    docs = spread(docs)
    mine = docs.select("doc_id", F.explode(hashed_runs(t.words(F.col("text")), START)).alias("start"))
    theirs = evals.select(F.explode(hashed_runs(t.words(F.col("text")), START)).alias("start")).distinct()
    near = mine.join(theirs, "start", "left_semi").select("doc_id").distinct()
    return docs.join(near, "doc_id", "left_semi")


def ngram_hits(docs: DataFrame, evals: DataFrame, max_df: int | None = None, only_informative: bool = False) -> DataFrame:
    """doc_id, item_id, gram: the smallest shared gram of each pair. max_df drops grams of more evaluation items;
    only_informative keeps pairs of which any shared gram is informative, with the smallest of these."""
    grams = evals.select("item_id", F.explode(grams13(F.col("text"))).alias("gram"))
    if only_informative:
        grams = grams.where(informative(F.col("gram")))
    if max_df is not None:
        grams = grams.join(grams.groupBy("gram").agg(F.countDistinct("item_id").alias("df")).where(F.col("df") > max_df), "gram", "left_anti")
    mine = with_shared_starts(docs.select("doc_id", "text"), evals).select("doc_id", F.explode(grams13(F.col("text"))).alias("gram"))
    return mine.join(grams, "gram").groupBy("doc_id", "item_id").agg(F.min("gram").alias("gram"))


def exact_key(text: Column) -> Column:
    """Hash of the normal form; null for texts that are shorter than 20 when stripped."""
    return F.when(F.length(F.trim(text)) >= 20, F.sha2(t.normalize_text(text), 256))


def exact_hits(docs: DataFrame, evals: DataFrame) -> DataFrame:
    return docs.select("doc_id", exact_key(F.col("text")).alias("k")).join(evals.select("item_id", exact_key(F.col("text")).alias("k")), "k").select("doc_id", "item_id")


def jaccard_join(left: DataFrame, right: DataFrame, limit: float = 0.8, k: int = 5) -> DataFrame:
    """a, b, overlap, size_a, size_b of pairs of (id, text) rows whose k-word shingle sets have a Jaccard
    similarity of ``limit`` or more.

    Equal sets are one class. Prefix filter: two such sets share one of their n - ceil(limit n) + 1 smallest
    shingles by hash; pairs of classes found there, with sizes that can match, are verified, and then hold for all
    rows of the classes. Shingles are built once: what follows reads one exchange of hashes."""

    def sets(frame: DataFrame) -> DataFrame:
        # with fewer than k words the whole is one shingle if there are three, else none
        whole = lambda w: F.when((F.size(w) >= 3) & (F.size(w) < k), F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(hashed_runs(w, k))
        s = F.array_sort(t.let(t.words(F.col("text")), whole))
        out = spread(frame.select("id", "text")).select("id", s.alias("s")).where(F.size("s") > 0)
        return out.select("id", F.xxhash64("s").alias("h"), F.size("s").alias("n"), "s").repartition("h", "n")

    def classes(frame: DataFrame, side: str) -> DataFrame:
        best = frame.groupBy("h", "n").agg(F.min(F.struct("id", "s")).alias("m"))
        return best.select(F.col("h").alias(f"h_{side}"), F.col("n").alias(f"n_{side}"), F.col("m.s").alias(f"s_{side}"))

    rows_a, rows_b = sets(left), sets(right)
    a, b = classes(rows_a, "a"), classes(rows_b, "b")
    prefix = lambda side: F.slice(f"s_{side}", F.lit(1), (F.col(f"n_{side}") - F.ceil(F.col(f"n_{side}") * limit - 1e-9) + 1).cast("int"))
    pa, pb = a.select("h_a", "n_a", F.explode(prefix("a")).alias("g")), b.select("h_b", "n_b", F.explode(prefix("b")).alias("g"))
    near = pa.join(pb, "g").where((F.col("n_b") >= limit * F.col("n_a") - 1e-9) & (F.col("n_a") >= limit * F.col("n_b") - 1e-9))
    near = near.select("h_a", "n_a", "h_b", "n_b").distinct()
    over = near.join(a, ["h_a", "n_a"]).join(b, ["h_b", "n_b"]).select("h_a", "n_a", "h_b", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("overlap"))
    over = over.where(F.col("overlap") >= limit * (F.col("n_a") + F.col("n_b") - F.col("overlap")) - 1e-9)
    ids = lambda rows, side: rows.select(F.col("id").alias(side), F.col("h").alias(f"h_{side}"), F.col("n").alias(f"n_{side}"))
    out = over.join(ids(rows_a, "a"), ["h_a", "n_a"]).join(ids(rows_b, "b"), ["h_b", "n_b"])
    return out.select("a", "b", "overlap", F.col("n_a").alias("size_a"), F.col("n_b").alias("size_b"))


#: Numbers, words and signs of a normal form, as the reference splits a problem.
_TOKEN, _NUMBER = r"([0-9]+(?:\.[0-9]+)?|[\p{L}\p{N}_]+|[-+*/^=<>()|!])", r"^[0-9]+(\.[0-9]+)?$"
ALPHABETIC, NUMBERS, NUMBERS_JACCARD = 10, 2, 0.5


def _problems(frame: DataFrame, key: str, least: int) -> DataFrame:
    """key, toks, nums (sorted), alpha: of texts with ALPHABETIC tokens of letters and ``least`` numbers or more."""
    toks = F.coalesce(F.regexp_extract_all(t.fold(F.col("text")), F.lit(_TOKEN), F.lit(1)), F.array().cast("array<string>"))
    out = frame.select(F.col(key), toks.alias("toks"))
    out = out.withColumn("nums", F.array_sort(F.filter("toks", lambda w: w.rlike(_NUMBER)))).withColumn("alpha", F.filter("toks", lambda w: w.rlike(r"^\p{L}+$")))
    return out.where((F.size("alpha") >= ALPHABETIC) & (F.size("nums") >= least))


def template_hits(docs: DataFrame, evals: DataFrame) -> DataFrame:
    """doc_id, item_id: equal token sequences with each number masked."""
    key = F.sha2(F.array_join(F.transform("toks", lambda w: F.when(w.rlike(_NUMBER), "<n>").otherwise(w)), " "), 256).alias("k")
    return _problems(docs, "doc_id", 1).select("doc_id", key).join(_problems(evals, "item_id", 1).select("item_id", key), "k").select("doc_id", "item_id")


def number_hits(docs: DataFrame, evals: DataFrame) -> DataFrame:
    """doc_id, item_id: the same multiset of numbers, and sets of alphabetic words with a similarity of 0.5 or more."""
    s = lambda frame, key, side: _problems(frame, key, NUMBERS).select(key, F.sha2(F.array_join("nums", " "), 256).alias("k"), F.array_distinct("alpha").alias(side))
    both = s(docs, "doc_id", "a").join(s(evals, "item_id", "b"), "k")
    return both.where(F.size(F.array_intersect("a", "b")) >= NUMBERS_JACCARD * F.size(F.array_union("a", "b"))).select("doc_id", "item_id")


def containment(docs: DataFrame, evals: DataFrame, limit: float = 0.5, k: int = 8) -> DataFrame:
    """doc_id, item_id, shared: the evaluation item with most shared k-word shingles (ties: the smaller id),
    if these are ``limit`` or more of the smaller set."""
    from pyspark.sql.window import Window

    s = lambda f, i: f.select(F.col(i), hashed_runs(t.words(F.col("text")), k).alias("s"))
    d, e = s(with_shared_starts(docs.select("doc_id", "text"), evals), "doc_id"), s(evals, "item_id")
    shared = d.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("g")).join(e.select("item_id", F.size("s").alias("m"), F.explode("s").alias("g")), "g").groupBy("doc_id", "item_id", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("shared"), "item_id"))).where("r = 1")
    return best.where(F.col("shared") >= limit * F.least("n", "m")).select("doc_id", "item_id", "shared")


def dedup_sources(docs: DataFrame) -> DataFrame:
    """Rows that an earlier source (by name) already holds in normal form: one aggregate over the key and a join
    with it replace a pass for each source. The same source never conflicts with itself."""
    keyed = spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", exact_key(F.col("text")).alias("k")).where("k is not null").repartition("k")
    first = keyed.groupBy("k").agg(F.min("source").alias("first_source"))
    return keyed.join(first, "k").where("source > first_source").select("doc_id", "source", "first_source")
