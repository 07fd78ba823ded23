"""Text functions on columns: normal forms, words, shingles, hash buckets. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: Column) -> Column:
    """Lower case with the one expansion that case folding makes in the corpus' languages."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), r"\s+", " "))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of the folded text (null: none)."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.array().cast("array<string>"))


def spaced_words(text: Column) -> Column:
    """The same words in one string, parted by blanks (null: null)."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " ")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: a lambda over a column repeats it for each element else."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_ngrams(ws: Column, n: int) -> Column:
    """All runs of n words, joined by blanks; none for shorter texts."""
    return let(ws, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))


def shingles(ws: Column, k: int) -> Column:
    """Distinct k-word shingles; with fewer than k words the whole as one if there are three, else none."""
    return let(ws, lambda w: F.when(F.size(w) >= k, F.array_distinct(word_ngrams(w, k))).when(F.size(w) >= 3, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))


def hash8(text: Column) -> Column:
    """The first eight hex digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def hash_mod(text: Column, m: int) -> Column:
    """The whole SHA-256 modulo m, folded digit by digit."""
    digits = F.filter(F.split(F.sha2(text, 256), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("long")) % m)
