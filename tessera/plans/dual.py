"""Queries written once and rendered for Spark SQL and for the checking engine.

Markers: @h8[x] the first eight hex digits of SHA-256 as a number; @words[x] folded words;
@explode[x] a row for each element; @regex[x] a pattern literal, escaped as each dialect wants it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _marked(sql: str, name: str, render: Callable[[str], str]) -> str:
    while (at := sql.find(f"@{name}[")) >= 0:
        depth, k = 1, at + len(name) + 2
        while depth:
            depth += {"[": 1, "]": -1}.get(sql[k], 0)
            k += 1
        sql = sql[:at] + render(sql[at + len(name) + 2 : k - 1]) + sql[k:]
    return sql


def for_spark(sql: str) -> str:
    sql = _marked(sql, "h8", lambda x: f"cast(conv(substr(sha2({x}, 256), 1, 8), 16, 10) as bigint)")
    sql = _marked(sql, "words", lambda x: f"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '([\\\\p{{L}}\\\\p{{N}}_]+)', 1)")
    sql = _marked(sql, "regex", lambda x: x.replace("\\", "\\\\"))
    return _marked(sql, "explode", lambda x: f"explode({x})")


def for_oracle(sql: str) -> str:
    sql = _marked(sql, "h8", lambda x: f"cast('0x' || substr(sha256({x}), 1, 8) as bigint)")
    sql = _marked(sql, "words", lambda x: f"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')")
    sql = _marked(sql, "regex", lambda x: x)
    return _marked(sql, "explode", lambda x: f"unnest({x})")


def query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in used:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(for_spark(sql))

    return run
