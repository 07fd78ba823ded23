"""Hash-chained logs: each record holds the hash of the one before it and its own, over both and its canonical JSON."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def canonical(*columns: str) -> Column:
    """The named columns as compact JSON in order of name, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def link(prev: str, body: str) -> str:
    return hashlib.sha256((prev + body).encode()).hexdigest()


def chained(frame: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """``frame`` (chain, order, body as text) with prev and hash, appended in order from the empty string. A chain is
    sequential by nature: each is one task's work, and is read as a stream of its rows' texts."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows, head, prevs, hashes = rows.sort_values(order), "", [], []
        for text in rows[body]:
            prevs.append(head)
            head = link(head, text)
            hashes.append(head)
        return rows.assign(prev=prevs, hash=hashes)

    frame = frame.select(chain, order, body)
    schema = T.StructType([*frame.schema.fields, T.StructField("prev", T.StringType()), T.StructField("hash", T.StringType())])
    return frame.groupBy(chain).applyInPandas(run, schema)


def verify_chain(frame: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """The records that break a chain: chain, order, broken_link (prev is not the hash before), broken_hash. In
    parallel: a record is checked with its own columns and the hash of the record before."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(chain).orderBy(order)), F.lit(""))
    checked = frame.select(chain, order, (F.col("prev") != before).alias("broken_link"), (F.col("hash") != F.sha2(F.concat("prev", body), 256)).alias("broken_hash"))
    return checked.where("broken_link or broken_hash")


