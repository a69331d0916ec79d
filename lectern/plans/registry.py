"""Queries by name, with the SQL that each is held against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counterparts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, item_id, needle) of every document: items are numbered by item_id and dealt out by doc_id, which
    has no relation to theirs; a null doc_id takes the first."""
    numbered = items.select("item_id", F.col("text").alias("needle"), (F.row_number().over(Window.orderBy("item_id", "text")) - 1).alias("__n"))
    counted = docs.select("doc_id", "text").crossJoin(F.broadcast(items.agg(F.count("*").alias("__items"))))
    dealt = counted.withColumn("__n", F.expr("pmod(coalesce(doc_id, 0), nullif(__items, 0))"))
    return dealt.join(F.broadcast(numbered), "__n").select("doc_id", "text", "item_id", "needle")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan whose files hold fewer splits than there are cores, dealt out to all of them before heavy work on
    its texts.  Large tables have splits enough and pass unchanged, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(scan: DataFrame, key: str) -> DataFrame:
    """A plain scan dealt out by a key, eight parts for each of its splits and one for each core at least.  For heavy work
    on what a key gathers, of which the few bytes that are shuffled would make few tasks; that work is then done once, as
    nothing is asked of a frame that has to be computed."""
    return scan.repartition(max(scan.sparkSession.sparkContext.defaultParallelism, 8 * scan.rdd.getNumPartitions()), key)
