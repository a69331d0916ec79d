"""Strict scans and write-once sinks."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.joins import require_unique


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, unique: list[str] | None = None) -> DataFrame:
    """Rows of a JSONL file under an explicit schema.  The first line that is no strict JSON object is an error that tells
    its file and number; so is a key of the ``unique`` columns that comes twice."""
    if wrong := jsonl_errors(spark, path).head(1):
        file, line = wrong[0]["file"], wrong[0]["line"]
        numbered = spark.read.text(file, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n"))).filter(F.col("col") == line)
        raise ValueError(f"{file}:{numbered.agg(F.min('pos')).first()[0] + 1}: not a strict JSON object")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return require_unique(rows, unique) if unique else rows


def jsonl_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the non-blank lines that are no JSON object, or that repeat a key."""

    @F.pandas_udf("boolean")
    def bad(lines: pd.Series) -> pd.Series:
        return pd.Series([not _strict_object(x) for x in lines], dtype=bool)

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.filter(F.trim("line") != "").filter(bad("line"))


def _strict_object(text: str) -> bool:
    def pairs(items):
        if len(dict(items)) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    try:
        return isinstance(json.loads(text, object_pairs_hook=pairs, parse_constant=_reject), dict)
    except ValueError:
        return False


def _reject(name):
    raise ValueError(name)


def read_record(spark: SparkSession, path: str, schema: str, max_bytes: int) -> DataFrame:
    """One JSON record for each file; larger files, repeated keys, numbers that aren't finite, and records that don't
    fit fail the read."""

    @F.pandas_udf("boolean")
    def strict(texts: pd.Series) -> pd.Series:
        return pd.Series([_strict_object(x) for x in texts], dtype=bool)

    files = spark.read.text(path, wholetext=True)
    sized = files.select(F.when(F.octet_length("value") > max_bytes, F.raise_error(F.lit("record too large"))).otherwise(F.col("value")).alias("value"))
    sound = sized.select(F.when(~strict("value"), F.raise_error(F.lit("not one strict JSON object"))).otherwise(F.col("value")).alias("value"))
    return sound.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_once(df: DataFrame, path: str, kind: str = "json", max_bytes: int | None = None) -> None:
    """Never overwrites; Spark's commit renames files only after all were written.  Numbers that aren't finite, and JSON
    records over ``max_bytes``, are errors before anything is written."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    odd = F.greatest(*[F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False)) for c in doubles], F.lit(False), F.lit(False))
    if doubles and df.filter(odd).head(1):
        raise ValueError("a number is not finite")
    if max_bytes is not None and df.filter(F.octet_length(F.to_json(F.struct(*df.columns))) > max_bytes).head(1):
        raise ValueError("a record is too large")
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def read_ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """(page, idx, text, score) of level-5 rows of an OCR TSV; a confidence of -1 is none, one beyond 0..100 fails."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    words = rows.filter("level = 5 and trim(text) <> '' and conf <> -1")
    score = F.when((F.col("conf") < 0) | (F.col("conf") > 100) | F.isnan("conf"), F.raise_error(F.lit("confidence out of range"))).otherwise(F.col("conf") / 100)
    return words.select(F.col("page_num").alias("page"), "block_num", "line_num", "word_num", "text", score.alias("score"))


def export_pages(pages: DataFrame, document: str, page: str, markdown: str) -> DataFrame:
    """(document, n_pages, content, content_sha256, headings): pages joined in order.  A document's pages are one row's worth."""
    ordered = F.sort_array(F.collect_list(F.struct(page, markdown)))
    out = pages.groupBy(document).agg(ordered.alias("__p")).select(document, F.size("__p").alias("n_pages"), F.array_join(F.transform("__p", lambda x: x[markdown]), "\n\n").alias("content"))
    return out.withColumn("content_sha256", F.sha2(F.regexp_replace("content", "\r\n", "\n"), 256)).withColumn("headings", F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6} +(.+)$"), F.lit(1)))


def missing_pages(expected: DataFrame, done: DataFrame, document: str, n: str, page: str) -> DataFrame:
    """(document, page) of the pages 1..n that were not processed."""
    wanted = expected.filter(F.col(n) > 0).select(document, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(page))
    return wanted.join(done.select(document, page).distinct(), [document, page], "left_anti")
