"""Canonical forms: numbers, labels and visible text, over cells rendered from the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon, numbers, text
from .registry import query, spread, table

_N = "floor(l_extendedprice)::BIGINT"
_CENTS = "lpad(((l_orderkey * 7 + l_linenumber * 13) % 100)::VARCHAR, 2, '0')"
_GROUPED = f"ltrim(format('{{:,}}', {_N}), ' ')"
#: Eight ways to write a cell, by the place of its line, and what each means.
_FORMS = f"""CASE l_linenumber % 8 WHEN 0 THEN '(' || {_GROUPED} || ')' WHEN 1 THEN '$' || {_GROUPED} || '.' || {_CENTS} WHEN 2 THEN '− ' || {_N}::VARCHAR WHEN 3 THEN {_N}::VARCHAR || ' %'
 WHEN 4 THEN '£' || {_GROUPED} || 'bn' WHEN 5 THEN '—' WHEN 6 THEN '  ' ELSE 'N/A ' || {_N}::VARCHAR END"""
_TAIL = f"CASE WHEN {_CENTS} = '00' THEN '' ELSE '.' || rtrim({_CENTS}, '0') END"


def _cells(spark, d):
    lines = table(spark, d, "lineitem")
    n, k = F.floor("l_extendedprice"), F.col("l_linenumber") % 8
    grouped = F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", ",")
    cents = F.lpad(((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 100).cast("string"), 2, "0")
    cell = (F.when(k == 0, F.concat(F.lit("("), grouped, F.lit(")"))).when(k == 1, F.concat(F.lit("$"), grouped, F.lit("."), cents)).when(k == 2, F.concat(F.lit("− "), n.cast("string")))
            .when(k == 3, F.concat(n.cast("string"), F.lit(" %"))).when(k == 4, F.concat(F.lit("£"), grouped, F.lit("bn"))).when(k == 5, "—").when(k == 6, "  ").otherwise(F.concat(F.lit("N/A "), n.cast("string"))))
    return lines.select("l_orderkey", "l_linenumber", cell.alias("cell"))


@query(f"""SELECT l_orderkey, l_linenumber, {_FORMS} AS cell,
 CASE l_linenumber % 8 WHEN 5 THEN 'dash' WHEN 6 THEN 'blank' WHEN 7 THEN 'text' ELSE 'number' END AS kind,
 CASE l_linenumber % 8 WHEN 0 THEN '-' || {_N}::VARCHAR WHEN 1 THEN {_N}::VARCHAR || {_TAIL} WHEN 2 THEN '-' || {_N}::VARCHAR WHEN 3 THEN {_N}::VARCHAR WHEN 4 THEN {_N}::VARCHAR WHEN 7 THEN 'n/a' || {_N}::VARCHAR END AS value,
 CASE l_linenumber % 8 WHEN 1 THEN '$' WHEN 4 THEN '£' WHEN 0 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' END AS currency,
 CASE l_linenumber % 8 WHEN 3 THEN '%' WHEN 4 THEN 'bn' WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' END AS suffix FROM lineitem""")
def number_keys(spark, d):
    """Eight ways to write a cell: blank, dash, text and number stay apart, and a number keeps its unit."""
    return _cells(spark, d).select("*", numbers.number_key(F.col("cell")).alias("k")).select("l_orderkey", "l_linenumber", "cell", "k.*")


@query(f"""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 8 WHEN 0 THEN '-' || {_N}::VARCHAR WHEN 1 THEN {_N}::VARCHAR || {_TAIL} WHEN 2 THEN '-' || {_N}::VARCHAR WHEN 3 THEN {_N}::VARCHAR || '%' WHEN 4 THEN {_N}::VARCHAR || 'bn' WHEN 5 THEN 'DASH' END AS value FROM lineitem""")
def cell_values(spark, d):
    cells = _cells(spark, d)
    return cells.select("l_orderkey", "l_linenumber", canon.mapped(numbers.cell_value, F.col("cell")).alias("value"))


@query()
def extract_numbers(spark, d):
    """The amounts of each document in order, as one text; DuckDB's patterns can't look behind."""
    return table(spark, d, "documents").select("doc_id", F.array_join(numbers.extract(F.col("text")), " ").alias("found"))


@query()
def number_inventory(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(canon.mapped(numbers.inventory, F.col("text"), "array<string>"), " ").alias("found"))


@query("SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS composed FROM documents")
def composed_text(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", canon.composed.column(F.col("text")).alias("composed"))


_WORDS = "list_filter(regexp_extract_all(lower('No. of ' || p_type || ' amt / the QTY ' || p_name), '[a-z0-9]+'), lambda w: w NOT IN ('of', 'the', 'and', 'or', 'in', 'at', 'by', 'for'))"


@query(f"SELECT p_partkey, array_to_string(list_transform({_WORDS}, lambda w: CASE w WHEN 'qty' THEN 'quantity' WHEN 'no' THEN 'number' WHEN 'num' THEN 'number' WHEN 'amt' THEN 'amount' ELSE w END), ' ') AS label FROM part")
def schema_labels(spark, d):
    said = F.concat(F.lit("No. of "), "p_type", F.lit(" amt / the QTY "), "p_name")
    return table(spark, d, "part").select("p_partkey", canon.schema_label_column(said).alias("label"))


@query("SELECT p_partkey, lower(p_type) AS label FROM part")
def trailing_free_labels(spark, d):
    said = F.concat(F.lit("  "), F.upper("p_type"), F.lit(" "), F.col("p_size").cast("string"), F.lit(", 2"))
    return table(spark, d, "part").select("p_partkey", canon.mapped(canon.trailing_free, said).alias("label"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name) || ' -' || p_size || ',000.5% $' || floor(p_retailprice)::BIGINT, '[a-z]+|[-+]?[0-9]+(?:[,.][0-9]+)*%?|[$€£]'), '|') AS words FROM part")
def financial_tokens(spark, d):
    said = F.concat("p_name", F.lit(" –"), F.col("p_size").cast("string"), F.lit(",000.5% [$"), F.floor("p_retailprice").cast("string"), F.lit("]"))
    return table(spark, d, "part").select("p_partkey", F.array_join(canon.mapped(canon.financial_words, said, "array<string>"), "|").alias("words"))


@query("SELECT p_partkey, 'Part ' || p_partkey || chr(10) || p_name || ' ' || p_size || chr(10) || 'see ' || p_type AS plain FROM part")
def markdown_lines(spark, d):
    said = F.concat(F.lit("## Part "), F.col("p_partkey").cast("string"), F.lit("\n\n|---|:---:|\n| **"), "p_name", F.lit("** |  | "), F.col("p_size").cast("string"), F.lit(" |\n![x](y.png)\nsee ["), "p_type", F.lit("](http://x)\n"))
    return table(spark, d, "part").select("p_partkey", canon.markdown_text(said).alias("plain"))


@query("SELECT p_partkey, lower(split_part(p_type, ' ', 1)) || ' q 1 ' || p_size || ' m £' AS label FROM part")
def row_labels(spark, d):
    """Footnote marks in four forms go; a quarter, a number with its unit and a currency become words of their own."""
    said = F.concat(F.lit("<b>"), F.split("p_type", " ")[0], F.lit("</b><sup>2</sup> 1Q [3] "), F.col("p_size").cast("string"), F.lit("m£ (a)"))
    return table(spark, d, "part").select("p_partkey", canon.mapped(canon.row_label, said).alias("label"))


@query("SELECT p_partkey, 2 * (lower(split_part(p_name, ' ', -1)) = 'bolt')::INT AS words, 1 AS numbers FROM part")
def span_counts(spark, d):
    """How often a word and an amount stand in a text whole: not in a longer word, and not before decimals or a percent."""
    said = F.concat(F.lower("p_name"), F.lit(" bolts, bolt% bolt.5 12.50 1,012.50 12.5 "), F.lower("p_name"))
    return table(spark, d, "part").select("p_partkey", text.span_count(said, "bolt").alias("words"), text.span_count(said, "12.50").alias("numbers"))
