"""Retrieval, text and number queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers, similarity, text
from ..operators import chunks, ranking, retrieval
from .registry import query, spread, table

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TERMS = "list_filter(regexp_extract_all(translate(replace(lower(coalesce({0}, '')), 'ß', 'ss'), 'ςſ', 'σs'), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN (" + _STOP + "))"


def _bm25_sql(where: str = "true", k: int = 3) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents WHERE {where}),
s AS (SELECT count(*) AS n, greatest(1, avg(len(t))) AS mean FROM d),
p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0) WHERE rank <= {k}"""


@query(_bm25_sql())
def bm25_topk(spark, d):
    return ranking.bm25(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", 3)


@query(_bm25_sql("lang = 'en'"))
def bm25_filtered_lang(spark, d):
    """The filter comes first: statistics are those of the eligible documents."""
    return ranking.bm25(spread(table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "text")), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", 3)


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)"
_CHUNKS = f"(SELECT doc_id * 100000 + n AS chunk, doc_id, n, line AS text, length(line) + 1 AS size, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1)::BIGINT AS start FROM {_LINES})"


def _chunk_id(n):
    return F.col("doc_id") * 100000 + n + 1


def _line_chunks(spark, d):
    """(chunk, text): the lines of a document as its chunks, which cover it without a gap."""
    lines = _split_texts(spark, d).select("doc_id", F.posexplode("l").alias("n", "text"))
    return lines.select(_chunk_id(F.col("n")).alias("chunk"), "text")


def _split_texts(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text").filter("text is not null")).select("doc_id", F.split("text", "\n", -1).alias("l"))


def _spans(spark, d, top):
    """Adds doc_id, start and end to chunks (chunk) that are few: only their lines' places are worked out."""
    ids = _split_texts(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.size("l") - 1)).alias("n"))
    met = ids.withColumn("chunk", _chunk_id(F.col("n"))).join(F.broadcast(top), "chunk").distinct()
    rows = _split_texts(spark, d).join(F.broadcast(met), "doc_id").filter(F.col("n") < F.size("l"))
    before = F.aggregate(F.slice("l", F.lit(1), F.col("n")), F.lit(0).cast("long"), lambda at, x: at + F.length(x) + 1)
    return rows.withColumn("start", before).select(*met.columns, "start", (F.col("start") + F.length(F.get("l", F.col("n"))) + 1).alias("end"))


_TOP = f"""WITH c AS MATERIALIZED {_CHUNKS}, d AS (SELECT chunk AS doc_id, {_TERMS.format('text')} AS t FROM c),
s AS (SELECT count(*) AS n, greatest(1, avg(len(t))) AS mean FROM d),
p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
top AS (SELECT item_id, doc_id AS chunk, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0) WHERE rank <= 3),
e AS (SELECT item_id, doc_id, (instr(d.text, b.text) - 1)::BIGINT AS first, length(b.text) AS size FROM documents d JOIN benchmark b ON contains(d.text, b.text)
  WHERE instr(substr(d.text, instr(d.text, b.text) + 1), b.text) = 0),
met AS (SELECT e.item_id, e.doc_id, e.size, rank, CASE WHEN c.chunk IS NULL THEN 0 ELSE greatest(0, least(first + e.size, start + c.size) - greatest(first, start)) END AS part FROM e LEFT JOIN top USING (item_id) LEFT JOIN c ON c.chunk = top.chunk AND c.doc_id = e.doc_id)
SELECT item_id, doc_id, coalesce(sum(part) FILTER (rank = 1), 0) >= any_value(size) AS hit_at_1, coalesce(sum(part), 0) >= any_value(size) AS hit_at_3 FROM met GROUP BY item_id, doc_id"""


@query(_TOP)
def retrieval_hits(spark, d):
    """Whether the best one and three line chunks of each item cover the place where a document holds its text once."""
    chunks_, items = _line_chunks(spark, d), table(spark, d, "benchmark")
    top = ranking.bm25(chunks_, "chunk", "text", items, "item_id", "text", 3)
    probes = retrieval.sites(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", items.withColumnRenamed("text", "quote"), "item_id", "quote")
    return retrieval.hits(probes, _spans(spark, d, top), "item_id", "doc_id", [1, 3])


@query(f"""WITH h AS ({_TOP}), r AS (SELECT h.*, d.lang AS cohort, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS scope FROM h JOIN documents d USING (doc_id))
SELECT scope, cohort, count(*) AS queries, count(*) FILTER (hit_at_1) AS hit_at_1, count(*) FILTER (hit_at_3) AS hit_at_3 FROM r GROUP BY scope, cohort
UNION ALL SELECT scope, 'all', count(*), count(*) FILTER (hit_at_1), count(*) FILTER (hit_at_3) FROM r GROUP BY scope""")
def retrieval_by_cohort(spark, d):
    """Hits by scope and by cohort, over which the cohort of all lies."""
    rows = retrieval_hits(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("cohort")), "doc_id")
    return retrieval.by_cohort(rows.withColumn("scope", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")), ["scope"], "cohort", ["hit_at_1", "hit_at_3"])


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS norm FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("norm"))


@query()
def normalize_unicode(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalized(F.col("text")).alias("norm"))


@query("SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z]+|[0-9]+(?:[.,][0-9]+)*|[$%])') AS t FROM documents)")
def word_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def unicode_terms(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(ranking.terms(F.col("text"))).alias("term"))
    per = t.groupBy("doc_id", "term").agg(F.count("*").alias("n"))  # two steps, so that no distinct set is held
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query("SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') AS compact, regexp_replace(text, '\\n([ \\t]*\\n)+', chr(10) || chr(10), 'g') AS squeezed FROM documents")
def compact_and_squeeze(spark, d):
    return table(spark, d, "documents").select("doc_id", text.compact(F.col("text")).alias("compact"), text.squeeze_blank_lines(F.col("text")).alias("squeezed"))


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest, (strlen(coalesce(text, '')) + 1024)::INT AS token_bound FROM documents")
def sha256_identity(spark, d):
    return table(spark, d, "documents").select("doc_id", text.lf_digest(F.col("text")).alias("digest"), text.utf8_token_estimate(F.col("text")).alias("token_bound"))


@query("SELECT p_partkey, contains(' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || lower(split_part(p_type, ' ', 1)) || ' ') AS hit, contains(' ' || trim(regexp_replace(lower(p_name || '-' || p_type), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || lower(split_part(p_name, ' ', -1)) || ' ' || lower(split_part(p_type, ' ', 1)) || ' ') AS across FROM part")
def phrase_containment(spark, d):
    """Whether a part's name holds the first word of its type; and whether both together hold the words where they meet."""
    first, last = F.split("p_type", " ")[0], F.element_at(F.split("p_name", " "), -1)
    return table(spark, d, "part").select("p_partkey", text.contains_phrase(F.col("p_name"), first).alias("hit"), text.contains_phrase(F.concat_ws("-", "p_name", "p_type"), F.concat_ws(" ", last, first)).alias("across"))


@query("SELECT event_id, event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_pointer_props(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


_MONEY = "case when l_linenumber % 4 = 0 then '(' || {0} || ')' when l_linenumber % 4 = 1 then '$' || {0} when l_linenumber % 4 = 2 then '-' || {0} else {0} || '%' end"


def _money():
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber") % 4
    return F.when(n == 0, F.concat(F.lit("("), q, F.lit(")"))).when(n == 1, F.concat(F.lit("$"), q)).when(n == 2, F.concat(F.lit("-"), q)).otherwise(F.concat(q, F.lit("%")))


@query(f"""SELECT l_orderkey, l_linenumber, {_MONEY.format("l_quantity::INT::VARCHAR")} AS cell, 'number|' || (case when l_linenumber % 4 in (0, 2) then -l_quantity::INT else l_quantity::INT end)::VARCHAR || '|' || (case when l_linenumber % 4 = 3 then '%' else '' end) AS key FROM lineitem""")
def amount_key(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _money().alias("cell"))
    return rows.withColumn("key", numbers.amount_key(F.col("cell")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, case when day(o_orderdate) > 12 or day(o_orderdate) = month(o_orderdate) then strftime(o_orderdate, '%Y-%m-%d') end AS slashed, strftime(o_orderdate, '%Y-%m-%d') AS named, strftime(o_orderdate, '%Y-%m-%d') AS american FROM orders")
def parse_dates_ambiguous(spark, d):
    o, day = spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate")), F.col("o_orderdate")
    shown = {"day": "yyyy-MM-dd", "slashed": "dd/MM/yyyy", "named": "d MMMM yyyy", "american": "MMMM d, yyyy"}
    return o.select("o_orderkey", *[dates.parse(F.date_format(day, f)).alias(c) for c, f in shown.items()])


@query("SELECT user_id, count(*) FILTER (age < 0) AS future, count(*) FILTER (age >= 604800000000) AS stale, count(*) FILTER (age >= 0 AND age < 604800000000) AS fresh FROM (SELECT user_id, epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) AS age FROM events) GROUP BY user_id")
def staleness_interval(spark, d):
    e = table(spark, d, "events").select("user_id", dates.staleness(F.col("ts"), F.expr("timestamp '2024-01-15 00:00:00'")).alias("s"))
    return e.groupBy("user_id").agg(*[F.count(F.when(F.col("s") == k, 1)).alias(k) for k in ("future", "stale", "fresh")])


@query("SELECT l_orderkey, l_linenumber, ((l_extendedprice::DECIMAL(28,6) - l_quantity::DECIMAL(28,6))::DECIMAL(28,2))::VARCHAR AS net FROM lineitem")
def decimal_subtract(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.subtract(F.col("l_extendedprice"), F.col("l_quantity")).cast("decimal(28,2)").cast("string").alias("net"))


#: DuckDB's distance counts bytes: letters of two bytes change places with unused characters of one, which changes no distance.
_TWO_BYTES = "ÀÂÄÇÈÉÊÑÖÜßàâäçèéêíñóöüáú"
_ONE_BYTE = " || ".join(f"chr({i})" for i in [*range(1, 9), 11, 12, *range(14, 32)][: len(_TWO_BYTES)])
_BYTES = f"(SELECT item_id, translate(text, '{_TWO_BYTES}', {_ONE_BYTE}) AS text FROM benchmark)"


@query(f"SELECT a.item_id, b.item_id AS other_id, levenshtein(a.text, b.text)::INT AS distance, round(1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)), 6) AS similarity, round(levenshtein(a.text, b.text) / length(a.text), 6) AS cer FROM {_BYTES} a JOIN {_BYTES} b ON b.item_id = a.item_id + 1")
def levenshtein_titles(spark, d):
    """Distance, similarity and error rate of the whole texts, in characters of any script."""
    b = table(spark, d, "benchmark")
    a, o = b.select("item_id", F.col("text").alias("a")), b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other_id"), F.col("text").alias("b"))
    return a.join(o, "item_id").select("item_id", "other_id", F.levenshtein("a", "b").alias("distance"), F.round(similarity.edit_ratio(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(similarity.error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


_PAIR = "(SELECT a.item_id, string_split(a.text, ' ') AS x, string_split(b.text, ' ') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"
_AS_BYTES = "array_to_string(list_transform({0}, lambda w: chr(list_position(list_distinct(list_concat(x, y)), w)::INT)), '')"


@query(f"SELECT item_id, round(levenshtein({_AS_BYTES.format('x')}, {_AS_BYTES.format('y')}) / len(x), 6) AS wer FROM (SELECT item_id, list_filter(x, lambda w: w <> '') AS x, list_filter(y, lambda w: w <> '') AS y FROM (SELECT item_id, string_split_regex(array_to_string(x, ' '), '\\s+') AS x, string_split_regex(array_to_string(y, ' '), '\\s+') AS y FROM {_PAIR}))")
def token_wer(spark, d):
    """Word error rates; the SQL writes each word of a pair as one byte, of which there are enough."""
    b = table(spark, d, "benchmark")
    a, o = b.select("item_id", F.col("text").alias("a")), b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"))
    return a.join(o, "item_id").select("item_id", F.round(similarity.wer(F.col("a"), F.col("b")), 6).alias("wer"))


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(text) AS digest, true AS contiguous FROM documents WHERE length(coalesce(text, '')) > 0")
def chunk_lossless(spark, d):
    """The chunks of a text, joined in order, are the text; each starts where the one before ended."""
    c = chunks.chunk_documents(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    per = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end", "content"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["content"]), "")
    follows = F.forall(F.sequence(F.lit(1), F.size("c")), lambda i: F.element_at("c", i)["start"] == F.coalesce(F.get("c", i - 2)["end"], F.lit(0)))
    return per.select("doc_id", F.length(joined).cast("long").alias("n_chars"), F.sha2(joined, 256).alias("digest"), follows.alias("contiguous"))


@query()
def chunk_sections(spark, d):
    return chunks.chunk_documents(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", content=False).select("doc_id", "ordinal", "start", "end", "content_tokens", "indexable", "chunk_id")


@query(f"""WITH RECURSIVE top AS ({_bm25_sql(k=10)}), t AS (SELECT item_id, doc_id, score, rank, strlen(text) // 4 AS tokens FROM top JOIN documents USING (doc_id)),
p AS (SELECT item_id, 0 AS rank, 3072::BIGINT AS room, 0 AS n, NULL::BIGINT AS doc_id, NULL::DOUBLE AS score, NULL::BIGINT AS tokens, false AS taken FROM (SELECT DISTINCT item_id FROM t) UNION ALL
SELECT t.item_id, t.rank, p.room - CASE WHEN t.tokens <= p.room AND p.n < 3 THEN t.tokens ELSE 0 END, p.n + (t.tokens <= p.room AND p.n < 3)::INT, t.doc_id, t.score, t.tokens, t.tokens <= p.room AND p.n < 3 FROM p JOIN t ON t.item_id = p.item_id AND t.rank = p.rank + 1)
SELECT item_id, doc_id, score, rank, tokens::INT AS tokens, taken FROM p WHERE rank > 0""")
def budget_pack(spark, d):
    """Of the ten best documents of an item, the first three that fit into 3,072 tokens together."""
    top = ranking.bm25(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", 10)
    sized = F.broadcast(top).join(table(spark, d, "documents").select("doc_id", F.floor(F.octet_length("text") / 4).cast("int").alias("tokens")), "doc_id")
    return chunks.pack(sized, "item_id", "rank", "tokens", 3072, 3)
