"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontam, html_mincut, langid, quality, quotes, sharding, simhash, toxicity, urls
from .common import table

RULES = [
    urls.Rule("com", "/en/", "block"),
    urls.Rule("example.com", "/en/7", "allow"),
    urls.Rule("net", "/de/", "allow"),
    urls.Rule("example.net", "/de/8", "block"),
    urls.Rule("org", "/es/", "block"),
]
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_byte_bpe, op3_chat_quotes, op4_quality_rules, op5_toxicity, op6_language_id, op7_html_extraction, op8_decontamination, op9_simhash_dedup, op10_sharding)}

_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' +', ' ', 'g'))"
_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"

#: DuckDB SQL; the other operators learn, align or hash in ways that SQL can't express, and are tested by brute force.
ORACLES = {
    # Every quoted passage, and each of its lines, against every earlier text of its conversation.
    "op3_chat_quotes": rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM conversations),
l AS (SELECT id, conv_id, turn, generate_subscripts(a, 1) AS i, unnest(a) AS raw FROM (SELECT *, string_split(t, chr(10)) AS a FROM m)),
p AS (SELECT *, length(regexp_replace(regexp_extract(raw, '^[ \t]*((?:>[ \t]?)*)', 1), '[ \t]', '', 'g'))::INT AS level, trim(regexp_replace(raw, '^[ \t]*((?:>[ \t]?)*)', '')) AS line FROM l),
n AS (SELECT *, lead(level) OVER w AS l1, lead(line) OVER w AS n1, lead(level, 2) OVER w AS l2 FROM p WINDOW w AS (PARTITION BY id ORDER BY i)),
a AS (SELECT *, regexp_matches(line, '^(?:On .* wrote|.* (?:wrote|said|schrieb|escribió|a écrit)) ?:$') AND coalesce(l1 > level OR n1 = '' AND l1 <= level AND l2 > level, false) AS announces FROM n),
own AS (SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, max(level) AS quote_levels, regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (level = 0 AND NOT announces), ''), '^(?:[ \t]*\n)+|\s+$', '', 'g') AS text FROM a GROUP BY id),
v AS (SELECT *, CASE WHEN regexp_matches(line, '^[\[(]?[ .…]*(?:\.{{3}}|…)[ .…]*[\])]?$') THEN 0 ELSE level END AS lv FROM a WHERE NOT announces AND conv_id IS NOT NULL AND turn IS NOT NULL),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(lv) OVER (PARTITION BY id ORDER BY i) = lv THEN 0 ELSE 1 END AS new FROM v)),
q AS (SELECT id, conv_id, turn, run, true AS whole, {_NORM.format("string_agg(line, ' ' ORDER BY i)")} AS w FROM g WHERE lv > 0 GROUP BY ALL UNION ALL SELECT id, conv_id, turn, run, false, {_NORM.format('line')} FROM g WHERE lv > 0),
met AS (SELECT q.id, q.conv_id, q.turn, q.run, whole, len(string_split(w, ' ')) AS words, max(o.turn) AS author FROM q JOIN own o ON o.conv_id = q.conv_id AND o.turn < q.turn AND contains(' ' || {_NORM.format('o.text')} || ' ', ' ' || w || ' ') WHERE w <> '' GROUP BY q.id, q.conv_id, q.turn, q.run, whole, w),
best AS (SELECT conv_id, turn, author FROM met QUALIFY row_number() OVER (PARTITION BY id, run ORDER BY whole DESC, words DESC, author DESC) = 1),
parents AS (SELECT conv_id, turn, max(author) AS parent_turn FROM best GROUP BY conv_id, turn),
walk AS (SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM parents UNION ALL SELECT w.conv_id, w.turn, p.parent_turn, depth + 1 FROM walk w JOIN parents p ON p.conv_id = w.conv_id AND p.turn = w.root_turn),
tree AS (SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM walk GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, o.text, o.quote_levels, parent_turn, coalesce(root_turn, m.turn) AS root_turn, coalesce(depth, 0)::INT AS depth,
'<|' || {_ESCAPED.format("coalesce(m.role, 'user')")} || '|>' || chr(10) || {_ESCAPED.format('o.text')} || chr(10) || '<|end|>' || chr(10) AS formatted
FROM m JOIN own o USING (id) LEFT JOIN parents p ON p.conv_id = m.conv_id AND p.turn = m.turn AND o.quote_levels > 0 LEFT JOIN tree r ON r.conv_id = m.conv_id AND r.turn = m.turn AND o.quote_levels > 0
""",
    "op10_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
       array_to_string(list_transform(range(1, {sharding.BITS // 4 + 1}), lambda i: lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), i, 1))::INT), 4, '0')), '') AS bits
  FROM documents),
p AS (SELECT depth, substr(bits, 1, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes
  FROM d, (SELECT unnest(range(0, {sharding.BITS + 1}))::INT AS depth) GROUP BY ALL),
leaf AS (SELECT c.* FROM p c LEFT JOIN p u ON u.depth = c.depth - 1 AND u.shard = substr(c.shard, 1, c.depth - 1)
  WHERE (c.shard_bytes <= {sharding.SHARD_BYTES} OR c.depth = {sharding.BITS}) AND (c.depth = 0 OR u.shard_bytes > {sharding.SHARD_BYTES}))
SELECT doc_id, shard, depth, n_bytes, shard_bytes, shard_bytes > {sharding.SHARD_BYTES} AS oversized
FROM d JOIN leaf ON substr(bits, 1, depth) = shard
""",
}
