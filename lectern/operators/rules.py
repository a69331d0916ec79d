"""Rule extraction: prioritised patterns give candidates with evidence; the highest priority resolves."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import coalesce_decisions, resolve  # noqa: F401


@dataclass(frozen=True)
class Rule:
    field: str
    pattern: str
    priority: int
    group: int = 1


def candidates(docs: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """(key, field, value, priority, quote): every match of every rule; built-in expressions only."""
    def of(r: Rule) -> Column:
        quotes = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({r.pattern})"), F.lit(1))
        return F.transform(quotes, lambda q: F.struct(F.lit(r.field).alias("field"), F.trim(F.regexp_extract(q, r.pattern, r.group)).alias("value"), F.lit(r.priority).alias("priority"), q.alias("quote")))

    found = [of(r) for r in rules]
    return docs.select(key, F.explode(F.concat(*found)).alias("c")).select(key, "c.*").filter("value <> ''")


def decisions(docs: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """(key, field, status, value, n_values) for every document and field; no candidate is ``not_found``."""
    fields = sorted({r.field for r in rules})
    resolved = resolve(candidates(docs, key, text, rules), [key, "field"], "value", "priority")
    wanted = docs.select(key).distinct().withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    out = wanted.join(resolved, [key, "field"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("not_found"))).withColumn("n_values", F.coalesce("n_values", F.lit(0)))


def locate(text: Column, quote: Column) -> Column:
    """Evidence check: ``verified`` if the quote occurs once, else ``missing`` or ``repeated``."""
    times = F.when(F.length(quote) > 0, (F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).otherwise(0)
    return F.when(times == 0, "missing").when(times == 1, "verified").otherwise("repeated")


def valid_decision(status: Column, value: Column, evidence: Column) -> Column:
    """Resolved needs a value and evidence; any abstention must have neither."""
    return F.when(status == "resolved", value.isNotNull() & (F.length(evidence) > 0)).otherwise(value.isNull())


def equivalent(field: str, a: str | None, b: str | None) -> bool:
    """Equality of values; issuers regardless of case, spacing and legal form."""
    if a is None or b is None:
        return a is b
    if field == "issuer":
        fold = lambda s: re.sub(r"\b(?:inc|corp|corporation|plc|ltd|limited|sa|ag)\b|[^a-z0-9]+", " ", s.lower()).split()
        return fold(a) == fold(b)
    return a == b
