"""One sample's metrics in long form: every metric family of a reference, against a prediction that may be missing.

References decide what applies: a family that a reference lacks gives no row, and a failed or missing prediction counts
as an empty one in every denominator.
"""
from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers
from ..functions.canon import Chain, financial_words, mapped
from ..functions.grids import listed
from ..functions.similarity import token_distance
from . import lookup
from .joins import USABLE

# The states of a review and of a run, and what a manifest row must tell.
REVIEW_STATES = ("draft", "human_verified", "adjudicated", "excluded")
RUN_STATES = ("success", "partial", "empty", "failed", "timeout")
REQUIRED = ("document_id", "dataset", "split", "input_kind", "source_sha256")


_normal = Chain("NFKC", (("’", "'"), ("[−–—]", "-")), "lower", unescape=True)


def normalized(text: Column) -> Column:
    """NFKC, references decoded, dashes and apostrophes plain, white space single, small letters."""
    return mapped(_normal, text)


def contract_errors(manifest: DataFrame, references: DataFrame, predictions: DataFrame) -> DataFrame:
    """(side, id, problem) of everything that breaks the contract of the three tables; none if they keep it.

    ``manifest`` has id and REQUIRED, ``references`` id, review_status and text, ``predictions`` parser, id, status and
    source_sha256.
    """
    row = lambda df, side, problem, where: df.filter(where).select(F.lit(side).alias("side"), F.col("id").cast("string").alias("id"), F.lit(problem).alias("problem"))
    parts = [
        row(manifest, "manifest", "no id", "id is null"), row(references, "reference", "no id", "id is null"), row(predictions, "prediction", "no parser", "coalesce(parser, '') = ''"),
        row(manifest, "manifest", "source_sha256 is no digest", ~F.coalesce(F.col("source_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))),
        *[row(manifest, "manifest", f"no {c}", F.col(c).isNull()) for c in REQUIRED if c != "source_sha256"],
        row(references, "reference", "unknown review status", ~F.col("review_status").isin(*REVIEW_STATES)), row(references, "reference", "empty text", F.trim("text") == ""),
        row(predictions, "prediction", "unknown status", ~F.coalesce(F.col("status").isin(*RUN_STATES), F.lit(False))),
        # A null id is no other's: it can occur twice, and a prediction's can't be in the manifest.
        *[row(df.filter("id is null").groupBy(*keys).agg(F.count("*").alias("n")), side, "duplicate key", "n > 1") for df, side, keys in ((manifest, "manifest", ["id"]), (references, "reference", ["id"]), (predictions, "prediction", ["parser", "id"]))],
        row(predictions, "prediction", "not in the manifest", "id is null"), _by_id(manifest, references, predictions),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_id(manifest: DataFrame, references: DataFrame, predictions: DataFrame) -> DataFrame:
    """(side, id, problem) of what the rows of an id say of each other: the three tables meet in one shuffle, and an id
    gathers no more than its predictions."""
    none = F.lit(None).cast("string")
    tagged = lambda df, side, parser, sha: df.filter("id is not null").select("id", F.lit(side).alias("__s"), parser.alias("__p"), sha.alias("__h"))
    sha = F.col("source_sha256")
    rows = tagged(manifest, "m", none, sha).unionByName(tagged(references, "r", none, none)).unionByName(tagged(predictions, "p", F.col("parser"), sha))
    n = lambda side: F.count_if(F.col("__s") == side)
    said = F.when(F.col("__s") == "p", F.struct(F.col("__p").alias("parser"), F.col("__h").alias("sha")))
    met = rows.groupBy("id").agg(n("m").alias("m"), n("r").alias("r"), F.min(F.when(F.col("__s") == "m", F.col("__h"))).alias("h"), F.collect_list(said).alias("p"))
    problem = lambda side, text: F.struct(F.lit(side).alias("side"), F.lit(text).alias("problem"))
    when = lambda where, side, text: F.when(where, F.array(problem(side, text)))
    h, parsers = F.col("h"), F.transform("p", lambda p: p["parser"])
    twice = F.filter(F.array_distinct(parsers), lambda x: F.size(F.filter(parsers, lambda y: y.eqNullSafe(x))) > 1)
    wrong = F.filter("p", lambda p: h.isNull() | ~p["sha"].eqNullSafe(h))
    found = F.flatten(F.array_compact(F.array(
        when(F.col("m") > 1, "manifest", "duplicate key"), when(F.col("r") > 1, "reference", "duplicate key"), when((F.col("m") > 0) & (F.col("r") == 0), "reference", "missing"), when((F.col("m") == 0) & (F.col("r") > 0), "reference", "not in the manifest"),
        F.transform(twice, lambda _: problem("prediction", "duplicate key")), F.transform(wrong, lambda _: F.when(h.isNull(), problem("prediction", "not in the manifest")).otherwise(problem("prediction", "source hash mismatch"))))))
    return met.select(F.col("id").cast("string").alias("id"), F.explode(found).alias("f")).select("f.side", "id", "f.problem")


def text_counts(g: str, p: str) -> list[tuple[str, float, float]]:
    """(metric, numerator, denominator) of word errors, order and characters of two normalised texts."""
    a = financial_words(g)
    b = financial_words(p) if p != g else a
    edits, letters, longest = token_distance(a, b), token_distance(g, p), max(len(g), len(p))
    if a == b or not a or not b:
        ordered = len(a) if a == b else 0
    elif a[: len(b)] == b:  # the longest match is all of the shorter text
        ordered = len(b)
    else:
        ordered = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return [("word_error_rate", edits, len(a)), ("text_accuracy", max(0, len(a) - edits), len(a)), ("reading_order_accuracy", ordered, len(a)), ("character_similarity", max(0, longest - letters), longest)]


def bag_counts(expected: Iterable, predicted: Iterable) -> tuple[int, int, int]:
    """(tp, n_expected, n_predicted) of two bags."""
    e, p = Counter(expected), Counter(predicted)
    return (e & p).total(), e.total(), p.total()


def counts(expected: str | None, text: str, operands: list[str] | None) -> list[tuple[str, float, float]]:
    """What a reference's text and operands say of a prediction's text; a family that the reference lacks says nothing."""
    out = []
    if expected is not None:
        out += text_counts(_normal(expected), _normal(text))
        tp, e, p = bag_counts(numbers.amounts(expected), numbers.amounts(text))
        if e or p:
            out += [("numeric_precision", tp, p), ("numeric_recall", tp, e), ("numeric_f1", 2 * tp, e + p)]
    if operands:
        tp, e, _ = bag_counts(map(numbers.amount_of, operands), map(numbers.amount_of, numbers.amounts(text)))
        out.append(("arithmetic_operand_retention", tp, e))
    return out


_METRICS = {"metric": pa.string(), "numerator": pa.float64(), "denominator": pa.float64()}


def sample_counts(expected: Column, text: Column, operands: Column) -> Column:
    """array<struct<metric,numerator,denominator>> of `counts` of each row."""

    @F.arrow_udf("array<struct<metric:string,numerator:double,denominator:double>>")
    def run(golds: pa.Array, gots: pa.Array, many: pa.Array) -> pa.Array:
        rows = [counts(*x) for x in zip(golds.to_pylist(), gots.to_pylist(), many.to_pylist())]
        flat = [x for r in rows for x in r]
        return listed(rows, {"metric": [x[0] for x in flat], "numerator": [float(x[1]) for x in flat], "denominator": [float(x[2]) for x in flat]}, _METRICS)

    return run(expected, text, operands)


def sample_metrics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, numerator, denominator, value) of samples with a status, and with expected and predicted text,
    critical spans and operands; a null expectation doesn't apply.

    ``samples`` has keys, status, text, expected_text, critical_spans array<string>, operands array<string>.  Each sample
    is measured by itself, in one pass and without a shuffle.
    """
    usable = F.coalesce(F.col("status").isin(*USABLE), F.lit(False))
    rows = samples.select(*keys, "status", F.when(usable, F.coalesce("text", F.lit(""))).otherwise("").alias("text"), "expected_text", "critical_spans", "operands")
    one = lambda name, n, d: F.array(F.struct(F.lit(name).alias("metric"), n.cast("double").alias("numerator"), d.cast("double").alias("denominator")))
    none = F.array().cast("array<struct<metric:string,numerator:double,denominator:double>>")
    status = one("run_success_rate", (F.col("status") == "success").cast("int"), F.lit(1))
    spans = F.filter(F.transform("critical_spans", lookup.norm), lambda s: s != "")
    ready = rows.withColumn("__p", normalized(F.col("text")))
    held = F.size(F.filter(spans, lambda s: lookup.contains(F.col("__p"), s)))
    critical = F.when(F.size("critical_spans") > 0, one("critical_span_recall", held, F.size(spans))).otherwise(none)
    measured = ready.select(*keys, F.explode(F.concat(status, critical, sample_counts(F.col("expected_text"), F.col("text"), F.col("operands")))).alias("m"))
    out = measured.select(*keys, "m.*")
    # No predictions for a reference that isn't empty are wrong, not inapplicable.
    value = F.when((F.col("metric") == "numeric_precision") & (F.col("denominator") == 0), 0.0).otherwise(F.try_divide("numerator", "denominator"))
    return out.withColumn("value", value)
