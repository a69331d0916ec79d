"""Aggregation of metrics: micro, macro and document-macro means, strata, confidence summaries, reliability."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .bags import ratio
from .stats import discrete_quantile


def micro_macro(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """``rows`` has numerator, denominator and value (null: not applicable) for each sample.

    Macro weighs samples alike, micro pools counts, document-macro averages documents; nulls never enter a mean.
    """
    per_document = rows.groupBy(*keys, document).agg(
        F.sum("numerator").alias("__num"), F.sum("denominator").alias("__den"), F.sum("value").alias("__sum"), F.count("value").alias("__k"), F.avg("value").alias("__v"))
    return per_document.groupBy(*keys).agg(
        ratio(F.sum("__sum"), F.sum("__k")).alias("macro"), ratio(F.sum("__num"), F.sum("__den")).alias("micro"), F.avg("__v").alias("document_macro"),
        F.sum("__k").alias("n_samples"), F.count("__v").alias("n_documents"))


def strata(rows: DataFrame, attributes: list[str], value: str, unknown: str = "unknown") -> DataFrame:
    """One row for each value of each attribute: (attribute, stratum, n, mean); missing values count as ``unknown``."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit(unknown)).alias("stratum")) for a in attributes])
    return rows.select(F.explode(pairs).alias("s"), F.col(value).alias("__v")).groupBy("s.attribute", "s.stratum").agg(F.count("*").alias("n"), F.avg("__v").alias("mean"))


def confidence_summary(units: DataFrame, keys: list[str], score: str, weight: str, low: float = 0.9) -> DataFrame:
    """Of the non-null scores: count, mean, weighted mean, geometric mean (0 if any is 0), p10, share below low, least."""
    s, w = F.col(score), F.col(weight)
    out = units.filter(s.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(s).alias("mean"), ratio(F.sum(s * w), F.sum(w)).alias("weighted_mean"),
        F.when(F.min(s) <= 0, 0.0).otherwise(F.exp(F.avg(F.when(s > 0, F.ln(s))))).alias("geometric_mean"),
        F.avg((s < low).cast("double")).alias("share_low"), F.min(s).alias("least"))
    return out.join(discrete_quantile(units, keys, score, 0.1, "p10"), keys)


def coverage(pages: DataFrame, expected: DataFrame, document: str, page: str, n_expected: str) -> DataFrame:
    """(document, n_expected, n_done, n_missing, coverage) of page rows against expected page numbers 1..n."""
    wanted = expected.select(document, n_expected)
    done = pages.groupBy(document).agg(F.countDistinct(page).alias("n_done"))
    out = wanted.join(done, document, "left").withColumn("n_done", F.coalesce("n_done", F.lit(0)))
    return out.withColumn("n_missing", F.col(n_expected) - F.col("n_done")).withColumn("coverage", ratio(F.col("n_done"), F.col(n_expected)))


def reliability(rows: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_probability, rate, gap) for equal-width bins; the last one is closed."""
    bin_of = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(outcome).cast("double")).alias("rate"))
    return out.withColumn("gap", F.abs(F.col("mean_probability") - F.col("rate")))


def brier_ece(rows: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    p, y = F.col(probability), F.col(outcome).cast("double")
    brier = rows.agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(F.greatest(p, F.lit(1e-12))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(1e-12))))).alias("log_loss"))
    ece = reliability(rows, probability, outcome, bins).agg(ratio(F.sum(F.col("gap") * F.col("n")), F.sum("n")).alias("ece"))
    return brier.join(ece)  # one row each


def masked(value: Column, approved: list[str]) -> Column:
    """Values outside an allow-list are masked."""
    return F.when(value.isin(approved), value).otherwise(F.lit("<redacted>"))
