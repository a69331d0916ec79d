"""Boxes on pages: which meet, which belong to which region, nested ones, matches by class and their scores.

A box of side ``s`` is four columns s + x0, y0, x1, y1.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bags import ratio
from .intervals import box, greedy_match, inside, intersection, iou, overlap_join


def boxes_met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of boxes a and b of equal keys with a common area; boxes whose widths don't meet are never paired."""

    def wide(df: DataFrame, s: str) -> DataFrame:
        # Floored and one wider than the box, so that all that touch meet; the areas decide.
        return df.withColumns({f"{s}_start": F.floor(f"{s}x0"), f"{s}_end": F.floor(f"{s}x1") + 1})

    met = overlap_join(wide(left, "a"), wide(right, "b"), keys).drop("a_start", "a_end", "b_start", "b_end")
    return met.filter(intersection(box("a"), box("b")) > 0)


def padded(b: list[Column], width: Column, height: Column, share: float = 0.02) -> list[Column]:
    """A box grown by a share of its sides, in whole points, within the page; null if it is empty or off the page."""
    dx, dy = (b[2] - b[0]) * share, (b[3] - b[1]) * share
    zero = F.lit(0).cast("long")
    out = [F.greatest(zero, F.floor(b[0] - dx)), F.greatest(zero, F.floor(b[1] - dy)), F.least(F.ceil(width), F.ceil(b[2] + dx)), F.least(F.ceil(height), F.ceil(b[3] + dy))]
    good = (b[2] > b[0]) & (b[3] > b[1]) & (out[2] > out[0]) & (out[3] > out[1])
    return [F.when(good, c) for c in out]


def assign_units(units: DataFrame, regions: DataFrame, keys: list[str], unit: str, region: str, least: float = 0.5, whole: float = 0.98) -> DataFrame:
    """(keys, unit, region, share, boundary, ambiguous): each unit (box a) once, in the region (box b) that holds most of
    it and at least half; the first region of equal shares.  Units in no region give no row."""
    met = boxes_met(units, regions, keys).withColumn("share", inside(box("a"), box("b"))).filter(F.col("share") >= least)
    best = met.groupBy(*keys, unit).agg(F.max_by(F.struct(region, "share"), F.struct("share", -F.col(region))).alias("m"), F.count("*").alias("n"))
    return best.select(*keys, unit, F.col(f"m.{region}").alias(region), "m.share", (F.col("m.share") < whole).alias("boundary"), (F.col("n") > 1).alias("ambiguous"))


def drop_nested(boxes: DataFrame, keys: list[str], id_col: str, score: str, containment: float = 0.95) -> DataFrame:
    """Adds ``inside_of``: the kept box that holds almost all of this one, or null for the kept ones.

    Boxes go by area, then score, then id; one is dropped if a kept box before it holds ``containment`` of it.  The boxes
    of a page come together.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema) + f", inside_of {boxes.schema[id_col].dataType.simpleString()}"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        area = (pdf["x1"] - pdf["x0"]) * (pdf["y1"] - pdf["y0"])
        pdf = pdf.assign(__a=area).sort_values(["__a", score, id_col], ascending=[False, False, True], ignore_index=True)
        kept: list[int] = []
        held = [None] * len(pdf)
        x0, y0, x1, y1, a, ids = (pdf[c].tolist() for c in ("x0", "y0", "x1", "y1", "__a", id_col))
        for i in range(len(pdf)):
            held[i] = next((ids[k] for k in kept if a[i] and max(0, min(x1[i], x1[k]) - max(x0[i], x0[k])) * max(0, min(y1[i], y1[k]) - max(y0[i], y0[k])) >= containment * a[i]), None)
            if held[i] is None:
                kept.append(i)
        return pdf.drop(columns="__a").assign(inside_of=pd.Series(held, dtype=object))

    return boxes.groupBy(*keys).applyInPandas(choose, types)


def matches(gold: DataFrame, predicted: DataFrame, keys: list[str], label: str, threshold: float) -> DataFrame:
    """(keys, label, a, b, iou): one-to-one pairs of one class, the greatest overlap first.  Both sides have x0 to y1."""

    def numbered(df: DataFrame, s: str) -> DataFrame:
        order = Window.partitionBy(*keys, label).orderBy("x0", "y0", "x1", "y1")
        return df.select(*keys, label, F.row_number().over(order).alias(s), *[F.col(c).alias(f"{s}{c}") for c in ("x0", "y0", "x1", "y1")])

    met = boxes_met(numbered(gold, "a"), numbered(predicted, "b"), [*keys, label]).select(*keys, label, "a", "b", iou(box("a"), box("b")).alias("iou"))
    return greedy_match(met, [*keys, label], "a", "b", "iou", threshold)


def scores(gold: DataFrame, predicted: DataFrame, keys: list[str], label: str, threshold: float) -> DataFrame:
    """(label, n_gold, n_predicted, tp, precision, recall, f1, mean_iou) of each class over all pages; a class without
    predictions has precision 0, one without references no recall."""
    sizes = gold.groupBy(label).agg(F.count("*").alias("n_gold")).join(predicted.groupBy(label).agg(F.count("*").alias("n_predicted")), label, "full")
    found = matches(gold, predicted, keys, label, threshold).groupBy(label).agg(F.count("*").alias("tp"), F.sum("iou").alias("__i"))
    out = sizes.join(found, label, "left").fillna(0, ["n_gold", "n_predicted", "tp", "__i"])
    tp, g, p = F.col("tp"), F.col("n_gold"), F.col("n_predicted")
    return out.select(label, "n_gold", "n_predicted", "tp", F.coalesce(ratio(tp, p), F.lit(0.0)).alias("precision"), ratio(tp, g).alias("recall"), ratio(2 * tp, g + p).alias("f1"), F.coalesce(ratio(F.col("__i"), tp), F.lit(0.0)).alias("mean_iou"))
