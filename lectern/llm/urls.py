"""URL filters: a path-template tree per host.

Variable segments become wildcards, first by their shape and then where a parent has many different children.  Then
branches are merged from the leaves to the host: children of a parent whose own children are distributed alike
(chi-square of two samples) and whose labels don't differ significantly become one branch, which pools their labels, so
that a label reaches unlabelled siblings of the same make.  A template is rejected if the smoothed share of its
labelled urls that are to be blocked is high.  Every step aggregates (host, template) counts, so that a host with any
share of the rows costs a row for each of its templates; verdicts come back to the rows by a lookup that deals out hot
keys.

Defined results: a null url, or one without ``://``, has an empty host and path; templates without labels are allowed;
repeated rows are judged alike; an empty table gives an empty table; other columns are kept only where asked for.
"""
from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, skew_lookup


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Levels of the tree; what lies deeper is one segment of the last level, told apart by its whole shape.
DEPTH = 6
#: A parent with more literal children than this gets a wildcard in their place.
MAX_CHILDREN = 12
#: Siblings are merged if their blocked shares differ by less than this z, and the distributions of their children by
#: less than the chi-square that this z stands for; rejection needs this share and so many labels.
MERGE_Z, REJECT_AT, LEAST_LABELS, PRIOR_WEIGHT = 1.64, 0.8, 3, 4.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (name, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """A segment with its variable parts as wildcards: digit runs, long hexadecimal runs, identifiers."""
    s = F.regexp_replace(segment, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?:-[0-9a-f]+)*\b", "{x}")
    return F.regexp_replace(s, r"[0-9]+", "{n}")


def template_of(path: Column) -> Column:
    """Shaped segments of a path, at most DEPTH, the last of which holds all the rest; a slash at the end makes a last
    empty one."""
    shaped = F.transform(F.split(F.substring(path, 2, 1 << 30), "/"), shape)
    rest = F.array(F.array_join(F.slice(shaped, DEPTH, 1 << 30), "/"))
    return F.when(F.size(shaped) > DEPTH, F.concat(F.slice(shaped, 1, DEPTH - 1), rest)).otherwise(shaped)


def templates(urls: DataFrame) -> DataFrame:
    """(host, template, n, labelled, blocked): counts of shaped paths; ``urls`` has host, path and blocked (null: unlabelled)."""
    return urls.select("host", template_of(F.col("path")).alias("template"), "blocked").groupBy("host", "template").agg(
        F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.sum(F.coalesce(F.col("blocked").cast("int"), F.lit(0))).alias("blocked")
    )


def generalise(counts: DataFrame) -> DataFrame:
    """Adds ``node``: the template with wildcards where its parent node has more than MAX_CHILDREN children."""
    out = counts.withColumn("node", F.array().cast("array<string>"))
    total, deepest = counts.agg(F.count("*"), F.max(F.size("template"))).first()
    for level in range(deepest or 0):
        here = F.get(F.col("template"), F.lit(level))
        parents = out.filter(here.isNotNull()).groupBy("host", "node", here.alias("__s")).agg(F.count("*").alias("__k"))
        wide = parents.groupBy("host", "node").agg(F.count("*").alias("__children"), F.sum("__k").alias("__n"))
        wide = wide.select("host", F.to_json("node").alias("__key"), (F.col("__children") > MAX_CHILDREN).alias("__wide"), "__n")
        out = skew_lookup(out.withColumn("__key", F.to_json("node")), wide, ["host", "__key"], total, "__n", F.xxhash64("template"))
        # A wildcard keeps the kind of ending, so that pages and folders stay apart.
        any_of = F.concat(F.lit("*"), F.regexp_extract(here, r"(\.[A-Za-z]{1,5})$", 1))
        part = F.when(here == "", here).when(F.col("__wide"), any_of).otherwise(here)
        out = out.withColumn("node", F.when(here.isNotNull(), F.concat("node", F.array(part))).otherwise(F.col("node"))).drop("__key", "__wide")
        out = cut(out)
    return out


def alike(a: dict[str, int], b: dict[str, int]) -> bool:
    """Whether two counts of children may come from one distribution: chi-square of two samples (Wilson-Hilferty)."""
    n, m = sum(a.values()), sum(b.values())
    free = len(a | b) - 1
    if not n or not m or not free:
        return True
    r = (m / n) ** 0.5
    chi = sum((r * a.get(k, 0) - b.get(k, 0) / r) ** 2 / (a.get(k, 0) + b.get(k, 0)) for k in a | b)
    return chi <= free * (1 - 2 / (9 * free) + MERGE_Z * (2 / (9 * free)) ** 0.5) ** 3


def agree(l: int, b: int, m: int, c: int) -> bool:
    """Whether two blocked shares, b of l labels and c of m, don't differ significantly; no labels agree with any."""
    if not l or not m:
        return True
    pooled = (b + c + 1) / (l + m + 2)
    return abs((b + 0.5) / (l + 1) - (c + 0.5) / (m + 1)) < MERGE_Z * (pooled * (1 - pooled) * (1 / l + 1 / m)) ** 0.5


def merged(children: list[tuple[str, int, int, dict[str, int]]]) -> dict[str, str]:
    """The branch of each child (name, labelled, blocked, counts of its children): each joins the first branch, from the
    largest child on, that it is like."""
    branches: list[tuple[list[str], list[int], dict[str, int]]] = []
    for name, l, b, below in sorted(children, key=lambda c: (-sum(c[3].values()), c[0])):
        for names, labels, counts in branches:
            if alike(counts, below) and agree(*labels, l, b):
                names.append(name)
                labels[:] = [labels[0] + l, labels[1] + b]
                for k, n in below.items():
                    counts[k] = counts.get(k, 0) + n
                break
        else:
            branches.append(([name], [l, b], dict(below)))
    return {name: names[0] if len(names) == 1 else f"({'|'.join(sorted(names))})" for names, *_ in branches for name in names}


def branches(leaves: DataFrame) -> DataFrame:
    """Adds ``pattern`` to (host, node, n, l, b) leaves: the node with merged branches, from the last level to the first.

    Children are compared by the next two levels below them.  A parent has at most MAX_CHILDREN literal children and a
    few wildcards, and so has each of them, so that what a parent gathers is bounded, whatever its rows.
    """
    out = leaves.withColumn("pattern", F.col("node"))
    total = leaves.count()
    last = leaves.agg(F.max(F.size("node"))).first()[0] or 0
    for level in range(last - 1, -1, -1):
        up, here, below = F.to_json(F.slice("node", 1, level)), F.get("node", F.lit(level)), F.to_json(F.slice("pattern", level + 2, 2))
        keyed = out.withColumns({"__up": up, "__here": here})
        counts = keyed.filter("__here is not null").groupBy("host", "__up", "__here", below.alias("__below")).agg(*[F.sum(c).alias(c) for c in "nlb"], F.count("*").alias("rows"))

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            groups = [(str(name), int(g["l"].sum()), int(g["b"].sum()), dict(zip(g["__below"], map(int, g["n"])))) for name, g in pdf.groupby("__here")]
            into = merged(groups)
            rows = pdf.groupby("__here", as_index=False)["rows"].sum()
            return pd.DataFrame({"host": pdf["host"].iloc[0], "__up": pdf["__up"].iloc[0], "__here": rows["__here"], "__into": rows["__here"].map(into), "rows": rows["rows"]})

        chosen = counts.groupBy("host", "__up").applyInPandas(choose, "host string, __up string, __here string, __into string, rows long")
        step = skew_lookup(keyed, chosen, ["host", "__up", "__here"], total, "rows", F.xxhash64("node"))
        renamed = F.concat(F.slice("pattern", 1, level), F.array("__into"), F.slice("pattern", level + 2, DEPTH))
        out = cut(step.withColumn("pattern", F.when(F.col("__into").isNotNull(), renamed).otherwise(F.col("pattern"))).select("host", "node", "n", "l", "b", "pattern"))
    return out


def judged_templates(counts: DataFrame) -> DataFrame:
    """(host, template, n, pattern, purity, template_verdict) of every template."""
    nodes = generalise(counts)
    leaves = cut(nodes.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("rows")))
    everything = leaves.agg(F.sum("l").alias("l"), F.sum("b").alias("b")).first()
    prior = float((everything["b"] or 0) + 1) / float((everything["l"] or 0) + 2)
    # Prefixes of merged branches are equal texts, so that equal patterns pool their labels.
    named = branches(leaves.drop("rows")).withColumn("pattern", F.concat(F.lit("/"), F.array_join("pattern", "/")))
    pooled = named.groupBy("host", "pattern").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.count("*").alias("k"))
    purity = (F.col("b") + PRIOR_WEIGHT * prior) / (F.col("l") + PRIOR_WEIGHT)
    reject = (purity >= REJECT_AT) & (F.col("l") >= LEAST_LABELS)
    pooled = pooled.select("host", "pattern", purity.alias("purity"), F.when(reject, "block").otherwise("allow").alias("template_verdict"), "k")
    total = leaves.count()
    keyed = named.select("host", F.to_json("node").alias("__key"), "pattern", F.xxhash64("node").alias("__node"))
    judged = skew_lookup(keyed, pooled, ["host", "pattern"], total, "k", F.col("__node")).drop("__node").join(leaves.select("host", F.to_json("node").alias("__key"), "rows"), ["host", "__key"])
    rows = nodes.select("host", F.to_json("template").alias("template"), "n", F.to_json("node").alias("__key"))
    return skew_lookup(rows, judged, ["host", "__key"], counts.count(), "rows", F.xxhash64("template")).drop("__key")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern, purity) of every row.  Urls that a rule fits are the labelled ones."""
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    rows = rows.select("__id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    rows = rows.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = cut(rows.select("__id", "host", "path", F.col("__rule.name").alias("rule"), F.col("__rule.verdict").alias("__said")))
    counts = cut(templates(rows.select("host", "path", (F.col("__said") == "block").alias("blocked"))))
    found = cut(judged_templates(counts))
    keyed = rows.withColumn("template", F.to_json(template_of(F.col("path"))))
    out = skew_lookup(keyed, found, ["host", "template"], rows.count(), "n", F.monotonically_increasing_id())
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__said", "template_verdict", F.lit("allow")).alias("verdict"), "pattern", "purity")

