"""Sequence similarity: edit distances, alignments, trees."""
from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def error_rate(expected: Column, got: Column) -> Column:
    """Character error rate; null for an empty reference with an empty answer, 1 for an empty reference otherwise."""
    n = F.length(expected)
    return F.when(n > 0, F.levenshtein(expected, got) / n).when(F.length(got) > 0, 1.0)


def _unit(x, y) -> float:
    return 0.0 if x == y else 1.0


def edits(a, b) -> int:
    """Edit distance with unit costs, the columns of the matrix as bits of one number (Myers 1999, Hyyrö 2003)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, cost = full, 0, len(a)
    for y in b:
        met = places.get(y, 0)
        x = met | down
        d = (((met & up) + up) ^ up) | met
        rise, fall = down | ~(d | up) & full, up & d
        cost += bool(rise & last) - bool(fall & last)
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(x | rise)) & full, rise & x & full
    return cost


def token_distance(a: list, b: list, substitute=_unit) -> float:
    """Edit distance of two sequences with unit gaps and a cost, not under 0, for each substitution.

    Equal beginnings and ends cost nothing.  Of equally long sequences, all alignments but the straight one have two gaps
    or more, so that a straight one for at most 2 is the best.
    """
    low, n, m = 0, len(a), len(b)
    while low < n and low < m and a[low] == b[low]:
        low += 1
    while n > low and m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[low:n], b[low:m]
    if not a or not b:
        return float(len(a) + len(b))
    if substitute is _unit:
        return float(edits(a, b))
    if len(a) == len(b):
        straight = 0.0
        for x, y in zip(a, b):
            straight += substitute(x, y)
            if straight > 2:
                break
        else:
            return straight
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            best = min(row[j], row[j - 1]) + 1
            if last < best:
                best = min(best, last + substitute(x, y))
            last, row[j] = row[j], best
    return row[-1]


def word_error_rate(expected: str, got: str) -> float | None:
    a, b = (expected or "").split(), (got or "").split()
    return token_distance(a, b) / len(a) if a else (1.0 if b else None)


def wer(expected: Column, got: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([word_error_rate(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(expected, got)


def best_window(needle: list, hay: list) -> tuple[int, int, int]:
    """(distance, start, end) of the window that the needle aligns to at least cost.

    Of equal costs a step on both sides comes first, then one in the needle, then one in the window; of equal windows the
    one whose length is nearest the needle's, then the first.
    """
    known: dict = {}
    ids = np.fromiter((known.setdefault(y, len(known)) for y in hay), np.int64, len(hay))
    at = np.arange(len(hay) + 1)
    cost, start = np.zeros(len(hay) + 1, np.int64), at
    for i, x in enumerate(needle, 1):
        # Without the steps in the window; then the last place from which steps in the window lead here for less.
        base, origin = cost + 1, start.copy()
        both = cost[:-1] + (ids != known.get(x, -1))
        better = both <= base[1:]
        base[1:][better], origin[1:][better] = both[better], start[:-1][better]
        base[0], origin[0] = i, 0
        least = np.minimum.accumulate(base - at)
        begun = np.maximum.accumulate(np.where(base - at == least, at, 0))
        cost, start = least + at, origin[begun]
    ends = np.flatnonzero(cost == cost.min())
    for rank in (np.abs(at - start - len(needle)), start):
        ends = ends[rank[ends] == rank[ends].min()]
    end = int(ends[0])
    return int(cost[end]), int(start[end]), end


WINDOW = "distance int, first int, after int, exact boolean"


def nearest_window(needle: Column, hay: Column) -> Column:
    """best_window of the words of two texts; null and empty texts have no words."""

    @F.pandas_udf(WINDOW)
    def run(needles: pd.Series, hays: pd.Series) -> pd.DataFrame:
        found = [best_window((a or "").split(), (b or "").split()) for a, b in zip(needles, hays)]
        return pd.DataFrame([(*w, w[0] == 0) for w in found], columns=["distance", "first", "after", "exact"])

    return run(needle, hay)


def matching_tokens(a: list, b: list) -> int:
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def _postorder(tree) -> tuple[list, list[int]]:
    """Labels in postorder, and of each node the place of its leftmost leaf; no recursion, so any depth is fine."""
    labels, firsts = [], []
    stack = [(tree, iter(tree[1]), None)]
    while stack:
        node, children, first = stack.pop()
        child = next(children, None)
        if child is None:
            labels.append(node[0])
            firsts.append(len(labels) - 1 if first is None else first)
            if stack and stack[-1][2] is None:
                parent, rest, _ = stack.pop()
                stack.append((parent, rest, firsts[-1]))
        else:
            stack.append((node, children, first))
            stack.append((child, iter(child[1]), None))
    return labels, firsts


def tree_distance(a, b, rename=lambda x, y: float(x != y)) -> float:
    """Ordered tree edit distance of (label, children) trees with unit insertions and deletions, over keyroots
    (Zhang and Shasha 1989)."""
    (la, fa), (lb, fb) = _postorder(a), _postorder(b)
    if fa == fb:  # of one shape: all mappings but that of each node to its like leave out a node on both sides
        straight = sum(map(rename, la, lb))
        if straight <= 2:
            return float(straight)
    roots = lambda firsts: sorted({f: i for i, f in enumerate(firsts)}.values())
    trees = [[0.0] * len(lb) for _ in la]
    for i in roots(fa):
        for j in roots(fb):
            di, dj = fa[i], fb[j]
            forest = [[float(y) for y in range(j - dj + 2)]]
            for x in range(di, i + 1):
                row = [float(x - di + 1)]
                for y in range(dj, j + 1):
                    out = min(forest[-1][y - dj + 1], row[-1]) + 1
                    if fa[x] == di and fb[y] == dj:
                        out = min(out, forest[-1][y - dj] + rename(la[x], lb[y]))
                        trees[x][y] = out
                    else:
                        before = forest[fa[x] - di][fb[y] - dj]
                        out = min(out, before + trees[x][y])
                    row.append(out)
                forest.append(row)
    return trees[-1][-1]


def tree_similarity(a, b, rename=lambda x, y: float(x != y)) -> float:
    return 1 - tree_distance(a, b, rename) / max(len(_postorder(a)[0]), len(_postorder(b)[0]))


def assignment(weights: list[list[float]]) -> list[tuple[int, int]]:
    """One-to-one pairs of greatest total weight (shortest augmenting paths on a square of costs)."""
    n = max(len(weights), max(map(len, weights), default=0))
    if not n:
        return []
    cost = [[-(weights[i][j]) if i < len(weights) and j < len(weights[i]) else 0.0 for j in range(n)] for i in range(n)]
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[j0]:
            used[j0] = True
            row, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    slack = cost[row - 1][j - 1] - u[row] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, n + 1)]
    return sorted((i, j) for i, j in pairs if i < len(weights) and j < len(weights[i]) and weights[i][j] > 0)
