"""Importances of features in a random forest or in extremely randomised trees, from counts of rows that are alike.

Features are cut into BINS bins, one per value if those are few, as MLlib's trees cut them. Rows of the same bins and the same label (class, or bin of a continuous
label) are one cell with its number of rows and sums of the label; each level of all trees is then one pass over cells, not rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from grainmill.functions.core import fit

BINS = 32
#: Cells that a worker takes at a time.
CHUNK = 1_000_000
_QUANTILES = "array(" + ", ".join(f"{i / 10_000!r}D" for i in range(10_001)) + ")"


def _cuts(values: list[float]) -> list[float]:
    """Up to BINS - 1 cuts of sorted quantiles: between all values if those are few, else at even shares."""
    known = sorted(set(values))
    if len(known) <= BINS:
        return [a + (b - a) / 2 if math.isfinite(b - a) else a for a, b in zip(known, known[1:])]
    return sorted({values[i * (len(values) - 1) // BINS] for i in range(1, BINS)} - {known[-1]})


def _ends(values: list[float], cuts: list[float]) -> tuple[list[float], list[float]]:
    """The lowest and the highest number of each bin."""
    known = sorted(set(values))
    return (known, known) if len(known) <= BINS else ([values[0], *cuts], [*cuts, values[-1]])


def _bin(x: str, cuts: list[float], first: int = 0) -> str:
    """SQL of the number of cuts below x, by halving."""
    if not cuts:
        return f"{first}Y"
    m = len(cuts) // 2
    cut = f"{cuts[m]!r}D" if math.isfinite(cuts[m]) else f"double('{cuts[m]}')"
    return f"CASE WHEN {x} <= {cut} THEN {_bin(x, cuts[:m], first)} ELSE {_bin(x, cuts[m + 1 :], first + m + 1)} END"


def forest_importances(rows: DataFrame, width: int, classes: int = 0, trees: int = 100, depth: int = 3, seed: int = 0) -> list[float]:
    """Mean decreases of impurity, normalised by tree and altogether, of f0, f1, ... for label; rows holds doubles without missing ones.

    Without classes: a random forest of regression trees, a node seeing a third of the features. A tree takes each cell Poisson(n)
    times: just what n rows taken Poisson(1) times come to, save that rows of one cell, whose labels lie in one of BINS ranges, count
    by the mean label and square there. The draws are hashes of cell and tree, so they survive repartitioning.
    With classes (label is 0, 1, ...): extremely randomised trees by Gini's impurity. All rows are taken, a node sees the root of the
    number of features, rounded up, among those that vary in it, and each has one cut: that below a random number in its range there.
    """
    names = [f"f{i}" for i in range(width)]
    if not width:
        return []
    q = fit(rows, {c: F.expr(f"percentile_approx({c}, {_QUANTILES}, 10000)") for c in [*names, *(["label"] if not classes else [])]})
    if q["f0"] is None:
        return [0.0] * width
    cuts = {c: _cuts(q[c]) for c in q.asDict()}
    ends = [_ends(q[c], cuts[c]) for c in names]
    middle = 0.0 if classes else q["label"][len(q["label"]) // 2]
    y = f"(label - {middle!r}D)"
    label = "CAST(label AS INT)" if classes else f"CAST({_bin('label', cuts['label'])} AS INT)"
    binned = rows.select(*(F.expr(_bin(c, cuts[c])).alias(c) for c in names), F.expr(label).alias("j"), F.expr("0D" if classes else y).alias("y"))
    cells = binned.groupBy(*names, "j").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s1"), F.sum(F.col("y") * F.col("y")).alias("s2"))
    cells = cells.select(*names, "j", "n", "s1", "s2", F.xxhash64(F.lit(seed), *names, "j").alias("h")).persist()
    feature, cut = np.full((trees, 2**depth), -1), np.zeros((trees, 2**depth), int)
    gains = np.zeros((trees, width))
    seen = min(width, math.ceil(math.sqrt(width)) if classes else math.ceil(width / 3))
    try:
        for level in range(depth):
            counts = cells.mapInPandas(_counter(names, classes, level, feature, cut, CHUNK), "tree int, counts binary")
            found = counts.groupBy("tree").applyInPandas(_splitter(ends, classes, level, seen, trees, seed), "tree int, node int, feature int, cut int, gain double").collect()
            for t, node, f, at, gain in found:
                feature[t, node], cut[t, node] = f, at
                gains[t, f] += gain
            if not found:
                break
    finally:
        cells.unpersist()
    totals = gains.sum(axis=1, keepdims=True)
    mean = np.divide(gains, totals, out=np.zeros_like(gains), where=totals > 0).sum(axis=0)
    return (mean / mean.sum() if mean.sum() > 0 else mean).tolist()


# The two functions below are made inside others, so that Spark sends them whole to workers that cannot import this package.


def _counter(names: list[str], classes: int, level: int, feature: np.ndarray, cut: np.ndarray, chunk: int):
    """A function of cells: per tree what its nodes of a level hold by feature and bin (rows by class, or rows and sums of label and square)."""
    bins, most_exact, most = BINS, 64, 192

    def poisson_table():
        table = np.zeros((most_exact, most))
        for n in range(1, most_exact + 1):
            k = np.arange(1, most)
            table[n - 1] = n + np.minimum(np.cumsum(np.exp(np.append(-n, -n + np.cumsum(np.log(n / k))))), 1)
        return table.ravel()

    table = poisson_table()

    def uniform(h, salt):
        z = h + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53

    def poisson(n, h, tree):
        """Exact quantiles of uniform numbers up to a mean of 64; beyond, a normal number with the skew put right."""
        out, u = np.empty(len(n)), uniform(h, 2 * tree + 1)
        few = n <= most_exact
        out[few] = np.searchsorted(table, n[few] + np.minimum(u[few], 1 - 1e-12), "right") - (n[few] - 1) * most
        m = n[~few]
        z = np.sqrt(-2 * np.log1p(-u[~few])) * np.cos(2 * np.pi * uniform(h[~few], 2 * tree + 2))
        out[~few] = np.maximum(np.floor(m + np.sqrt(m) * z + (z * z - 1) / 6 + 0.5), 0)
        return out

    def count(p):
        x = [p[c].to_numpy().astype(np.int64) for c in names]
        n, h, j = p["n"].to_numpy(), p["h"].to_numpy().view(np.uint64), p["j"].to_numpy().astype(np.int64)
        means = (p["s1"].to_numpy() / n, p["s2"].to_numpy() / n)
        matrix, every, nodes = np.stack(x, 1), np.arange(len(n)), 2**level
        for t in range(len(feature)):
            node = np.ones(len(n), np.int64)
            for _ in range(level):
                f = feature[t][node]
                node = np.where(f >= 0, 2 * node + (matrix[every, f] > cut[t][node]), 0)  # node 0 splits no more
            live = node > 0
            if not live.any():
                continue
            pick = (lambda a: a) if live.all() else lambda a: a[live]
            at, w = pick(node) - nodes, pick(n) if classes else poisson(pick(n), pick(h), t)
            stats = [w] if classes else [w, w * pick(means[0]), w * pick(means[1])]
            size = nodes * bins * max(classes, 1)
            out = []
            for v in x:
                key = at * bins + pick(v)
                key = key * classes + pick(j) if classes else key
                held = [np.bincount(key, s, size) for s in stats]
                out.append(held[0] if classes else np.stack(held, 1).ravel())
            yield pd.DataFrame({"tree": [t], "counts": [np.concatenate(out).tobytes()]})

    def run(batches):
        held, rows = [], 0
        for p in batches:
            held.append(p)
            rows += len(p)
            if rows >= chunk:
                yield from count(pd.concat(held, ignore_index=True))
                held, rows = [], 0
        if rows:
            yield from count(pd.concat(held, ignore_index=True))

    return run


def _splitter(ends: list[tuple[list[float], list[float]]], classes: int, level: int, seen: int, trees: int, seed: int):
    """A function of a tree's counts: the best split of each node of the level that gains by one, among `seen` features drawn by node."""
    bins, width = BINS, len(ends)

    def random_cut(share, f, rows):
        (low, high), bins_there = ends[f], np.flatnonzero(rows)
        first, last = int(bins_there[0]), int(bins_there[-1])
        if not np.isfinite(high[last] - low[first]):
            return first + int(share * (last - first))
        return int(np.clip(np.searchsorted(high, low[first] + share * (high[last] - low[first]), "right") - 1, first, last - 1))

    def best(p):
        total = np.zeros(len(p["counts"].iloc[0]) // 8)
        for b in p["counts"]:
            total += np.frombuffer(b)
        t, nodes = int(p["tree"].iloc[0]), 2**level
        held, rows = total.reshape(width, nodes, bins, classes or 3), []
        for i in range(nodes):
            whole = held[0, i].sum(axis=0)
            n = whole.sum() if classes else whole[0]
            if n <= 0:
                continue
            top = (0.0, -1, -1)
            spread = 1.0 if classes else whole[2] / n
            # Dealt evenly to trees: of `width` trees each has another feature first, and the trees' random numbers fill all parts of (0, 1).
            order = np.roll(np.random.default_rng([seed, nodes + i, t // width]).permutation(width), t % width)
            for f in [f for f in order if (held[f, i].sum(axis=1) > 0).sum() > 1][:seen] if classes else np.sort(order[:seen]):
                left = np.cumsum(held[f, i], axis=0)[:-1]
                right = whole - left
                a, b = (left.sum(axis=1), right.sum(axis=1)) if classes else (left[:, 0], right[:, 0])
                ok = (a >= 0.5) & (b >= 0.5)
                a1, b1 = np.where(ok, a, 1.0), np.where(ok, b, 1.0)
                # What the impurity of both sides falls short of the whole's: by the distance of their means, or of their shares of classes.
                apart = ((left / a1[:, None] - right / b1[:, None]) ** 2).sum(axis=1) if classes else (left[:, 1] / a1 - right[:, 1] / b1) ** 2
                gain = np.where(ok, a * b / (n * n) * apart, 0.0)
                part = np.random.default_rng([seed, nodes + i, f, 1])
                share = (part.permutation(trees)[t] + part.random(trees)[t]) / trees
                c = random_cut(share, f, held[f, i].sum(axis=1)) if classes else int(gain.argmax())
                if gain[c] > top[0] and gain[c] > 1e-14 * spread:
                    top = (float(gain[c]), int(f), c)
            if top[1] >= 0:
                rows.append((t, nodes + i, top[1], top[2], top[0] * float(n)))
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "gain"])

    return best
