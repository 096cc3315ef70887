"""Folds, selection of features and model fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut, written
from larkaudit.functions.quantiles import exact_quantiles
from larkaudit.functions.ranks import first_rank

#: Rows that a leaf's Shapley values are worked out for at once, and features of a path up to which patterns are numbered.
SHAP_ROWS, MOST_PATTERN = 100_000, 12


def stratified_folds(samples: DataFrame, key: str, y: str, splits: int, repeats: int) -> DataFrame:
    """key, y, repeat_id (from 1), fold_id: each class is dealt to the folds in a fixed mixed order of its own for each repeat."""
    r = samples.select(key, y, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(repeats).cast("long"))).alias("repeat_id"))
    mixed = (F.col(key) % 10007 * 7919 + F.col("repeat_id") * 104729) % 10007  # the remainder first, so that no id overflows
    order = F.row_number().over(Window.partitionBy("repeat_id", y).orderBy(mixed, key)) - 1
    return r.withColumn("fold_id", (order % splits).cast("long"))


def anova_f(rows: DataFrame, keys: list[str], y: str = "y", value: str = "value") -> DataFrame:
    """f and its degrees of freedom by keys, from counts, sums and sums of squares of the classes."""
    return anova_of_sums(rows.where(F.col(value).isNotNull()).groupBy(*keys, y).agg(F.count("*").cast("double").alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) ** 2).alias("_q")), keys)


def anova_of_sums(per: DataFrame, keys: list[str]) -> DataFrame:
    """``anova_f`` of the classes' counts, sums and sums of squares (_n, _s, _q)."""
    g = per.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.count("*").cast("double").alias("_k"), F.sum("_q").alias("_q"), F.sum("_s").alias("_s"), F.sum(F.col("_s") ** 2 / F.col("_n")).alias("_b")
    )
    between = F.col("_b") - F.col("_s") ** 2 / F.col("_n")
    within = F.col("_q") - F.col("_b")
    return g.select(*keys, F.try_divide(between / (F.col("_k") - 1), within / (F.col("_n") - F.col("_k"))).alias("f"), (F.col("_k") - 1).alias("df1"), (F.col("_n") - F.col("_k")).alias("df2"))


def select_features(scored: DataFrame, keys: list[str], feature: str, k: int) -> DataFrame:
    """The k features with the largest f of each group, ties by name."""
    return scored.withColumn("rank", first_rank(keys, F.desc_nulls_last("f"), F.asc(feature))).where(F.col("rank") <= k)


def best_by_spread(parts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys and gene of the k genes of each group whose class means are furthest apart for their spread, ties by gene; unknown ones last.

    ``parts``: keys, gene, y, and of each part its count _n, mean _a and squared deviations _d.
    """
    of = [*keys, "gene", "y"]
    means = parts.groupBy(*of).agg((F.sum(F.col("_n") * F.col("_a")) / F.sum("_n")).alias("_m"))
    spread = parts.join(means, of).groupBy(*of).agg(F.first("_m").alias("_m"), F.sum(F.col("_d") + F.col("_n") * (F.col("_a") - F.col("_m")) ** 2).alias("_d"))
    mean = lambda y: F.max(F.when(F.col("y") == y, F.col("_m")))
    f = spread.groupBy(*keys, "gene").agg(((mean(1) - mean(0)) ** 2 / (F.sum("_d") + 1e-12)).alias("f"))
    return select_features(f, keys, "gene", k).select(*keys, "gene")


def training_median(rows: DataFrame, keys: list[str], value: str = "value", train: str = "train") -> DataFrame:
    """Nulls and non-finite values replaced by the median of the training rows of their group."""
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.col(value))
    r = rows.withColumn(value, finite)
    medians = exact_quantiles(r.where(F.col(train)), value, {"_m": 0.5}, keys)
    return r.join(medians, keys, "left").withColumn(value, F.coalesce(value, "_m")).drop("_m")


def fit_logistic(x: np.ndarray, y: np.ndarray, l1: float, l2: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Class-balanced elastic-net logistic regression by proximal gradient with momentum; x standardised."""
    n, d = x.shape
    weight = np.where(y == 1, n / max(2 * (y == 1).sum(), 1), n / max(2 * (y == 0).sum(), 1))
    step = 4 / max(np.linalg.eigvalsh(x.T @ (x * weight[:, None]) / n).max() + 4 * l2 + 1, 1e-9)
    b, c, old, v, t = np.zeros(d), 0.0, np.zeros(d), np.zeros(d), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -40, 40)))
        g = weight * (p - y)
        b = v - step * (x.T @ g / n + l2 * v)
        b = np.sign(b) * np.maximum(np.abs(b) - step * l1, 0)
        c -= step * g.mean()
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = b + (was - 1) / t * (b - old)
        old = b
    return b, c


class Tree:
    """An extremely randomised tree as arrays: feature, cut, left, right, share of class 1, weight of rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, leaf: int, tries: int):
        self.feature, self.cut, self.left, self.right, self.value, self.cover = [], [], [], [], [], []
        self._grow(x, y, w, np.arange(len(y)), rng, leaf, tries)

    def _grow(self, x, all_y, all_w, rows, rng, leaf, tries) -> int:
        """A node of ``rows``; nodes on the way hold numbers of rows, not copies of them."""
        at = len(self.feature)
        y, w = all_y[rows], all_w[rows]
        total = w.sum()
        share = float((w * y).sum() / total) if total else 0.0
        for column, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, share), (self.cover, float(total))):
            column.append(v)
        if len(y) < 2 * leaf or share in (0.0, 1.0):
            return at
        best = None
        for f in rng.permutation(x.shape[1])[:tries]:
            v = x[rows, f]
            low, high = v.min(), v.max()
            if low == high:
                continue
            c = rng.uniform(low, high)
            side = v <= c
            if min(side.sum(), (~side).sum()) < leaf:
                continue
            gini = 0.0
            for s in (side, ~side):
                q = (w[s] * y[s]).sum() / w[s].sum()
                gini += w[s].sum() * q * (1 - q)
            if best is None or gini < best[0]:
                best = (gini, f, c, side)
        if best is None:
            return at
        _, f, c, side = best
        left, right = rows[side], rows[~side]
        del y, w, best, side, rows
        self.feature[at], self.cut[at] = int(f), float(c)
        self.left[at] = self._grow(x, all_y, all_w, left, rng, leaf, tries)
        del left
        self.right[at] = self._grow(x, all_y, all_w, right, rng, leaf, tries)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return np.array(self.value)[at]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)

    def shap(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of one row, exact over the distinct features of each path."""
        phi = np.zeros(len(x))
        for leaf, path in self._paths():
            met: dict[int, list[float]] = {}
            for node, goes_left in path:
                f = self.feature[node]
                child = self.left[node] if goes_left else self.right[node]
                one, zero = met.get(f, (1.0, 1.0))
                met[f] = [one * float((x[f] <= self.cut[node]) == goes_left), zero * self.cover[child] / self.cover[node]]
            phi += self._leaf(met, self.value[leaf], len(x))
        return phi

    def shap_rows(self, x: np.ndarray) -> np.ndarray:
        """``shap`` of every row. What a leaf gives a row depends only on which features of its path let the row pass, so it is worked out once for each such pattern."""
        phi = np.zeros(x.shape)
        for leaf, path in self._paths():
            low, high, zero = {}, {}, {}
            for node, goes_left in path:
                f, c = self.feature[node], self.cut[node]
                if goes_left:
                    high[f] = min(high.get(f, np.inf), c)
                else:
                    low[f] = max(low.get(f, -np.inf), c)
                child = self.left[node] if goes_left else self.right[node]
                zero[f] = zero.get(f, 1.0) * self.cover[child] / self.cover[node]
            names = list(zero)
            for at in range(0, len(names) and len(x), SHAP_ROWS):
                part, bits = x[at : at + SHAP_ROWS], []
                for f in names:
                    ok = np.ones(len(part), bool)
                    if f in high:
                        ok &= part[:, f] <= high[f]
                    if f in low:
                        ok &= part[:, f] > low[f]
                    bits.append(ok)
                passed = np.stack(bits, axis=1)
                if len(names) <= MOST_PATTERN:
                    code = passed @ (1 << np.arange(len(names)))
                    which = np.flatnonzero(np.bincount(code, minlength=1 << len(names)))
                    number = np.zeros(1 << len(names), np.int64)
                    number[which] = np.arange(len(which))
                    patterns, number = (which[:, None] >> np.arange(len(names)) & 1).astype(float), number[code]
                else:
                    patterns, number = np.unique(passed, axis=0, return_inverse=True)
                    patterns, number = patterns.astype(float), number.ravel()
                phi[at : at + SHAP_ROWS, names] += self._patterns(patterns, np.array([zero[f] for f in names]), self.value[leaf])[number]
        return phi

    @staticmethod
    def _patterns(one: np.ndarray, zero: np.ndarray, value: float) -> np.ndarray:
        """``_leaf`` of each row of ``one``: whether each feature lets it pass."""
        m = len(zero)
        out = np.zeros(one.shape)
        chance = np.array([1 / (m * _choose(m - 1, s)) for s in range(m)])
        for f in range(m):
            sizes = np.zeros(one.shape)
            sizes[:, 0] = 1.0
            for g in range(m):
                if g != f:
                    shifted = np.concatenate([np.zeros((len(one), 1)), sizes[:, :-1]], axis=1) * one[:, g : g + 1]
                    sizes = sizes * zero[g] + shifted
            out[:, f] = value * (one[:, f] - zero[f]) * (sizes @ chance)
        return out

    def _paths(self):
        stack = [(0, [])]
        while stack:
            node, path = stack.pop()
            if self.feature[node] < 0:
                yield node, path
            else:
                stack += [(self.left[node], [*path, (node, True)]), (self.right[node], [*path, (node, False)])]

    @staticmethod
    def _leaf(met: dict[int, list[float]], value: float, width: int) -> np.ndarray:
        """Shapley values of value * product over features of (one if known, else zero), by sizes of known sets."""
        out = np.zeros(width)
        names = list(met)
        m = len(names)
        for f in names:
            sizes = np.zeros(m)
            sizes[0] = 1.0
            for k, g in enumerate(x for x in names if x != f):
                one, zero = met[g]
                shifted = np.concatenate([[0.0], sizes[:-1]]) * one
                sizes = sizes * zero + shifted
            chance = np.array([1 / (m * _choose(m - 1, s)) for s in range(m)])
            out[f] += value * (met[f][0] - met[f][1]) * float((sizes * chance).sum())
        return out


def _choose(n: int, k: int) -> float:
    return float(np.prod([(n - i) / (i + 1) for i in range(k)])) if k else 1.0


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int, leaf: int, seed: int) -> list[Tree]:
    n = len(y)
    w = np.where(y == 1, n / max(2 * (y == 1).sum(), 1), n / max(2 * (y == 0).sum(), 1)).astype(float)
    rng = np.random.default_rng(seed)
    return [Tree(x, y.astype(float), w, rng, leaf, max(1, int(np.sqrt(x.shape[1])))) for _ in range(trees)]


def out_of_fold(vectors: DataFrame, folds: DataFrame, trees: int = 20, leaf: int = 3, k: int = 16, seed: int = 20260701, explain: bool = False) -> DataFrame:
    """Held-out predictions of a logistic model and a forest, or the forest's Shapley values with ``explain``.

    ``vectors`` (sample_id, x array) meet ``folds`` (sample_id, y, repeat_id, fold_id). Medians and the
    k best features by F of each fold's training rows come from sums over all tasks. One task fits one
    repeat and fold; it holds one matrix of the fold's rows with k numbers each.
    """
    from larkaudit.operators import linear

    long = vectors.select("sample_id", F.posexplode("x").alias("gene", "value")).withColumn("gene", F.col("gene").cast("long"))
    samples = written(linear.sample_rows(long, folds))
    held = cut(samples.select(F.inline("folds")).select("repeat_id", F.col("fold_id").alias("held")).distinct())
    medians = linear.training_medians(samples, held)
    best = cut(best_by_spread(linear.training_parts(samples, held, medians), linear.FOLD, k).join(medians, [*linear.FOLD, "gene"], "left"))
    numbered = cut(best.select("gene").distinct().withColumn("place", F.row_number().over(Window.orderBy("gene")) - 1))  # k genes a fold at most
    told = best.join(numbered, "gene").groupBy(*linear.FOLD).agg(F.array_sort(F.collect_list(F.struct("gene", "place", "middle"))).alias("genes"))
    told = cut(told)
    genes = {(r["repeat_id"], r["held"]): [g["gene"] for g in r["genes"]] for r in told.collect()}  # a row a fold
    values = linear.selected_values(samples, numbered).select("sample_id", "y", "x", F.inline("folds")).join(F.broadcast(told), "repeat_id")  # a row a repeat and fold
    x = F.transform("genes", lambda g: F.coalesce(F.get("x", g["place"]), g["middle"]))
    rows = values.select("sample_id", F.col("y").cast("int").alias("y"), "repeat_id", "held", (F.col("fold_id") == F.col("held")).alias("out"), x.alias("x"))

    # Numbers of rows of each fold's group: a row a fold.
    sizes = {(r["repeat_id"], r["held"]): r["n"] for r in rows.groupBy("repeat_id", "held").agg(F.count("*").alias("n")).collect()}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            if not at:
                r, h = batch.column("repeat_id")[0].as_py(), batch.column("held")[0].as_py()
                chosen, n = genes[r, h], sizes[r, h]
                x, ids, y, out = np.empty((n, len(chosen)), order="F"), np.empty(n, np.int64), np.empty(n, np.int32), np.empty(n, bool)
            here = slice(at, at + batch.num_rows)
            x[here] = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(chosen))
            for column, name in ((ids, "sample_id"), (y, "y"), (out, "out")):
                column[here] = batch.column(name).to_numpy(zero_copy_only=False)
            at += batch.num_rows
        # Training rows first, each part by id; column by column, so that there is one matrix only.
        order = np.lexsort((ids, out))
        for j in range(len(chosen)):
            x[:, j] = x[order, j]
        ids, y, first = ids[order], y[order], n - int(out.sum())
        del batch, order, out
        ids, tested, x, y_out, y = ids[first:], x[first:], x[:first], y[first:], y[:first]
        yield from pa.Table.from_pandas(fitted(r, h, ids, tested, x, y_out, y), preserve_index=False).to_batches()

    def fitted(r, h, ids, tested, x, y_out, y) -> pd.DataFrame:
        chosen, known = genes[r, h], len(genes[r, h])
        forest = fit_forest(x, y, trees, leaf, seed + 100 * r + h)
        p = np.mean([t.predict(tested) for t in forest], axis=0)
        if explain:
            shap = np.mean([t.shap_rows(tested) for t in forest], axis=0)
            base = float(np.mean([sum(v * c for v, c, g in zip(t.value, t.cover, t.feature, strict=True) if g < 0) / t.cover[0] for t in forest]))
            made = {"sample_id": np.repeat(ids, known), "repeat_id": r, "fold_id": h, "gene": np.tile(chosen, len(ids)), "shap": shap.ravel(), "expected": base, "p": np.repeat(p, known)}
            return pd.DataFrame(made)
        mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-12
        for part in (x, tested):  # scaled in place: the forest is done with them
            part -= mean
            part /= sd
        coef, c = fit_logistic(x, y.astype(float), 0.005, 0.005)
        q = 1 / (1 + np.exp(-(tested @ coef + c)))
        made = {"sample_id": ids, "repeat_id": r, "fold_id": h, "y": y_out}
        return pd.concat([pd.DataFrame({"model": "logistic", **made, "p": q}), pd.DataFrame({"model": "extratrees", **made, "p": p})])

    schema = "sample_id long, repeat_id long, fold_id long, gene long, shap double, expected double, p double" if explain else "model string, sample_id long, repeat_id long, fold_id long, y int, p double"
    return rows.groupBy("repeat_id", "held").applyInArrow(fit, schema)
