"""Permutation nulls of attributions: one dense row a unit, and no row for each permutation of an item.

A permutation deals the gene labels of a fold anew to the columns of its matrix. A task works out the
permutations it needs from their keys, multiplies its block of units with the membership vectors of a
block of permutations, and keeps what each unit asks for: every value, or the sums that its null needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut
from larkaudit.functions.permute import permuted, seed
from larkaudit.functions.ranks import places
from larkaudit.operators.attribution import UNIT

METRICS = ["residual", "coverage", "top_fraction"]
#: Pairs of gene and set, and genes, at most: each task gets them all.
MOST_EDGES, MOST_GENES = 20_000_000, 2_000_000
#: Numbers in a block of units or of permutations, and values of the null told apart from the observed one at least.
BLOCK_NUMBERS, NEAR = 4_000_000, 1e-9
TOP_SETS = 100


def permutations(n: int) -> F.Column:
    return F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")))


class Labels:
    """What labels a column may have: whether they are mapped, and the sets they belong to."""

    def __init__(self, n: int, place: np.ndarray, term: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.n, self.place, self.weight = n, place[order], weight[order]
        self.starts = np.flatnonzero(np.diff(term[order], prepend=-1)) if len(term) else np.zeros(0, np.int64)
        self.mapped = np.zeros(n)
        self.mapped[place] = 1.0

    def moves(self, key: int, perms: np.ndarray) -> np.ndarray:
        """The place whose label each column has, a row for each permutation."""
        seeds = seed(np.full(len(perms), key), perms)
        return permuted(np.broadcast_to(np.arange(self.n), (len(perms), self.n)), self.n, seeds[:, None])

    def top_fraction(self, shap: np.ndarray, at: np.ndarray, top: int) -> np.ndarray:
        """The share of the ``top`` sets in the absolute mass of all sets, when the label of place p is on column at[p]; 0 without any."""
        if not len(self.starts):
            return np.zeros(len(shap))
        out, step = [], max(1, BLOCK_NUMBERS // max(len(self.place), 1))
        for i in range(0, len(shap), step):
            mass = np.abs(np.add.reduceat(shap[i : i + step, at[self.place]] * self.weight, self.starts, axis=1))
            k = mass.shape[1] - min(top, mass.shape[1])
            best, whole = np.partition(mass, k, axis=1)[:, k:].sum(axis=1) if k else mass.sum(axis=1), mass.sum(axis=1)
            out.append(np.divide(best, whole, out=np.zeros(len(mass)), where=whole > 0))
        return np.concatenate(out)

    def measures(self, shap: np.ndarray, moves: np.ndarray, top: int) -> np.ndarray:
        """METRICS of each unit (second axis) under each row of ``moves`` (third axis)."""
        mapped = self.mapped[moves].T
        size = np.abs(shap).sum(axis=1, keepdims=True)
        coverage = np.divide(np.abs(shap) @ mapped, size, out=np.zeros((len(shap), mapped.shape[1])), where=size > 0)
        tops = np.stack([self.top_fraction(shap, np.argsort(m), top) for m in moves], axis=1)
        return np.stack([shap @ (1 - mapped), coverage, tops])


def labels_of(attribution: DataFrame, edges: DataFrame) -> tuple[DataFrame, Labels]:
    """gene and place of all genes, and their labels; ``edges`` (gene, term, weight) come from a collection of sets, which does not grow with the units."""
    genes = cut(places(attribution.select("gene").distinct(), "gene"))
    known = cut(edges.join(genes, "gene").select("place", "term", "weight"))
    n, m = genes.count(), known.count()
    if n > MOST_GENES or m > MOST_EDGES:
        raise ValueError(f"{n} genes and {m} memberships, more than {MOST_GENES} and {MOST_EDGES}")
    told = known.toPandas()
    return genes, Labels(n, told["place"].to_numpy(np.int64), pd.factorize(told["term"])[0], told["weight"].to_numpy(float))


def unit_rows(attribution: DataFrame, genes: DataFrame) -> DataFrame:
    """UNIT and row, its attributions by place."""
    entry = F.struct("place", F.coalesce("shap", F.lit(0.0)).cast("double").alias("shap"))
    return attribution.join(genes, "gene").groupBy(*UNIT).agg(F.collect_list(entry).alias("row"))


def by_blocks(n: int, made: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]]):
    """A function of batches of ``unit_rows`` that passes blocks of units, with their dense matrix, to ``made``."""

    def run(batches):
        for batch in batches:
            frame, lists = batch.select(UNIT).to_pandas(), batch.column("row")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            at, place, shap = np.repeat(np.arange(len(sizes)), sizes), flat.field("place").to_numpy(), flat.field("shap").to_numpy()
            step, ends = max(1, BLOCK_NUMBERS // max(n, 1)), np.concatenate([[0], np.cumsum(sizes)])
            for i in range(0, len(frame), step):
                units = frame.iloc[i : i + step].reset_index(drop=True)
                part = slice(ends[i], ends[i + len(units)])
                matrix = np.zeros((len(units), n))
                np.add.at(matrix, (at[part] - i, place[part]), shap[part])
                yield from made(units, matrix)

    def arrow(batches):
        import pyarrow as pa

        for out in run(batches):
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return arrow


def _kind(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def mapping_null(attribution: DataFrame, edges: DataFrame, n: int, top: int = TOP_SETS) -> DataFrame:
    """perm, UNIT and METRICS of every unit for each permutation of the gene labels of its repeat."""
    attribution = cut(attribution)  # read for the genes and for the rows
    genes, labels = labels_of(attribution, edges)

    def made(units: pd.DataFrame, shap: np.ndarray) -> Iterator[pd.DataFrame]:
        for key, rows in units.groupby("repeat_id").groups.items():
            step = max(1, BLOCK_NUMBERS // max(labels.n, len(rows)))
            for k in range(1, n + 1, step):
                perms = np.arange(k, min(k + step, n + 1))
                found = labels.measures(shap[rows], labels.moves(int(key), perms), top)
                each = units.iloc[np.repeat(rows, len(perms))].reset_index(drop=True)
                yield each.assign(perm=np.tile(perms, len(rows)), **dict(zip(METRICS, (f.ravel() for f in found), strict=True)))

    rows = unit_rows(attribution, genes)
    return rows.mapInArrow(by_blocks(labels.n, made), f"{_kind(rows, UNIT)}, perm long, {', '.join(m + ' double' for m in METRICS)}")


def patient_null(attribution: DataFrame, edges: DataFrame, n: int, top: int = TOP_SETS) -> DataFrame:
    """By unit and metric: observed, n, null_mean, null_sd (of the population), excess, z (null where sd is 0) and p_lower, p_upper, p_value.

    Of the permutations of the gene labels only n, sum, sum of squares and the counts on either side are kept;
    shares count the observation itself, and p_value is twice the smaller one, 1 at most.
    """
    attribution = cut(attribution)  # read for the genes and for the rows
    genes, labels = labels_of(attribution, edges)

    def made(units: pd.DataFrame, shap: np.ndarray) -> Iterator[pd.DataFrame]:
        shape = (len(METRICS), len(units))
        total, square, below, above, observed = (np.zeros(shape) for _ in range(5))
        observed[:] = labels.measures(shap, np.arange(labels.n)[None, :], top)[:, :, 0]
        for key, rows in units.groupby("repeat_id").groups.items():
            step = max(1, BLOCK_NUMBERS // max(labels.n, len(rows)))
            for k in range(1, n + 1, step):
                found = labels.measures(shap[rows], labels.moves(int(key), np.arange(k, min(k + step, n + 1))), top)
                off = found - observed[:, rows, None]  # sums of distances from the observed value lose no digits
                total[:, rows] += off.sum(axis=2)
                square[:, rows] += (off**2).sum(axis=2)
                below[:, rows] += (off <= NEAR).sum(axis=2)
                above[:, rows] += (off >= -NEAR).sum(axis=2)
        excess, sd = -total / n, np.sqrt(np.maximum(square / n - (total / n) ** 2, 0))
        sd = np.where(sd < NEAR, 0, sd)
        lower, upper = (1 + below) / (1 + n), (1 + above) / (1 + n)
        for i, metric in enumerate(METRICS):
            z = pd.Series(np.divide(excess[i], sd[i], out=np.full(len(units), np.nan), where=sd[i] > 0), dtype="Float64")
            columns = {"observed": observed[i], "n": n, "null_mean": observed[i] - excess[i], "null_sd": sd[i], "excess": excess[i], "z": z.mask(sd[i] == 0)}
            yield units.assign(metric=metric, **columns, p_lower=lower[i], p_upper=upper[i], p_value=np.minimum(1, 2 * np.minimum(lower[i], upper[i])))

    rows = unit_rows(attribution, genes)
    kind = f"{_kind(rows, UNIT)}, metric string, observed double, n long, null_mean double, null_sd double, excess double, z double, p_lower double, p_upper double, p_value double"
    return rows.mapInArrow(by_blocks(labels.n, made), kind)


def null_patients(nulls: DataFrame, keys: list[str]) -> DataFrame:
    """By keys and metric, over the repeats of ``patient_null``: mean, sd and median of observed, null_mean, excess and z, and n_repeats."""
    values = ["observed", "null_mean", "excess", "z"]
    spread = [f(c).alias(f"{c}_{name}") for c in values for name, f in (("mean", F.avg), ("sd", F.stddev_samp), ("median", F.median))]
    return nulls.groupBy(*keys, "metric").agg(*spread, F.count("*").alias("n_repeats"))


def signflip_null(attribution: DataFrame, n: int) -> DataFrame:
    """total of every unit with fixed pseudorandom signs, for each permutation; ids are whole numbers."""
    row = attribution.groupBy(*UNIT).agg(F.collect_list(F.struct(F.col("gene").cast("long").alias("place"), F.abs("shap").alias("shap"))).alias("row"))

    def run(batches):
        import pyarrow as pa

        perms = np.arange(1, n + 1)
        for batch in batches:
            units, rows = batch.select(UNIT).to_pandas(), batch.column("row")
            out = np.zeros((len(units), n))
            for i, (sample, repeat) in enumerate(zip(units["sample_id"], units["repeat_id"], strict=True)):
                one = rows.slice(i, 1).flatten()
                mixed = (int(sample) * 7919 + one.field("place").to_numpy() * 104729 + int(repeat) * 1299709)[:, None] + perms * 15485863
                out[i] = one.field("shap").to_numpy() @ np.where(mixed % 1000003 % 2 == 0, 1.0, -1.0)
            each = units.iloc[np.repeat(np.arange(len(units)), n)].reset_index(drop=True)
            yield pa.RecordBatch.from_pandas(each.assign(perm=np.tile(perms, len(units)), total=out.ravel()), preserve_index=False)

    return row.mapInArrow(run, f"{_kind(row, UNIT)}, perm long, total double")
