"""Keyed permutations of 0 .. n - 1 for any n, by integer arithmetic that SQL can repeat.

Each round pairs place x with (k - x) mod n for a keyed k, and a keyed bit of the larger one of the two
says whether they swap. Both of a pair see the same bit, so a round is a bijection, whatever n is; after
ROUNDS of them a place is anywhere with a bias of some 2 ** -ROUNDS. No sorting, no state: a row's place
in a permutation needs nothing but its own place, so a group of any size is permuted where its rows lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from larkaudit.functions.lineage import cut

PRIME = 2_147_483_647
ROUNDS = 16
#: Factors of the mixing steps; fixed, so that every engine makes the same permutations.
FACTOR, LAST, PERM = 48271, 69621, 15_485_863
FACTOR_INVERSE = pow(FACTOR, -1, PRIME)
#: Numbers that are permuted at a time.
CACHED = 32_768
#: Rows that one window numbers at most, for places in a group of any size.
STRIDE = 65_536


def mixed(u: np.ndarray) -> np.ndarray:
    """Spreads numbers of 0 .. PRIME - 1; the square keeps it from being linear."""
    u = (u * FACTOR + 12345) % PRIME
    u = (u * u + 1103) % PRIME
    return (u * LAST + 54321) % PRIME


def seed(key: np.ndarray, perm: np.ndarray | int) -> np.ndarray:
    """One number for a key and the number of a permutation."""
    return mixed((mixed(np.asarray(key, np.int64) % PRIME) + np.asarray(perm, np.int64) % PRIME * PERM) % PRIME)


def permuted(place: np.ndarray, n: np.ndarray | int, seeds: np.ndarray | int) -> np.ndarray:
    """Where each place of 0 .. n - 1 goes; all three may be arrays (n below PRIME)."""
    x, s = np.asarray(place, np.int64).copy(), np.asarray(seeds, np.int64)
    for _ in range(ROUNDS):
        s = (s * FACTOR + 12345) % PRIME
        other = s % n - x
        other += np.where(other < 0, n, 0)
        bit = ((s + np.maximum(x, other)) * LAST) % PRIME
        x = np.where(bit * bit % PRIME & 32768, other, x)
    return x


def _folded(v: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A number of at most PRIME + 2 that is ``v`` (below 2 ** 63) modulo PRIME, in place: PRIME is 2 ** 31 - 1."""
    for _ in range(2):
        np.right_shift(v, 31, out=high)
        v &= PRIME
        v += high
    return v


def _back(s: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The number that the step of a round made ``s`` of, in place."""
    s += PRIME - 12345
    s *= FACTOR_INVERSE
    _folded(s, high)
    s -= PRIME
    np.right_shift(s, 63, out=high)
    high &= PRIME
    s += high
    return s


def restored(place: np.ndarray, n: np.ndarray | int, seeds: np.ndarray | int, group: np.ndarray | None = None) -> np.ndarray:
    """The place that ``permuted`` sends to each place: the same rounds, each its own inverse, from the last to the first.

    With ``group``, place is one row, n and the columns of seeds are by group, and group is the group of each place.
    Blocks of columns are small enough to stay in a core's cache.
    """
    place, n = np.asarray(place, np.int64), np.asarray(n, np.int64)
    # All steps at once, as each is a line.
    slope, rise = 1, 0
    for _ in range(ROUNDS):
        slope, rise = slope * FACTOR % PRIME, (rise * FACTOR + 12345) % PRIME
    s = (np.asarray(seeds, np.int64) * slope + rise) % PRIME
    if group is None:
        shape = np.broadcast_shapes(place.shape, n.shape, s.shape)
        place, n, s = (np.atleast_2d(np.broadcast_to(v, shape)) for v in (place, n, s))
    else:
        place, n, shape = place[None, :], n[None, :], (len(s), len(group))
    out = np.empty((s.shape[0], place.shape[1]), np.int64)
    step = max(1, CACHED // max(1, len(out)))
    for at in range(0, out.shape[1], step):
        columns = slice(at, at + step)
        used, index = (columns, None) if group is None else np.unique(group[columns], return_inverse=True)
        # A row for each place, so that a group's numbers lie side by side.
        out[:, columns] = _restore(place[:, columns].T, n[:, used].T, np.array(s[:, used].T, order="C"), index).T
    return out.reshape(shape)


def _restore(place: np.ndarray, n: np.ndarray, s: np.ndarray, index: np.ndarray | None) -> np.ndarray:
    spread = (lambda v, out: v) if index is None else (lambda v, out: v.take(index, axis=0, out=out, mode="clip"))
    shape = s.shape if index is None else (len(index), s.shape[1])
    size, narrow, near = n if index is None else n[index], n.astype(np.uint32), PRIME - int(n.max(initial=0))
    other, bit, wide = (np.empty(shape, np.int64) for _ in range(3))
    high, pivot, x = np.empty_like(s), np.empty_like(s), np.empty(shape, np.int64)
    x[:] = place
    for _ in range(ROUNDS):
        np.remainder(s.astype(np.uint32), narrow, out=pivot, casting="unsafe")
        np.subtract(spread(pivot, other), x, out=other)
        np.right_shift(other, 63, out=bit)
        bit &= size
        other += bit
        np.maximum(x, other, out=bit)
        bit += spread(s, wide)
        if s.max(initial=0) >= near:
            bit[bit == PRIME] = 0  # folding would leave it as it is
        bit *= LAST
        np.right_shift(bit, 31, out=wide)
        bit &= PRIME
        bit += wide
        bit *= bit
        _folded(bit, wide)
        # Bit 15 decides: all bits of a mask.
        bit <<= 48
        bit >>= 63
        other ^= x
        other &= bit
        x ^= other
        _back(s, high)
    return x


@F.arrow_udf(LongType())
def _moved(place: pa.Array, n: pa.Array, key: pa.Array, perm: pa.Array) -> pa.Array:
    place, n, key, perm = (a.to_numpy(zero_copy_only=False) for a in (place, n, key, perm))
    return pa.array(permuted(place, n, seed(key, perm)), pa.int64())


def moved(place: str | Column, n: str | Column, key: str | Column, perm: str | Column) -> Column:
    """The place in the permutation that key (a whole number) and perm name; none may be null."""
    return _moved(*[(F.col(c) if isinstance(c, str) else c).cast("long") for c in (place, n, key, perm)])


def local_places(rows: DataFrame, keys: list[str], by: str, name: str = "place", total: str = "n") -> DataFrame:
    """Adds the place of each row within ``keys`` in the order of ``by`` (a long without repeats there), and the number of rows.

    A group is numbered in strides of values, each in a window of its own, whose sizes are then summed
    up: a key with a third of all rows is spread like any other.
    """
    bounds = rows.agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count("*").alias("n")).first()
    # Strides hold STRIDE rows each if ids are spread evenly, and fewer rows of one key than that.
    width = max(1, ((bounds["hi"] or 0) - (bounds["lo"] or 0) + 1) * STRIDE // max(bounds["n"], 1))
    rows = rows.withColumn("_s", F.floor((F.col(by) - F.lit(bounds["lo"] or 0)) / width))
    sizes = cut(rows.groupBy(*keys, "_s").agg(F.count("*").alias("_c")))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_b", before).withColumn(total, F.sum("_c").over(Window.partitionBy(*keys))).drop("_c")
    inner = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(by)) - 1
    return rows.withColumn("_i", inner).join(sizes, [*keys, "_s"]).withColumn(name, (F.col("_i") + F.col("_b")).cast("long")).drop("_i", "_b", "_s")


def sql_permuted(name: str, source: str, key: str, keep: str) -> str:
    """CTEs ending in ``name``: ``keep`` and moved, for the rows of ``source`` (place, n, perm and what ``key`` reads)."""
    steps = [
        f"select {keep}, place as x, n as m, perm as q, ({key}) % {PRIME} * {FACTOR} + 12345 as u from {source}",
        f"select * replace (((u % {PRIME}) * (u % {PRIME}) + 1103) % {PRIME} as u)",
        f"select * replace (((u * {LAST} + 54321) % {PRIME} + q % {PRIME} * {PERM}) % {PRIME} * {FACTOR} + 12345 as u)",
        f"select * replace (((u % {PRIME}) * (u % {PRIME}) + 1103) % {PRIME} as u)",
        f"select * exclude (u, q), (u * {LAST} + 54321) % {PRIME} as s",
    ]
    for _ in range(ROUNDS):
        steps += [
            f"select * replace ((s * {FACTOR} + 12345) % {PRIME} as s)",
            "select *, (s % m - x + m) % m as o",
            f"select *, ((s + greatest(x, o)) * {LAST}) % {PRIME} as b",
            f"select * exclude (o, b) replace (case when b * b % {PRIME} & 32768 > 0 then o else x end as x)",
        ]
    text = steps[0]
    for s in steps[1:]:
        text = f"{s} from ({text})"
    return f"{name} as materialized (select {keep}, x as moved from ({text}))"
