"""Overlap of the target sets of all pairs of patients for many permutations at once, without a set for each permutation.

A patient's targets of any permutation are among its own entries, so an entry with a bit for each permutation says all.
Let i be the targets that two patients share and s the sum of their numbers of targets; their Jaccard index is i / (s - i).
Where two patients have one gene in common, i is one bit: such pairs are counted by gene, number and permutation, and
not made. Pairs with more genes in common are found by hash: batches of genes send the hashes of their pairs, packed,
by range; each range answers with a bit a pair whether it came more than once. What those pairs' shared bits add to the
sum of single ones is then summed up by pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a batch or range, entries of a batch, and bits that are summed at once.
PAIRS, ENTRIES, BITS = 4_000_000, 400_000, 50_000_000
#: Patients of a gene at most: their pairs are made in one task.
MOST_PATIENTS = 2_000


def _pairs(gene: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all pairs of rows of one gene; genes lie side by side."""
    new = np.ones(len(gene), bool)
    new[1:] = gene[1:] != gene[:-1]
    start = np.flatnonzero(new)
    left = np.repeat(np.append(start[1:], len(gene)), np.diff(np.append(start, len(gene)))) - np.arange(len(gene))
    first, second, rows = [], [], np.arange(len(gene))
    for d in range(1, int(left.max(initial=1))):
        rows = rows[left[rows] > d]
        first.append(rows)
        second.append(rows + d)
    none = np.zeros(0, np.int64)
    return np.concatenate(first or [none]), np.concatenate(second or [none])


def _hashed(p: np.ndarray, q: np.ndarray, bits: int) -> np.ndarray:
    h = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + q.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(64 - bits)


def _pack(keys: np.ndarray) -> bytes:
    """Rising numbers as byte planes of their differences, compressed."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    planes = max(1, int(np.flatnonzero(d.any(axis=0)).max(initial=0)) + 1)
    return bytes([planes]) + zlib.compress(np.ascontiguousarray(d[:, :planes].T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    d = np.zeros((flat.shape[1], 8), np.uint8)
    d[:, : data[0]] = flat.T
    return np.cumsum(d.view("<u8").ravel())


def _sorted(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gene, patient, size and mask (a row of bytes) of entries, by gene and patient."""
    gene, patient = pdf["gene"].to_numpy(), pdf["patient_id"].to_numpy()
    order = np.lexsort((patient, gene))
    mask = np.frombuffer(b"".join(pdf["mask"]), np.uint8).reshape(len(pdf), -1)
    return gene[order], patient[order], pdf["size"].to_numpy(np.int64)[order], mask[order]


def _alone(gene: np.ndarray, size: np.ndarray, mask: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """By permutation: the sum of 1 / (s - 1) over all pairs that share a gene, once for each gene, and the most patients of a gene."""
    order = np.lexsort((size, gene))
    gene, size, mask = gene[order], size[order], mask[order]
    new = np.ones(len(gene), bool)
    new[1:] = (gene[1:] != gene[:-1]) | (size[1:] != size[:-1])
    start = np.flatnonzero(new)
    total, most = np.zeros(permutations), np.zeros(permutations, np.int64)
    groups, step = np.append(start, len(gene)), max(1, BITS // permutations)
    at = 0
    while at < len(start):
        # Whole genes, one at least.
        stop = max(at + 1, int(np.searchsorted(groups, groups[at] + step, side="right")) - 1)
        while stop < len(start) and gene[start[stop]] == gene[start[stop - 1]]:
            stop += 1
        a, b = groups[at], groups[stop]
        count = np.add.reduceat(np.unpackbits(mask[a:b], axis=1, count=permutations), start[at:stop] - a, axis=0, dtype=np.int64)
        own_gene, own_size = gene[start[at:stop]], size[start[at:stop]]
        total += (count * (count - 1) / 2 / np.maximum(2 * own_size - 1, 1)[:, None]).sum(axis=0)
        i, j = _pairs(own_gene)
        for c in range(0, len(i), max(1, step // 8)):
            x, y = i[c : c + max(1, step // 8)], j[c : c + max(1, step // 8)]
            total += (count[x] * count[y] / np.maximum(own_size[x] + own_size[y] - 1, 1)[:, None]).sum(axis=0)
        first = np.flatnonzero(np.append(True, own_gene[1:] != own_gene[:-1]))
        most = np.maximum(most, np.add.reduceat(count, first, axis=0).max(axis=0))
        at = stop
    return total, most


def masks_fit(masks: DataFrame) -> tuple[int, int, int] | None:
    """Entries with a bit, patients and pairs of patients of one gene; None if a gene has too many patients or a patient's number of
    targets differs by permutation."""
    n_patients, least = masks.groupBy("patient_id").agg(F.min("size").alias("s")).agg(F.count("*"), F.min("s")).first()
    genes = masks.where(_some()).groupBy("gene").agg(F.count("*").alias("n"))
    most, entries, pairs = genes.agg(F.max("n"), F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    if not n_patients or least < 0 or not most or most > MOST_PATIENTS:
        return None
    return int(entries), int(n_patients), int(pairs)


def _some() -> F.Column:
    return F.length(F.regexp_replace(F.hex("mask"), "0+", "")) > 0


def overlap_metrics(masks: DataFrame, permutations: int, fit: tuple[int, int, int]) -> DataFrame:
    """perm, mean_jaccard, dissimilarity and max_recurrence of ``masks`` (written, as ``null_masks`` has them), for which ``masks_fit`` gave ``fit``."""
    from larkaudit.functions.lineage import written

    entries, n, n_pairs = fit
    parts = 1 + max(n_pairs // PAIRS, entries // ENTRIES)
    bits = min(62, max(20, n_pairs.bit_length() + 7))
    edges = [(r << bits) // parts for r in range(parts + 1)]  # of ranges of hashes
    width = -(-permutations // 8)
    shared = np.dtype([("p", "<i8"), ("q", "<i8"), ("s", "<i4"), ("mask", "u1", (width,))])
    rows = masks.where(_some()).select("patient_id", "gene", "size", "mask", F.expr(f"cast(pmod(xxhash64(gene), {parts}) as int)").alias("batch"))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        gene, patient, _, _ = _sorted(pdf)
        i, j = _pairs(gene)
        keys = np.sort(_hashed(patient[i], patient[j], bits))
        where = np.searchsorted(keys, np.array(edges, np.uint64))
        found = [(r, int(pdf["batch"].iloc[0]), _pack(keys[a:b])) for r, (a, b) in enumerate(zip(where[:-1], where[1:], strict=True)) if b > a]
        return pd.DataFrame(found, columns=["r", "batch", "data"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack(d) for d in pdf["data"]]
        _, inverse, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        again = np.split(times[inverse] > 1, np.cumsum([len(k) for k in keys])[:-1])
        return pdf.assign(data=[zlib.compress(np.packbits(a).tobytes(), 1) for a in again], n=[len(a) for a in again])[["r", "batch", "data", "n"]]

    def resolve(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        gene, patient, size, mask = _sorted(pdf)
        total, most = _alone(gene, size, mask, permutations)
        out = [(-1, total.tobytes() + most.tobytes())]
        told = told.sort_values("r")
        if len(told):
            again = np.concatenate([np.unpackbits(np.frombuffer(zlib.decompress(d), np.uint8), count=c) for d, c in zip(told["data"], told["n"], strict=True)])
            i, j = _pairs(gene)
            chosen = np.argsort(_hashed(patient[i], patient[j], bits), kind="stable")[again.astype(bool)]
            i, j = i[chosen], j[chosen]
            found = np.zeros(len(i), shared)
            found["p"], found["q"], found["s"], found["mask"] = patient[i], patient[j], size[i] + size[j], mask[i] & mask[j]
            bucket = (_hashed(found["p"], found["q"], 62) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    out.append((int(bucket[part[0]]), found[part].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "data"])

    def more(pdf: pd.DataFrame) -> pd.DataFrame:
        """What pairs that share several genes add to the sum of what their genes add by themselves."""
        found = np.frombuffer(b"".join(pdf["data"]), shared)
        found = found[np.lexsort((found["q"], found["p"]))]
        new = np.ones(len(found), bool)
        new[1:] = (found["p"][1:] != found["p"][:-1]) | (found["q"][1:] != found["q"][:-1])
        start, total, at = np.append(np.flatnonzero(new), len(found)), np.zeros(permutations), 0
        while at < len(start) - 1:
            stop = max(at + 1, int(np.searchsorted(start, start[at] + BITS // 8 // permutations, side="right")) - 1)
            own = found[start[at] : start[stop]]
            i = np.add.reduceat(np.unpackbits(own["mask"], axis=1, count=permutations), start[at:stop] - start[at], axis=0, dtype=np.int64)
            s = own["s"][start[at:stop] - start[at]].astype(np.int64)[:, None]
            total += np.where(i > 1, i / np.maximum(s - i, 1) - i / np.maximum(s - 1, 1), 0.0).sum(axis=0)
            at = stop
        return pd.DataFrame({"perm": np.arange(1, permutations + 1), "j": total, "most": 0})

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["data"]:
                total, most = np.frombuffer(data, np.float64, permutations), np.frombuffer(data, np.int64, permutations, 8 * permutations)
                yield pd.DataFrame({"perm": np.arange(1, permutations + 1), "j": total, "most": most})

    sent = rows.groupBy("batch").applyInPandas(send, "r int, batch int, data binary").groupBy("r").applyInPandas(answer, "r int, batch int, data binary, n long")
    # A gene of one patient has no pairs, but counts.
    done = written(rows.groupBy("batch").cogroup(sent.groupBy("batch")).applyInPandas(resolve, "bucket int, data binary"))
    kind = "perm long, j double, most long"
    sums = done.where("bucket < 0").select("data").mapInPandas(alone, kind).unionByName(done.where("bucket >= 0").groupBy("bucket").applyInPandas(more, kind))
    jaccard = F.try_divide(F.sum("j"), F.lit(n * (n - 1) / 2))
    out = sums.groupBy("perm").agg(jaccard.alias("mean_jaccard"), (F.max("most") / n).alias("max_recurrence"))
    return out.select("perm", "mean_jaccard", (1 - F.col("mean_jaccard")).alias("dissimilarity"), "max_recurrence")
