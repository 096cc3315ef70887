"""Correlation of all pairs of columns by block products, without a row for each sample and pair.

The matrix is cut into tiles of ROWS samples by COLUMNS genes. A task multiplies the tiles of two
column blocks for a run of row blocks, and products are summed up by pair of column blocks, a bounded
number at a time. What a task holds does not depend on the number of samples or genes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut
from larkaudit.functions.ranks import places

ROWS, COLUMNS = 1024, 512
#: Row blocks that one task multiplies, and products that one task sums up.
RUN, FAN_IN = 8, 32


def _tiles(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """row_block, block, tile (a matrix as bytes) of cells with row, place and z."""

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((rows, columns))
        m[pdf["row"].to_numpy() % rows, pdf["place"].to_numpy() % columns] = pdf["z"].to_numpy()
        return pd.DataFrame([[*key, m.tobytes()]], columns=["row_block", "block", "tile"])

    named = cells.withColumn("row_block", F.expr(f"row div {rows}")).withColumn("block", F.expr(f"place div {columns}"))
    return named.groupBy("row_block", "block").applyInPandas(tile, "row_block long, block long, tile binary")


def _products(tiles: DataFrame, n_blocks: int, n_rows: int, rows: int, columns: int) -> DataFrame:
    """low, high, product (a matrix as bytes): the sum over all rows of low tile times high tile, for low <= high."""

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key[:2]
        total, met = np.zeros((columns, columns)), {}
        for row_block, block, tile in zip(pdf["row_block"], pdf["block"], pdf["tile"], strict=True):
            met.setdefault(row_block, {})[block] = np.frombuffer(tile).reshape(rows, columns)
        for both in met.values():
            if low in both and high in both:
                total += both[low].T @ both[high]
        return pd.DataFrame([[*key, total.tobytes()]], columns=["low", "high", "run", "product"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(columns * columns)
        for p in pdf["product"]:
            total += np.frombuffer(p)
        return pd.DataFrame([[*key, total.tobytes()]], columns=["low", "high", "run", "product"])

    kind = "low long, high long, run long, product binary"
    met = tiles.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    met = met.select(F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), F.expr(f"row_block div {RUN}").alias("run"), "row_block", "block", "tile")
    out, runs = met.groupBy("low", "high", "run").applyInPandas(multiply, kind), -(-n_rows // (rows * RUN))
    while runs > 1:
        out, runs = out.withColumn("run", F.expr(f"run div {FAN_IN}")).groupBy("low", "high", "run").applyInPandas(add, kind), -(-runs // FAN_IN)
    return out.select("low", "high", "product")


def gene_correlation(features: DataFrame) -> DataFrame:
    """gene_1, gene_2, r for every pair of genes (gene_1 < gene_2), 0 for a constant one.

    ``features``: sample_id, gene (whole numbers), value. A null value lies at its gene's mean; r of
    two genes divides by the number of rows of the first one less one.
    """
    features = cut(features.select("sample_id", "gene", F.col("value").cast("double").alias("value")))
    stats = features.groupBy("gene").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count("*").alias("n"))
    genes, samples = cut(places(stats, "gene")), cut(places(features.select("sample_id").distinct(), "sample_id", "row"))
    n_genes, n_rows = genes.count(), samples.count()
    rows, columns = max(1, min(ROWS, n_rows)), max(1, min(COLUMNS, n_genes))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("_m"), "_s"), F.lit(0.0))
    cells = features.join(genes, "gene").join(samples, "sample_id").select("row", "place", z.alias("z"))
    products = _products(_tiles(cells, rows, columns), -(-n_genes // columns), n_rows, rows, columns)
    blocks = genes.groupBy(F.expr(f"place div {columns}").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("place", "gene", "n"))).alias("_g"))
    named = products.join(blocks.select(F.col("_b").alias("low"), F.col("_g.gene").alias("genes_1"), F.col("_g.n").alias("n_1")), "low")
    named = named.join(blocks.select(F.col("_b").alias("high"), F.col("_g.gene").alias("genes_2")), "high")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = np.asarray(row.genes_1), np.asarray(row.genes_2)
                free = np.asarray(row.n_1, float)[:, None] - 1
                r = np.frombuffer(row.product).reshape(columns, columns)[: len(a), : len(b)]
                r = np.divide(r, free, out=np.zeros(r.shape), where=free > 0)
                i, j = np.triu_indices(len(a), 1) if row.low == row.high else (x.ravel() for x in np.indices(r.shape))
                yield pd.DataFrame({"gene_1": a[i], "gene_2": b[j], "r": r[i, j]})

    # A row holds one product of two megabytes, so a batch holds few of them.
    return named.repartition(max(1, -(-n_genes // columns)) * 4, "low", "high").mapInPandas(pairs, "gene_1 long, gene_2 long, r double")
