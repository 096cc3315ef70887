"""Groups of vectors with a cosine of at least THRESHOLD, by refining a neighbour graph.

Equal vectors are one class, which counts as often as it has copies.

1. A first graph: in each of so many tables that linked vectors share a bucket of one of them with
   probability TABLE_RECALL, vectors with equal signs of random projections share a bucket; a
   vector's list gets its nearest within the bucket. Crowded buckets are compared part by part.
2. NN-descent: each vector introduces the members of its list and those that list it to each other,
   and all lists are brought up to date, until hardly any list changes. A full list whose members
   all are linked is saturated and may grow.
3. Whatever meets, in a bucket or by introduction, is compared whole, and a spanning forest of its
   links is kept, however full the lists are. These ties give components. Samples of vectors are
   compared with all, as an audit of the links that each vector has within its component; while
   too many are missed, more tables are added, and at last all blocks are compared with all.
4. Within a component all pairs are compared, block by block, so that all links are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.llm.common import cut, spread_join
from larkaudit.llm.graph import connected_components
from larkaudit.llm.vectors import matrix, packed

THRESHOLD = 0.9
#: Of neighbours less similar than this, a bucket gives each vector only its nearest.
FLOOR = 0.7
#: Lengths of a list, and of a saturated one.
LIST, LONG_LIST = 8, 32
#: Neighbours below FLOOR that a vector introduces, of its list and of those that list it.
WEAK = 4
#: Share of the pairs at THRESHOLD that share a bucket of some table.
TABLE_RECALL = 0.99
#: Vectors that a bucket holds on average, and vectors of it that are compared in one task with as many.
BUCKET, PART = 384, 2048
DESCENTS = 4
#: Vectors of each stratum that the audit compares with all others, the recall that it asks for, and its repeats.
AUDIT_ROWS, AUDIT_RECALL, AUDITS = 256, 0.99, 3
#: Share of all vectors from which on a component is large.
LARGE = 0.01
#: Vectors of a component that are compared with as many in one task.
BLOCK = 2048
#: Rows that small buckets and introductions are put together to for one call.
CALL_ROWS = 4096
PAIRS = "a long, b long, s double, tie boolean"


def pairs_in(ids: np.ndarray, x: np.ndarray, bars: np.ndarray | None = None) -> list[tuple]:
    """a, b, s, tie of these vectors: lists of their nearest, and the ties of a spanning forest of all links among them.

    With ``bars`` a list takes only what is above the vector's bar; else all of at least FLOOR, or the nearest.
    """
    if len(ids) < 2:
        return []
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(LIST, len(ids) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    score = np.take_along_axis(s, near, 1)
    ok = (score >= FLOOR) | (score == score.max(axis=1, keepdims=True)) if bars is None else score > bars[order][:, None]
    found = [(ids[np.nonzero(ok)[0]], ids[near[ok]], score[ok], np.zeros(int(ok.sum()), bool))]
    a, b = forest(s >= THRESHOLD)
    if len(a):
        found.append((ids[a], ids[b], s[a, b], np.ones(len(a), bool)))
    return found


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a spanning forest of a symmetric matrix of links, from the first nodes on."""
    free = linked.any(axis=1)
    a, b = [], []
    for root in np.flatnonzero(free):
        if not free[root]:
            continue
        free[root] = False
        waiting = [root]
        while waiting:
            u = waiting.pop()
            new = np.flatnonzero(linked[u] & free)
            free[new] = False
            a.append(np.full(len(new), u))
            b.append(new)
            waiting.extend(new)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def frame(found: list[tuple]) -> pd.DataFrame:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], [], []]
    return pd.DataFrame(dict(zip("a b s tie".split(), columns, strict=True)))


def runs(*keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by keys, and where in it runs of equal keys begin, with the end."""
    values = [k.to_numpy() for k in keys]
    order = np.lexsort(values)
    new = np.zeros(len(order), bool)
    for v in values:
        new[1:] |= v[order][1:] != v[order][:-1]
    return order, np.concatenate([[0], np.flatnonzero(new), [len(order)]])


def n_tables(bits: int) -> int:
    """Tables of so many bits that miss a pair at THRESHOLD with a probability of 1 - TABLE_RECALL."""
    same = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    return int(np.ceil(np.log(1 - TABLE_RECALL) / np.log(1 - same)))


def in_blocks(parted: DataFrame, keys: list[str], length: int) -> DataFrame:
    """PAIRS of all rows of ``parted`` (keys, parts, vec_id, v) with equal keys: its parts meet pair by pair."""
    part = F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.col("parts")).cast("int")
    met = parted.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select(*keys, F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "vec_id", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame(pairs_in(pdf["vec_id"].to_numpy(), matrix(pdf["v"], length)))

    return met.groupBy(*keys, "x", "y").applyInPandas(compare, PAIRS)


def first_pairs(rows: DataFrame, n: int, length: int, seed: int) -> DataFrame:
    bits = max(1, int(np.ceil(np.log2(max(n, 2) / BUCKET))))
    tables = n_tables(bits)
    planes = np.random.default_rng(seed).standard_normal((tables, bits, length))

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(bits)
        for pdf in batches:
            x = matrix(pdf["v"], length)
            for t in range(tables):
                yield pd.DataFrame({"t": t, "bucket": ((x @ planes[t].T) > 0) @ weights, "vec_id": pdf["vec_id"], "v": pdf["v"]})

    dealt = rows.select("vec_id", "v").mapInPandas(buckets, "t int, bucket long, vec_id long, v binary")
    sizes = rows.select("vec_id", "v").mapInPandas(lambda it: (x[["t", "bucket"]] for x in buckets(it)), "t int, bucket long").groupBy("t", "bucket").agg(F.count("*").alias("n"))
    # At most one in PART of all rows of buckets, so small enough to be sent to all tasks: vectors are shuffled once.
    crowded = F.broadcast(cut(sizes.where(F.col("n") > PART).select("t", "bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts"))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        order, at = runs(pdf["t"], pdf["bucket"])
        ids, x = pdf["vec_id"].to_numpy()[order], matrix(pdf["v"], length)[order]
        return frame([f for i, j in zip(at[:-1], at[1:], strict=True) for f in pairs_in(ids[i:j], x[i:j])])

    call = F.pmod(F.xxhash64("t", "bucket"), F.lit(max(1, n * tables // CALL_ROWS))).alias("call")
    calm = dealt.join(crowded, ["t", "bucket"], "left_anti").groupBy(call).applyInPandas(compare, PAIRS)
    return calm.unionByName(in_blocks(dealt.join(crowded, ["t", "bucket"]), ["t", "bucket"], length))


def shorten(pairs: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """The nearest of each list: LIST, or up to ``long_list`` where those are all linked."""
    near = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    ranked = pairs.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= long_list)
    return ranked.where((F.col("rank") <= LIST) | (F.col("s") >= THRESHOLD)).select("a", "b", "s")


def descend(lists: DataFrame, rows: DataFrame, n: int, length: int) -> DataFrame:
    """PAIRS that better lists, and the ties, after all neighbours of each vector have met."""
    def nearest(of: str, other: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(of).orderBy(F.desc("s"), other))
        return lists.withColumn("rank", rank).where((F.col("rank") <= WEAK) | (F.col("rank") <= LONG_LIST) & (F.col("s") >= FLOOR)).select(F.col(of).alias("a"), F.col(other).alias("b"))

    size, worst = F.count("*"), F.min("s")
    bars = lists.groupBy(F.col("a").alias("vec_id")).agg(F.when(size >= LONG_LIST, worst).when(size >= LIST, F.least(worst, F.lit(THRESHOLD))).alias("bar"))
    known = rows.join(bars, "vec_id", "left").select(F.col("vec_id").alias("b"), "v", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
    met = nearest("a", "b").unionByName(nearest("b", "a")).distinct().join(known, "b")

    def introduce(pdf: pd.DataFrame) -> pd.DataFrame:
        order, at = runs(pdf["a"])
        ids, x, bar = pdf["b"].to_numpy()[order], matrix(pdf["v"], length)[order], pdf["bar"].to_numpy()[order]
        return frame([f for i, j in zip(at[:-1], at[1:], strict=True) for f in pairs_in(ids[i:j], x[i:j], bar[i:j])])

    call = F.pmod(F.xxhash64("a"), F.lit(max(1, n * 2 * WEAK // CALL_ROWS))).alias("call")
    return met.groupBy(call).applyInPandas(introduce, PAIRS)


def split(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists and ties of PAIRS."""
    return pairs.where("not tie").select("a", "b", "s"), pairs.where("tie").select("a", "b").distinct()


def missed(rows: DataFrame, components: DataFrame, n: int, length: int, audit: int = 0) -> float:
    """Share of the links of a vector that its component lacks, on average over all linked vectors; of large components or of the others, whichever is more.

    Vectors of large components, of others, and those without a link yet are drawn apart, others at each audit.
    """
    sizes = components.groupBy("component").agg((F.count("*") >= LARGE * n).alias("large"))
    named = rows.join(components.withColumnRenamed("node", "vec_id").join(sizes, "component"), "vec_id", "left")
    kind = F.when(F.col("component").isNull(), 0).when(F.col("large"), 2).otherwise(1)
    named = cut(named.select("vec_id", "v", kind.alias("kind"), F.coalesce("component", "vec_id").alias("component")))
    totals = {r["kind"]: r["count"] for r in named.groupBy("kind").count().collect()}
    audited = [r for k in sorted(totals) for r in named.where(F.col("kind") == k).orderBy(F.xxhash64(F.lit("audit"), F.lit(audit), "vec_id"), "vec_id").limit(AUDIT_ROWS).collect()]  # a fixed number of rows
    x, ids, groups = np.stack([np.frombuffer(bytes(r["v"])) for r in audited]), np.array([r["vec_id"] for r in audited]), np.array([r["component"] for r in audited])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, apart = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for pdf in batches:
            linked = (x @ matrix(pdf["v"], length).T >= THRESHOLD) & (ids[:, None] != pdf["vec_id"].to_numpy()[None, :])
            links += linked.sum(axis=1)
            apart += (linked & (groups[:, None] != pdf["component"].to_numpy()[None, :])).sum(axis=1)
        yield pd.DataFrame({"i": np.arange(len(ids)), "links": links, "apart": apart})

    found = named.mapInPandas(compare, "i int, links long, apart long").groupBy("i").agg(F.sum("links").alias("links"), F.sum("apart").alias("apart")).collect()
    lost, all_linked = {}, {}
    kinds = [r["kind"] for r in audited]
    for r in found:
        k = kinds[r["i"]]
        weight = totals[k] / kinds.count(k)
        if r["links"]:
            lost[k // 2] = lost.get(k // 2, 0) + weight * r["apart"] / r["links"]
            all_linked[k // 2] = all_linked.get(k // 2, 0) + weight
    return max((lost[k] / all_linked[k] for k in lost), default=0.0)


def count_links(rows: DataFrame, components: DataFrame, length: int) -> DataFrame:
    """vec_id and n_links, of all pairs within a component, by copies: blocks of a component meet pair by pair."""
    named = rows.join(components.withColumnRenamed("node", "vec_id"), "vec_id")
    blocks = cut(named.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")))
    named = spread_join(named, blocks, "component").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = named.withColumn("other", other).select(
        "component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "vec_id", "v", "copies"
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        left, right = pdf[pdf["block"] == x], pdf[pdf["block"] == y]
        ids_l, ids_r = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        if not len(ids_l) or not len(ids_r):
            return pd.DataFrame({"vec_id": [], "links": []})
        linked = (matrix(left["v"], length) @ matrix(right["v"], length).T >= THRESHOLD) & (ids_l[:, None] != ids_r[None, :])
        found = [pd.DataFrame({"vec_id": ids_l, "links": linked @ right["copies"].to_numpy()})]
        if x != y:
            found.append(pd.DataFrame({"vec_id": ids_r, "links": left["copies"].to_numpy() @ linked}))
        return pd.concat(found)

    return dealt.groupBy("component", "x", "y").applyInPandas(count, "vec_id long, links long").groupBy("vec_id").agg(F.sum("links").alias("n_links"))


def tied(rows: DataFrame, n: int, length: int, seed: int) -> DataFrame:
    """node and component of all vectors with links."""
    lists, ties = None, None
    for audit in range(AUDITS):
        found, more = split(cut(first_pairs(rows, n, length, seed + audit)))
        lists = cut(shorten(found if lists is None else found.unionByName(lists)))
        ties = more if ties is None else ties.unionByName(more)
        before = lists.agg(F.count("*"), F.sum("s")).first()
        for _ in range(DESCENTS):
            found, more = split(cut(descend(lists, rows, n, length)))
            lists, ties = cut(shorten(lists.unionByName(found))), ties.unionByName(more)
            now = lists.agg(F.count("*"), F.sum("s")).first()
            if abs((now[1] or 0) - (before[1] or 0)) <= 1e-3 * (now[1] or 0):
                break
            before = now
        ties = cut(ties.distinct())
        components = cut(connected_components(ties))
        if missed(rows, components, n, length, audit) <= 1 - AUDIT_RECALL:
            return components
    parts = F.lit(-(-n // PART)).cast("int")
    return cut(connected_components(split(in_blocks(rows.select("vec_id", "v", parts.alias("parts")), [], length))[1]))


def near_vectors(vectors: DataFrame, seed: int = 20260701) -> DataFrame:
    """vec_id, n_links, component_id and kept for each vec_id of ``vectors`` (vec_id, embedding, ...).

    Cosines are taken in double precision. Unusable vectors (see ``packed``) link with nothing and
    are components of their own. Rows of one vec_id are one vector, the one that is smallest as
    bytes; a null vec_id gives a row of nulls with no links that is kept. Extra columns are
    ignored; an empty table gives no rows.
    """
    known, length = packed(vectors, unit=True)
    known = cut(known.groupBy("vec_id").agg(F.min("v").alias("v")))
    rows = cut(known.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    n = rows.count()
    all_ids = vectors.select("vec_id").distinct()
    if n:
        components = tied(rows, n, length, seed)
        classes = rows.join(count_links(rows, components, length), "vec_id", "left").join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        links = F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1
        classes = classes.select("v", links.cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
        counted = all_ids.join(known.join(classes, "v").select("vec_id", "n_links", "component"), "vec_id", "left")
    else:
        counted = all_ids.withColumn("n_links", F.lit(0).cast("long")).withColumn("component", F.col("vec_id"))
    component = F.coalesce("component", "vec_id")
    return counted.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
