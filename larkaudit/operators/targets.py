"""Measurement targets: frequency, specificity, layers, overlap of target sets and their nulls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut
from larkaudit.functions.ranks import first_rank, minmax

#: Entities of a block, and pairs of them that are counted at once.
BLOCK_ENTITIES, PAIRS_AT_ONCE = 16_384, 4_000_000
#: Items of a set whose subsets are counted; larger sets are compared in blocks.
SMALL_SET = 6


def frequency_idf(targets: DataFrame, entity: str = "patient_id", item: str = "gene") -> DataFrame:
    """item, n, fraction, idf and class of each item by how many entities it is a target of."""
    t = targets.select(entity, item).distinct()
    total = t.select(entity).distinct().agg(F.count("*").alias("_n"))
    g = t.groupBy(item).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    g = g.withColumn("fraction", F.col("n") / F.col("_n")).withColumn("idf", F.log((1.0 + F.col("_n")) / (1.0 + F.col("n"))) + 1)
    return g.withColumn("class", F.when(F.col("fraction") >= 0.25, "generic").when(F.col("fraction") >= 0.1, "recurrent").otherwise("specific")).drop("_n")


def specificity(targets: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Adds each target's idf scaled to 0..1 over items, class, base priority scaled within the patient, and adjusted priority."""
    targets = cut(targets)  # read for frequencies, limits, totals and scores
    f = cut(frequency_idf(targets))
    lim = f.agg(F.min("idf").alias("_lo"), F.max("idf").alias("_hi"))
    f = f.crossJoin(F.broadcast(lim))  # one row
    f = f.withColumn("idf01", F.when(F.col("_hi") <= F.col("_lo"), 0.5).otherwise((F.col("idf") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))))
    t = targets.join(f.select("gene", "fraction", "idf", "idf01", "class"), "gene").withColumn("base", minmax("priority", ["patient_id"]))
    return t.withColumn("adjusted", F.round(F.col("base") * (1 - alpha + alpha * (0.5 + 0.5 * F.col("idf01"))), 9))


def rerank(scored: DataFrame, k: int = 20, support: str | None = None) -> DataFrame:
    """Targets ranked k or better within the patient; the support filter comes after the ranking."""
    r = scored.withColumn("rank", first_rank(["patient_id"], F.desc("adjusted"), F.asc("gene"))).where(F.col("rank") <= k)
    return r.where(support) if support else r


def alpha_sensitivity(targets: DataFrame, alphas: list[float], k: int = 20) -> DataFrame:
    """Overlap with the list at alpha 0, by alpha: mean share of its targets that stay.

    All lists are ranked in the patient's own rows, which are not multiplied by the alphas.
    """
    value = lambda a: F.round(F.col("base") * (1 - a + a * (0.5 + 0.5 * F.col("idf01"))), 9)
    s = specificity(targets, 1.0).select("patient_id", "gene", "base", "idf01")
    kept = first_rank(["patient_id"], F.desc("_v"), F.asc("gene")) <= k
    for i, a in enumerate([0.0, *alphas]):
        s = s.withColumn("_v", value(F.lit(a))).withColumn(f"_k{i}", kept)
    both = [F.sum(F.when(F.col("_k0") & F.col(f"_k{i + 1}"), 1).otherwise(0)).alias(f"_h{i}") for i in range(len(alphas))]
    p = s.groupBy("patient_id").agg(F.sum(F.when(F.col("_k0"), 1).otherwise(0)).alias("_n"), *both)
    p = p.select("_n", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"_h{i}").alias("_h")) for i, a in enumerate(alphas)])).alias("_x"))
    return p.groupBy("_x.alpha").agg(F.avg(F.col("_x._h") / F.col("_n")).alias("kept"), F.count("*").alias("n_patients"))


def layers(scored: DataFrame, quotas: dict[str, int], total: int = 20) -> DataFrame:
    """The best targets of each class within its quota, then at most ``total`` a patient."""
    r = scored.withColumn("layer_rank", first_rank(["patient_id", "class"], F.desc("adjusted"), F.asc("gene")))
    keep = F.lit(False)
    for name, k in quotas.items():
        keep = keep | ((F.col("class") == name) & (F.col("layer_rank") <= k))
    return r.where(keep).withColumn("rank", first_rank(["patient_id"], F.desc("adjusted"), F.asc("gene"))).where(F.col("rank") <= total)


def _jaccard_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """Sum of the Jaccard indices of all pairs of entities of two blocks (or of one block) that share an item.

    The first block's entities go in stripes of bounded pairs, so an item that all entities have costs time, not memory.
    """
    low, high = key[-2:]
    lists = block["items"].to_list()
    length, sizes = np.array([len(x) for x in lists], np.int64), block["size"].to_numpy(np.int64)
    item = pd.factorize(np.concatenate(lists))[0] if length.sum() else np.zeros(0, np.int64)
    entity, of_low = np.repeat(np.arange(len(lists)), length), (block["block"] == low).to_numpy()
    of_high = (block["block"] == high).to_numpy()
    kept = of_high[entity]
    order = np.argsort(item[kept], kind="stable")
    theirs = entity[kept][order]
    n = int(item.max(initial=-1)) + 1
    count = np.bincount(item[kept], minlength=n)
    begin = np.cumsum(count) - count
    mine, wanted = entity[of_low[entity]], item[of_low[entity]]
    pairs = count[wanted]
    ends = np.append(np.flatnonzero(np.diff(mine)) + 1, len(mine)) if len(mine) else np.zeros(0, np.int64)
    done, at, value = np.concatenate([[0], np.cumsum(pairs)]), 0, 0.0
    while at < len(mine):
        # Whole entities, one at least.
        first = np.searchsorted(ends, at, side="right")
        last = max(first, int(np.searchsorted(done[ends], done[at] + PAIRS_AT_ONCE, side="right")) - 1)
        stop = int(ends[last])
        each = pairs[at:stop]
        x = np.repeat(mine[at:stop], each)
        y = theirs[np.repeat(begin[wanted[at:stop]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        if low == high:
            x, y = x[x < y], y[x < y]
        code, base = (x - mine[at]) * len(lists) + y, int(mine[at])
        cells = (int(mine[stop - 1]) - base + 1) * len(lists)
        if cells <= 2 * len(code):
            shared = np.bincount(code, minlength=cells)
            code = np.flatnonzero(shared)
            shared = shared[code]
        else:
            code, shared = np.unique(code, return_counts=True)
        value += float((shared / (sizes[code // len(lists) + base] + sizes[code % len(lists)] - shared)).sum())
        at = stop
    return pd.DataFrame([[*key[:-2], value]], columns=[*(f"k{i}" for i in range(len(key) - 2)), "jaccard"])


def _by_blocks(sets: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """keys and _j by pairs of blocks of some BLOCK_ENTITIES entities of one key.

    So neither an item that every entity has nor a large key is the work of one task. An entity goes, as one row, to as many
    tasks as there are blocks: the shuffle grows with the square of the entities, as the pairs do.
    """
    n = sets.select(entity).distinct().count()
    blocks = max(1, -(-n // BLOCK_ENTITIES))
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = sets.select(*named, "items", "size", F.expr(f"pmod(xxhash64({entity}), {blocks})").alias("block"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("low", F.least("block", "_o")).withColumn("high", F.greatest("block", "_o"))
    kind = ", ".join([f"k{i} {sets.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)] + ["jaccard double"])
    sums = rows.groupBy(*[f"k{i}" for i in range(len(keys))], "low", "high").applyInPandas(_jaccard_block, kind)
    return sums.groupBy(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]).agg(F.sum("jaccard").alias("_j"))


def _by_subsets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """keys and _j from counts of common subsets: no pair is made, whatever items are common.

    Sets of x and y items that share i have C(i, s) common subsets of s items. So the number of pairs that share exactly i is
    an alternating sum of the pairs that each subset is common to, and their Jaccard index goes by i, x and y alone.
    """
    share = lambda s, both: sum((-1) ** (s - i) * math.comb(s, i) * i / (both - i) for i in range(1, s + 1))
    weights = F.create_map(*[F.lit(v) for s in range(1, SMALL_SET + 1) for both in range(2 * s, 2 * SMALL_SET + 1) for v in (100 * s + both, share(s, both))])
    subset = lambda m: F.filter("items", lambda _, i: F.call_function("bit_get", m, i) == 1)
    masks = F.sequence(F.lit(1).cast("long"), (F.call_function("shiftleft", F.lit(1).cast("long"), F.size("items")) - 1).cast("long"))
    subsets = sets.where(F.size("items") > 0).select(*keys, "size", F.explode(F.transform(masks, subset)).alias("subset"))
    counts = subsets.groupBy(*keys, "subset", "size").agg(F.count("*").alias("n"))
    found = counts.groupBy(*keys, "subset").agg(F.collect_list(F.struct("size", "n")).alias("c")).where(F.expr("size(c) > 1 or c[0].n > 1"))
    pair = F.struct((F.col("a.size") + F.col("b.size")).alias("both"), F.when(F.col("a.size") == F.col("b.size"), div_two(F.col("a.n"))).otherwise(F.col("a.n") * F.col("b.n")).alias("pairs"))
    found = found.select(*keys, F.size("subset").alias("s"), "c", F.explode("c").alias("a")).select(*keys, "s", "a", F.explode("c").alias("b")).where("a.size <= b.size")
    sums = found.select(*keys, "s", pair.alias("p")).groupBy(*keys, "s", "p.both").agg(F.sum("p.pairs").alias("pairs"))
    return sums.groupBy(*keys).agg(F.sum(F.col("pairs") * F.element_at(weights, (100 * F.col("s") + F.col("both")).cast("int"))).alias("_j"))


def div_two(n: Column) -> Column:
    """Pairs of n."""
    return F.call_function("div", n * (n - 1), F.lit(2))


def metrics_of_sets(sets: DataFrame, entity: str = "patient_id", keys: list[str] | None = None) -> DataFrame:
    """``set_metrics`` of ``sets`` (keys, entity, size, items: an array of distinct items), written already."""
    keys = keys or []
    most = sets.agg(F.max("size")).first()[0] or 0
    jaccard = _by_subsets(sets, keys) if most <= SMALL_SET else _by_blocks(sets, entity, keys)
    whole = sets.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("size").alias("mean_size"))
    # Null items are known by sizes only.
    items = sets.select(*keys, F.explode(F.when(F.size("items") < F.col("size"), F.concat("items", F.array(F.lit(None)))).otherwise(F.col("items"))).alias("_item"))
    items = items.groupBy(*keys, "_item").agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.max("_c").alias("_m"), F.count("*").alias("n_items"))
    if keys:
        out = whole.join(items, keys).join(jaccard, keys, "left")
    else:
        out = whole.crossJoin(items).crossJoin(jaccard)  # one row each
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    out = out.withColumn("mean_jaccard", F.try_divide(F.coalesce("_j", F.lit(0.0)), pairs)).withColumn("max_recurrence", F.col("_m") / F.col("_n"))
    return out.select(*keys, "mean_jaccard", (1 - F.col("mean_jaccard")).alias("dissimilarity"), "max_recurrence", "mean_size", "n_items")


def set_metrics(sets: DataFrame, entity: str = "patient_id", item: str = "gene", keys: list[str] | None = None) -> DataFrame:
    """Mean Jaccard index over all pairs of entities, largest share of an item, mean size, number of items.

    Pairs that share nothing add nothing to the sum and are counted, not made.
    """
    by = [*(keys or []), entity]
    found = sets.groupBy(*by).agg(F.collect_set(F.struct(F.col(item).alias("i"))).alias("_s"))
    found = found.select(*by, F.size("_s").alias("size"), F.array_sort(F.filter(F.col("_s.i"), lambda x: x.isNotNull())).alias("items"))
    return metrics_of_sets(cut(found), entity, keys)


def null_compare(nulls: DataFrame, observed: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """observed, null mean and sd, z, and lower, upper and two-sided shares by metric; shares count the observation itself."""
    o = observed.select(metric, F.col(value).alias("observed"))
    n = nulls.join(F.broadcast(o), metric)  # one row a metric
    mean = nulls.groupBy(metric).agg(F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"))
    n = n.join(F.broadcast(mean), metric)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = n.groupBy(metric).agg(
        F.first("observed").alias("observed"), F.first("null_mean").alias("null_mean"), F.first("null_sd").alias("null_sd"), F.count("*").alias("n"),
        count(F.col(value) <= F.col("observed")).alias("_l"), count(F.col(value) >= F.col("observed")).alias("_u"),
        count(F.abs(F.col(value) - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean"))).alias("_t"),
    )
    share = lambda c: (1.0 + F.col(c)) / (1.0 + F.col("n"))
    return g.select(
        metric, "observed", "null_mean", "null_sd", F.try_divide(F.col("observed") - F.col("null_mean"), "null_sd").alias("z"),
        share("_l").alias("p_lower"), share("_u").alias("p_upper"), share("_t").alias("p_two_sided"), "n",
    )
