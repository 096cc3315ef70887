"""How the sources of a language differ in their words: count vectors, sums by source, sparse pairs.

Each text becomes its exact sparse count vector. A language's vocabulary holds the terms of at least
MIN_DF of its documents, however many they are, and is a table like all others: it is neither collected
nor broadcast, so it may grow with the corpus. Vectors are summed by source, and pairs of sources are
compared in blocks of terms and sources that hold only terms which one of the sources has; all other
terms have the same shares, so they add one product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.llm.common import bounded_batches, cut, discard, new_path, spread_join, written
from larkaudit.llm.shingles import encoded

MIN_DF = 10
TOP_TERMS = 10
#: A share is counted in units of 1 / SCALE.
SCALE = 1_000_000_000
#: Added to each count, and twice for each term to the sum.
PRIOR = 2
#: Terms and sources of a block.
BLOCK_TERMS, BLOCK_SOURCES = 256, 64
#: Bytes of a text that are no letters become blanks; A to Z become small; bytes of letters beyond ASCII stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
VECTOR = pa.list_(pa.struct([("term", pa.string()), ("hits", pa.int64())]))


def count_vector(text: Column) -> Column:
    """Term and hits of each distinct term of a text: runs of letters, A to Z in lower case, and of characters beyond ASCII."""

    @F.arrow_udf("array<struct<term:string,hits:long>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            terms, hits, ends = [], [], [0]
            for t in texts.to_pylist():
                vector = Counter(encoded(t).translate(TERM_BYTES).split())
                terms.extend(vector.keys())
                hits.extend(vector.values())
                ends.append(len(terms))
            entries = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(hits, pa.int64())], ["term", "hits"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries).cast(VECTOR)

    return counted(text)


def count_vectors(docs: DataFrame) -> DataFrame:
    """``docs`` with the sparse count vector of ``text`` in column vector (replaced if there is one)."""
    bounded_batches(docs.sparkSession)
    kept = [F.col(c) for c in docs.columns if c.lower() != "vector"]
    return docs.select(*kept, count_vector(F.col("text")).alias("vector"))


def group_sums(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, hits and docs (vectors with the term): the sum of the vectors of each group."""
    each = vectors.select(*keys, F.explode("vector").alias("_e")).select(*keys, "_e.term", "_e.hits")
    return each.groupBy(*keys, "term").agg(F.sum("hits").alias("hits"), F.count("*").alias("docs"))


def vocabulary(sums: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """lang, term, total (hits in the language) and n (sources with it) of the terms that ``min_df`` documents of the language have."""
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("total"), F.count("*").alias("n"))
    return terms.where(F.col("docs") >= min_df).drop("docs")


def share(hits: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE (hits + 2) / (total + 2 terms)), exact in decimals; 1 where there are no terms."""
    wide = f"cast({hits} + {PRIOR} as decimal(19, 0)) * cast({SCALE} as decimal(10, 0))"
    return F.expr(f"case when {terms} = 0 then 1L else 1L + ({wide}) div cast({total} + {PRIOR} * {terms} as decimal(19, 0)) end")


def _block_pairs(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """The part of each source pair's value that the terms of one block give, and how many terms those are.

    Rows without a term are the block's sources, with the share of a term that they do not have.
    """
    lang, size, _, low, high = key
    own = block[block["term"].isna()].drop_duplicates("source").sort_values("source")
    rest = block[block["term"].notna()]
    source, home, none = (own[c].to_numpy() for c in ("source", "block", "p"))
    terms, names = pd.factorize(rest["term"])
    shares = np.tile(none, (len(names), 1))
    shares[terms, pd.Index(source).get_indexer(rest["source"])] = rest["p"].to_numpy()
    out = {"source": [], "item": [], "value": [], "absent": []}
    right = np.flatnonzero(home == high)
    for i in np.flatnonzero(home == low):
        others = right[right > i] if low == high else right
        p, q = shares[:, [i]], shares[:, others]
        value, absent = ((p - q) ** 2 // (p + q)).sum(axis=0), (none[i] - none[others]) ** 2 // (none[i] + none[others])
        one = np.repeat(source[i], len(others))
        for name, both in zip(out, ((one, source[others]), (source[others], one), (value, value), (absent, absent)), strict=True):
            out[name].extend(both)
    found = {k: np.concatenate(v) if v else np.zeros(0, object if k in ("source", "item") else np.int64) for k, v in out.items()}
    return pd.DataFrame(found).assign(lang=lang, terms=len(names), size=size)[["lang", "source", "item", "value", "absent", "terms", "size"]]


def pair_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language) and value: differences summed over all terms of the language.

    ``entries``: lang, source, term and p of the terms that a source has; ``groups``: lang, source and
    none, the share of a term that it does not have. Both with terms and sources, the language's numbers of them.
    """
    blocks, chunks = f"cast(ceil(sources / {BLOCK_SOURCES}) as bigint)", f"greatest(1L, cast(ceil(terms / {BLOCK_TERMS}) as bigint))"
    home = F.expr(f"pmod(xxhash64('block', source), {blocks})").alias("block")
    columns = ["lang", "terms", "source", home, F.expr(blocks).alias("blocks")]
    rows = entries.select(*columns, "term", "p", F.expr(f"pmod(xxhash64('chunk', term), {chunks})").alias("chunk"))
    none = groups.select(*columns, F.lit(None).cast("string").alias("term"), F.col("none").alias("p"), F.explode(F.expr(f"sequence(0L, {chunks} - 1)")).alias("chunk"))
    # An entry goes to its source's block with each block of the language: one for up to BLOCK_SOURCES sources.
    rows = rows.unionByName(none).withColumn("_o", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.withColumn("low", F.least("block", "_o")).withColumn("high", F.greatest("block", "_o")).drop("_o", "blocks")
    parts = rows.groupBy("lang", "terms", "chunk", "low", "high").applyInPandas(_block_pairs, "lang string, source string, item string, value long, absent long, terms long, size long")
    whole = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.max("absent").alias("absent"), F.max("size").alias("size"), F.sum("terms").alias("terms"))
    return whole.select("lang", "source", "item", F.expr("value + (size - terms) * absent").alias("value"))


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """rows of lang, source, item, value with part and their rank in it, up to ``most``; equal values by item."""
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
    return found if most is None else found.where(F.col("rank") <= most)


def divergence(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language are from each other, and by which words.

    A group is a source within a language; null text, lang and source count as ''. With p of a group and
    q of another, of a term, a difference is floor((p - q)^2 / (p + q)), where shares are counted in units of 1e-9. Part
    pair has each other source of the language and the sum over all its terms, 0 where it has none; part
    term the ``top`` terms that the group has more often than its language. Equal values go by item. Texts are
    read whole; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    known = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    spark, all_sums, kept_sums = docs.sparkSession, new_path(docs.sparkSession), new_path(docs.sparkSession)
    sums = written(group_sums(count_vectors(known), ["lang", "source"]), all_sums)
    terms = cut(vocabulary(sums, min_df))
    kept = written(spread_join(sums.select("lang", "source", "term", "hits"), terms, ["lang", "term"]), kept_sums)
    discard(spark, all_sums)  # terms and kept are written: nothing reads it any more
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("terms"))
    groups = known.select("lang", "source").distinct()
    langs = groups.groupBy("lang").agg(F.count("*").alias("n")).join(langs, "lang", "left").withColumn("sources", F.col("n")).na.fill(0)
    own = kept.groupBy("lang", "source").agg(F.sum("hits").alias("group_total"), F.count("*").alias("n"))
    groups = spread_join(groups.join(own, ["lang", "source"], "left").na.fill(0).withColumnRenamed("n", "_n"), cut(langs), ["lang"])
    groups = cut(groups.withColumn("none", share("0", "group_total", "terms")).withColumnRenamed("_n", "n"))
    entries = spread_join(kept, groups, ["lang", "source"])
    entries = cut(entries.withColumn("p", share("hits", "group_total", "terms")).withColumn("q", share("total", "lang_total", "terms")))
    discard(spark, kept_sums)
    above = entries.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    return ranked(pair_values(entries, groups), "pair").unionByName(ranked(above, "term", top))


def oracle(min_df: int = MIN_DF, top: int = TOP_TERMS) -> str:
    p = f"1 + ({SCALE}::hugeint * (n + {PRIOR})) // (total + {PRIOR} * v)"
    return rf"""
    with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
    w as (select id, lang, source, unnest(ts) as term from d),
    v as (select lang, term, count(*) as n from w group by all having count(distinct id) >= {min_df}),
    l as (select lang, sum(n) as total, count(*) as v from v group by lang),
    g as (select distinct lang, source from d),
    c as (select lang, source, term, count(*) as n from w semi join v using (lang, term) group by all),
    s as (select lang, source, sum(n) as total from c group by all),
    p as (select g.lang, g.source, v.term, coalesce(c.n, 0) as n, coalesce(s.total, 0) as total, l.v
          from g join v using (lang) join l using (lang) left join c on (g.lang, g.source, v.term) = (c.lang, c.source, c.term) left join s on (g.lang, g.source) = (s.lang, s.source)),
    gp as (select lang, source, term, n, cast({p} as bigint) as p from p),
    lp as (select lang, term, cast({p} as bigint) as q from v join l using (lang)),
    pairs as (select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) as value
              from g a join g b on a.lang = b.lang and a.source <> b.source
              left join gp x on (a.lang, a.source) = (x.lang, x.source) left join gp y on (b.lang, b.source, x.term) = (y.lang, y.source, y.term) group by all),
    terms as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from gp join lp using (lang, term) where n > 0 and p > q)
    select lang, source, 'pair' as part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pairs
    union all
    select lang, source, 'term', item, cast(value as bigint), cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from terms qualify rank <= {top}
    """
