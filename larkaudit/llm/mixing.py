"""Mixing sources to target weights, by blocks of words, with DataFrame functions only.

The words of each source, its documents laid end to end, are packed into blocks of fixed length.
The mix has as many slots as the targets ask for, in output shards. Each shard draws multinomial
counts of the sources by their weights: every slot draws for itself, and the draws are counted. The
sum of a source's counts misses its total by some square root of it, so the last draws of sources
with too many go to those with too few. Counts number a source's slots; a number is mapped through
a pseudorandom permutation of the source's blocks, pass after pass, and blocks are joined by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.llm.common import WORD, cut, shuffled, word_count

#: Words in a block, slots in an output shard, and times that a source may be repeated.
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
MOST_REPEATS = 3
#: Documents that are laid end to end within one group, and groups summed up together.
GROUP_DOCS = 200
RANGE_GROUPS = 512
#: Slots that one row of the table of source ranges stands for.
CELL = 4096
SEED = 20260701
#: Two hashes of all columns of a row, which name it where doc_id is null or repeated.
ROW = ["_row", "_row2"]


def div(a: Column, b: Column | int) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("long")


def _rounds(v: Column, n: Column, key: list[Column]) -> Column:
    """The image of v, by lambda functions; for the few images that lie beyond n."""
    width = F.least(F.lit(64).cast("long"), n)
    height = div(n + width - 1, width)

    def both(state: Column, k: Column) -> Column:
        y = F.pmod(state["y"] + F.pmod(F.xxhash64(state["x"], k, F.lit(SEED), *key), height), height)
        half = F.array(F.struct(state["x"].alias("x"), y.alias("y")))
        return F.transform(half, lambda s: F.struct(F.pmod(s["x"] + F.pmod(F.xxhash64(s["y"], k, F.lit(~SEED), *key), width), width).alias("x"), s["y"].alias("y")))[0]

    start = F.struct(F.pmod(v, width).alias("x"), div(v, width).alias("y"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, both)
    return F.aggregate(F.array(end), F.lit(0).cast("long"), lambda _, s: s["y"] * width + s["x"])


def with_permuted(df: DataFrame, name: str, i: Column, n: Column, *key: Column) -> DataFrame:
    """``df`` with the column ``name``: where a pseudorandom permutation of 0 .. n-1 sends i; ``key`` picks the permutation.

    Four Feistel rounds over a grid of at most 64 columns that holds all n indices, a column step
    each. An image in one of the fewer than 64 cells beyond is sent on until it lies within, so this
    is a bijection; only such images are sent on.
    """
    df = df.withColumns({"_n": n, "_i": i}).withColumn("_w", F.least(F.lit(64).cast("long"), F.col("_n")))
    df = df.withColumn("_h", div(F.col("_n") + F.col("_w") - 1, F.col("_w"))).withColumns({"_x": F.pmod("_i", "_w"), "_y": div(F.col("_i"), F.col("_w"))})
    for k in range(1, 5):
        df = df.withColumn("_y", F.pmod(F.col("_y") + F.pmod(F.xxhash64("_x", F.lit(k), F.lit(SEED), *key), F.col("_h")), F.col("_h")))
        df = df.withColumn("_x", F.pmod(F.col("_x") + F.pmod(F.xxhash64("_y", F.lit(k), F.lit(~SEED), *key), F.col("_w")), F.col("_w")))
    df = df.withColumn("_v", F.col("_y") * F.col("_w") + F.col("_x"))
    beyond = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.col("_v"), lambda v, _: F.when(v < F.col("_n"), v).otherwise(_rounds(v, F.col("_n"), list(key))))
    return df.withColumn(name, F.when(F.col("_v") < F.col("_n"), F.col("_v")).otherwise(beyond)).drop("_n", "_i", "_w", "_h", "_x", "_y", "_v")


def source_targets(sizes: DataFrame) -> DataFrame:
    """src, source_size and target for each source of ``sizes`` (src, source, size).

    In code point order, null last, sources weigh 1, 2, 3, 1, ... and share all words by weight; a
    target stops at MOST_REPEATS times its source's size, and what is over goes to the others by
    weight until none is above. One row a source, so the windows over all of them stay small.
    """
    by = sizes.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by = by.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    by = (
        by.withColumn("most", F.col("source_size") * MOST_REPEATS)
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("given", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("others", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("share", (F.col("all_words") - F.col("given")) / F.col("others"))
        .withColumn("full", F.col("share") * F.col("weight") >= F.col("most"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("share"))).over(everything))
    )
    most = F.col("most").cast("double")
    return by.select("src", "source_size", F.when(F.col("full"), most).otherwise(F.least(most, F.col("level") * F.col("weight"))).alias("target"))


def before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, of equal keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def before_by_ranges(df: DataFrame, keys: list[str], step: str, value: str, name: str) -> DataFrame:
    """As ``before`` in the order of ``step``: over RANGE_GROUPS steps, and over the sums of such ranges, so no key's rows gather."""
    df = df.withColumn("_rng", div(F.col(step), RANGE_GROUPS))
    of_range = before(df.groupBy(*keys, "_rng").agg(F.sum(value).alias("_all")), keys, ["_rng"], "_all", "_base").drop("_all")
    within = before(df, [*keys, "_rng"], [step], value, "_in")
    return within.join(shuffled(of_range), [*keys, "_rng"]).withColumn(name, F.col("_in") + F.col("_base")).drop("_rng", "_in", "_base")


def lay_out(docs: DataFrame) -> DataFrame:
    """One row a document with the place of its words in its source: doc_id, src, size, at, source_size, target, blocks, slots.

    Running sums go over groups of some GROUP_DOCS documents, over ranges of groups and over the
    ranges of a source, so that a source with a third of all rows is spread over many tasks. The
    columns of ROW are kept where ``docs`` has them.
    """
    row = [c for c in ROW if c in docs.columns]
    source = F.col("source")
    sizes = cut(
        docs.select(
            "doc_id",
            source,
            F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source)).alias("src"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")).alias("mixed"),
            *row,
        )
    )
    groups = max(1, sizes.count() // GROUP_DOCS)
    sizes = sizes.withColumn("grp", F.pmod(F.col("mixed"), F.lit(groups)))
    per_group = before_by_ranges(sizes.groupBy("src", "grp").agg(F.sum("size").alias("words")), ["src"], "grp", "words", "start")
    starts = per_group.join(source_targets(sizes), "src").select("src", "grp", "start", "source_size", "target")
    laid = before(sizes, ["src", "grp"], ["mixed", "doc_id", "size", *row], "size", "at_doc").join(shuffled(starts), ["src", "grp"])
    blocks = div(F.col("source_size") + BLOCK_WORDS - 1, BLOCK_WORDS)
    wanted = F.round(F.col("target") * blocks / F.greatest(F.col("source_size"), F.lit(1)), 0).cast("long")
    return cut(
        laid.select(
            "doc_id", "source", "src", "size", (F.col("start") + F.col("at_doc")).alias("at"), "source_size", "target",
            blocks.alias("blocks"), F.least(blocks * MOST_REPEATS, wanted).alias("slots"), *row,
        )
    )


def slot_totals(laid: DataFrame) -> tuple[DataFrame, int]:
    """src, blocks, slots and the range low .. high - 1 of each source among all slots, one row a source, and the sum of slots."""
    sources = laid.where("slots > 0").groupBy("src").agg(F.max("blocks").alias("blocks"), F.max("slots").alias("slots"))
    sources = cut(before(sources, [], ["src"], "slots", "low").withColumn("high", F.col("low") + F.col("slots")))
    return sources, sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]


def in_cells(points: DataFrame, at: str, ranges: DataFrame) -> DataFrame:
    """``points`` joined with the one of ``ranges`` (low, high, ...) that holds column ``at``, by cells of CELL numbers."""
    cells = ranges.where("high > low").withColumn("_cell", F.explode(F.sequence(div(F.col("low"), CELL), div(F.col("high") - 1, CELL))))
    return points.withColumn("_cell", div(F.col(at), CELL)).join(shuffled(cells), "_cell").where(f"{at} >= low and {at} < high").drop("_cell")


def draw_counts(sources: DataFrame, total: int) -> DataFrame:
    """shard, src and drawn: multinomial counts of the sources in each shard of SHARD_SLOTS slots, by their shares of all slots."""
    draws = sources.sparkSession.range(total).select(
        div(F.col("id"), SHARD_SLOTS).alias("shard"), F.pmod(F.xxhash64(F.lit(SEED), F.lit("draw"), "id"), F.lit(max(total, 1)).cast("long")).alias("draw")
    )
    return in_cells(draws, "draw", sources.select("src", "low", "high")).groupBy("shard", "src").agg(F.count("*").alias("drawn"))


def shard_counts(sources: DataFrame, total: int) -> DataFrame:
    """shard, src, first and n: the numbers first .. first + n - 1 of each source's slots that a shard holds, corrected to the totals.

    A source's draws are numbered through the shards. Those numbered beyond its slots are surplus and
    go, in order, to the slots for which the sources that drew too few have no draw; a shard keeps its size.
    """
    drawn = cut(before_by_ranges(draw_counts(sources, total), ["src"], "shard", "drawn", "first"))
    numbered = drawn.join(sources.select("src", "slots"), "src")
    own = F.greatest(F.least("drawn", F.col("slots") - F.col("first")), F.lit(0))
    numbered = numbered.withColumn("n", own).withColumn("surplus", F.col("drawn") - F.col("n"))
    over = numbered.where("surplus > 0").groupBy("shard").agg(F.sum("surplus").alias("surplus"))
    over = before_by_ranges(over.withColumn("one", F.lit(1)), ["one"], "shard", "surplus", "at")
    over = over.select("shard", F.explode(F.sequence("at", F.col("at") + F.col("surplus") - 1)).alias("at"))
    got = drawn.groupBy("src").agg(F.sum("drawn").alias("got"))
    short = sources.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).withColumn("lacks", F.greatest(F.col("slots") - F.col("got"), F.lit(0)))
    short = before(short.select("src", "got", "lacks"), [], ["src"], "lacks", "low").withColumn("high", F.col("low") + F.col("lacks"))
    moved = in_cells(over, "at", short).select("shard", "src", (F.col("got") + F.col("at") - F.col("low")).alias("first"), F.lit(1).cast("long").alias("n"))
    return numbered.where("n > 0").select("shard", "src", "first", "n").unionByName(moved)


def draw_slots(laid: DataFrame) -> DataFrame:
    """shard, src, pass and block for each slot of the mix."""
    sources, total = slot_totals(laid)
    slots = shard_counts(sources, total).withColumn("number", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    slots = slots.join(sources.select("src", "blocks"), "src")
    slots = with_permuted(slots, "block", F.pmod("number", "blocks"), F.col("blocks"), F.col("src"))
    return slots.select("shard", "src", div(F.col("number"), F.col("blocks")).alias("pass"), "block")


def block_spans(laid: DataFrame) -> DataFrame:
    """src, block, at, doc_id and the words first .. first + words - 1 of the document that lie in the block."""
    end = F.col("at") + F.col("size")
    block = F.col("block") * BLOCK_WORDS
    begin = F.greatest(block, F.col("at"))
    return (
        laid.where("size > 0 and slots > 0")
        .withColumn("block", F.explode(F.sequence(div(F.col("at"), BLOCK_WORDS), div(end - 1, BLOCK_WORDS))))
        .select("src", "block", "at", "doc_id", (begin - F.col("at")).alias("first"), (F.least(block + BLOCK_WORDS, end) - begin).alias("words"), *[c for c in ROW if c in laid.columns])
    )


def mix(laid: DataFrame) -> DataFrame:
    """The mix: shard, src, pass, block, at, doc_id, first, words for each span of each slot."""
    return draw_slots(laid).join(shuffled(block_spans(laid)), ["src", "block"])


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of ``docs`` (doc_id, text, source, ...).

    Null and empty texts have size 0 and give nothing; a null source is a source of its own, last
    in order. Repeated rows count as so many documents; a null doc_id stays null. Extra columns are
    ignored; an empty table gives no rows. Reruns give the same mix.
    """
    laid = lay_out(docs)
    taken = mix(laid).groupBy("src", "at").agg(F.sum("words").alias("taken"))
    some = laid.where("size > 0").join(shuffled(taken), ["src", "at"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    none = laid.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return some.select(columns).unionByName(none.select(columns))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Documents as the mix has them: the columns of ``docs`` (doc_id, text, source, n_chars, ...), a row for each pass.

    A document that a pass takes whole keeps its text; else the words taken, in order, are joined
    by blanks. Documents of which nothing is taken go, as do null and empty texts, which have no
    words. Each row counts for itself, whether its doc_id is null or repeated; rows that are equal
    throughout have places of their own in the mix. An empty table gives no rows.
    """
    named = docs.withColumns({ROW[0]: F.xxhash64(*docs.columns), ROW[1]: F.xxhash64(F.lit(SEED), *docs.columns)})
    spans = mix(lay_out(named)).groupBy(*ROW, "pass", "at").agg(F.sum("words").alias("_taken"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_spans")).drop("pass", "at")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = named.dropDuplicates(ROW).join(shuffled(spans), ROW).withColumn("_words", words)
    picked = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(F.col("_words"), (s["first"] + 1).cast("int"), s["words"].cast("int")))), " ")
    text = F.when(F.col("_taken") >= F.size("_words"), F.col("text")).otherwise(picked)
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
