"""Periodic runs of words: stretches that repeat with a period, found by seeds on diagonals, in NumPy.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that
no neighbouring word extends keeping q. Word i and word i + q are equal all along it, so on the
diagonal of lag q it covers max(6, 4 q) - q positions or more: the overlap that lag guarantees.

Lags are searched in classes. The class that begins at lag m has seeds of k words, the overlap that
m guarantees, and reaches to lag k // 2. Then k >= 2 q for each of its lags q, and two facts follow
from the theorem on words with two periods: within a run of smallest period q the *next* occurrence
of each seed is q words on, and if it is so for one seed of a stretch of the diagonal, then for all.
So neighbouring occurrences are all the pairs there are to look at, the pairs of one stretch lie side
by side on their diagonal, and the smallest period needs no further check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from larkaudit.llm.common import WORD, bounded_batches, fresh
from larkaudit.llm.shingles import blocks, encoded

LEAST_WORDS, LEAST_POWER = 6, 4
RUN = "struct<start:long,length:long,period:long>"
RESULT = f"n_runs long, runs array<{RUN}>, strongest {RUN}, collapsed string"
RESULT_NAMES = ["n_runs", "runs", "strongest", "collapsed"]


def overlap(lag: int) -> int:
    """Positions that a run of this period covers on its diagonal at least."""
    return max(LEAST_WORDS, LEAST_POWER * lag) - lag


class Grams:
    """Names for the k-grams of a sequence: equal names for equal grams; -1 for those that occur once.

    A gram of k words is named by the pair of names of its first and its last j words (j < k <= 2 j),
    so names are exact. Grams that hold a part which occurs once are left out of the sorting.
    """

    def __init__(self, words: np.ndarray):
        self.k, self.names = 1, np.where(np.bincount(words, minlength=len(words))[words] > 1, words, -1)
        self.places = np.flatnonzero(self.names >= 0)
        self.again = np.zeros(0, bool)

    def _step(self, k: int) -> None:
        shift, names = k - self.k, self.names
        p = self.places[self.places < len(names) - shift]
        last = names[p + shift]
        p, last = p[last >= 0], last[last >= 0]
        pairs = names[p] * len(names) + last
        order = np.argsort(pairs, kind="stable")  # equal grams side by side, in order of place
        p, pairs = p[order], pairs[order]
        again = pairs[1:] == pairs[:-1]
        kept = np.concatenate([again, [False]]) | np.concatenate([[False], again]) if len(p) else np.zeros(0, bool)
        p, pairs = p[kept], pairs[kept]
        self.again = pairs[1:] == pairs[:-1]
        first = np.concatenate([[True], ~self.again]) if len(p) else np.zeros(0, bool)
        self.names = np.full(len(names), -1, np.int64)
        self.names[p] = np.cumsum(first) - 1
        self.places, self.k = p, k

    def grow(self, k: int) -> None:
        while self.k < k and len(self.places):
            self._step(min(k, 2 * self.k))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of each gram that occurs again, and how many words on it does."""
        if not len(self.places):
            return self.places, self.places
        return self.places[:-1][self.again], (self.places[1:] - self.places[:-1])[self.again]


def runs_of(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, sorted by start and period; words are numbers below their count."""
    grams, found, lag = Grams(words), [np.zeros((0, 3), np.int64)], 1
    while True:
        k = overlap(lag)
        grams.grow(k)
        if not len(grams.places):
            break
        place, apart = grams.pairs()
        own = (apart >= lag) & (apart <= k // 2)
        found.append(_extended(place[own], apart[own], k))
        lag = k // 2 + 1
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _extended(place: np.ndarray, lag: np.ndarray, k: int) -> np.ndarray:
    """Runs from seed pairs of k words: a pair opens one unless its lag's furthest covered place reaches it."""
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    fresh_ = np.ones(len(place), bool)
    fresh_[1:] = (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + 1)
    opens = np.flatnonzero(fresh_)
    closes = np.append(opens[1:], len(place))[: len(opens)] - 1
    start, period = place[opens], lag[opens]
    length = place[closes] + k - start + period
    runs = np.stack([start, length, period], axis=1)
    return runs[length >= np.maximum(LEAST_WORDS, LEAST_POWER * period)]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def strongest(runs: np.ndarray) -> int:
    """The run with the greatest length / period, compared exactly; of equal ones the first."""
    best = 0
    rows = runs.tolist()
    for i, (_, length, period) in enumerate(rows):
        if length * rows[best][2] > rows[best][1] * period:
            best = i
    return best


def _found(texts: list[bytes]) -> Iterator[tuple[np.ndarray, int, str]]:
    """For each text its runs, which of them is the strongest (-1 without any), and the text of the words that stay."""
    words, ids, bounds = [], [], [0]
    for t in texts:
        own = t.split()  # bytes are split at blank, tab and the line ends of ASCII
        # A word's number is the place where its document has it first, so no gram spans two documents.
        ids.append(np.fromiter(map({}.setdefault, own, count(bounds[-1])), np.int64, len(own)))
        words.append(own)
        bounds.append(bounds[-1] + len(own))
    runs = runs_of(np.concatenate(ids))
    cuts = np.searchsorted(runs[:, 0], bounds)
    for i, own in enumerate(words):
        mine = runs[cuts[i] : cuts[i + 1]] - [bounds[i], 0, 0]
        if len(mine):
            own = [own[j] for j in np.flatnonzero(~dropped(len(own), mine))]
        yield mine, strongest(mine) if len(mine) else -1, b" ".join(own).decode("utf-8", "replace")


def _struct(rows: np.ndarray, mask: np.ndarray | None = None) -> pa.StructArray:
    columns = [pa.array(rows[:, i], pa.int64()) for i in range(3)]
    return pa.StructArray.from_arrays(columns, ["start", "length", "period"], mask=None if mask is None else pa.array(mask))


def run_column(text: Column) -> Column:
    """A struct of n_runs, runs, strongest (null without runs) and collapsed for each text; texts are searched in blocks of bounded size, a longer one alone."""
    kind = _parse_datatype_string(RESULT)

    @F.arrow_udf(kind)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [r for block in blocks([encoded(t) for t in texts.to_pylist()]) for r in _found(block)]
            flat = np.concatenate([*(r for r, _, _ in rows), np.zeros((0, 3), np.int64)])
            top = np.array([r[b] if b >= 0 else (0, 0, 0) for r, b, _ in rows], np.int64).reshape(-1, 3)
            sizes, none = np.array([len(r) for r, _, _ in rows], np.int64), np.array([b < 0 for _, b, _ in rows], bool)
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), _struct(flat))
            columns = [pa.array(sizes), runs, _struct(top, none), pa.array([t for _, _, t in rows], pa.string())]
            yield pa.StructArray.from_arrays(columns, RESULT_NAMES).cast(to_arrow_type(kind))

    return found(text)


def with_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the periodic runs of the words of ``text``, and with the text that is left when they are collapsed.

    n_runs; runs (start and length in words, period), by start and period; strongest, the run with
    the greatest length / period, first of equal ones, null without runs; collapsed, the words that no
    run contains after its first period, joined by blanks. Null and empty texts and texts of white
    space have no words, no runs and an empty collapsed text; long texts are read whole. Repeated rows are searched
    each; an empty table stays empty. Columns of the four names are replaced, all others are kept.
    """
    bounded_batches(docs.sparkSession)
    kept = [F.col(c) for c in docs.columns if c.lower() not in RESULT_NAMES]
    name = fresh(docs, "_found")
    out = docs.select(*kept, run_column(F.col("text")).alias(name))
    return out.select(*kept, *[F.col(name)[c].alias(c) for c in RESULT_NAMES])


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of all documents, by the CRC-32 of the id, end in a repeated stretch.

    With h the CRC of the decimal id and g = h div 10: if 10 divides h and the text has n > 0 words,
    each word i >= a is word a + (i - a) mod p of the text, a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    Texts of null ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id as string)) div 10").alias("g"), words.alias("words"))
    rows = rows.withColumn("n", F.when(F.size("words") > 0, F.size("words"))).withColumn("a", F.expr("cast(g % n as int)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    planted = F.concat_ws(" ", F.expr("slice(words, 1, a)"), tail)
    return rows.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(planted).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and SHA-256 of all runs and of the collapsed text, for texts with ``repeated_tails``."""
    found = with_runs(repeated_tails(docs))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.col("n_runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", "n_runs", F.col("strongest.start").alias("start"), F.col("strongest.length").alias("length"), F.col("strongest.period").alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
