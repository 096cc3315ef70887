"""Graded quality of texts by ordinal regression with cumulative logits over hashed text features.

One weight a feature gives a score; rising thresholds cut the score into grades:
P(grade > k) = 1 / (1 + exp(threshold_k - score)). Grades are 0 for toxic texts, 1 for others of
low quality, 2 for good ones. The model is fitted on a bounded sample of labelled rows in one task
and is of fixed size; scoring reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from larkaudit.llm import shingles
from larkaudit.llm.common import bounded_batches, fresh
from larkaudit.llm.shingles import LOWER, SPACES, mixed, running, span_hashes

#: Labelled rows that a model is fitted on, at most: those whose hashed ids are smallest.
SAMPLE_ROWS = 12_000
BITS = 18
PREFIX, SUFFIX = 4, 2
#: Words of more bytes than LONG, as texts without blanks have them, give their runs of GRAM bytes too.
LONG, GRAM = 24, 6
EPOCHS = 12
RATE = 0.5
#: Least probability of the best grade for a text to be kept.
LEAST_TAIL = 0.5


def block_features(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indices of all texts, and where each text's begin, with the end.

    A word gives itself in lower case, its first letters, its last two bytes, and a shape: how it is
    capitalised, whether digits or other signs are in it, and whether it repeats the word before.
    """
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    low = np.frombuffer(buf.tobytes().translate(LOWER), np.uint8)
    space = SPACES[buf]
    before = np.concatenate([[True], space[:-1]])
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    size = end - begin
    bounds = np.searchsorted(begin, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]))
    total = running(low)
    word = span_hashes(total, begin, end)
    upper = (buf >= 65) & (buf <= 90)
    digit = (buf >= 48) & (buf <= 57)
    sign = ~(upper | digit | (low >= 97) & (low <= 122) | (buf >= 128) | space)

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[end] - total[begin]

    n_upper, n_digit, n_sign = inside(upper), inside(digit), inside(sign)
    same = np.concatenate([[False], word[1:] == word[:-1]]) if len(word) else np.zeros(0, bool)
    same[bounds[:-1][bounds[:-1] < len(word)]] = False  # the word before is another text's
    shape = np.minimum(n_upper, 3) + 4 * (n_upper == size) + 8 * np.minimum(n_digit, 2) + 24 * np.minimum(n_sign, 4) + 120 * same + 240 * np.minimum(size // 8, 3)
    doc = np.repeat(np.arange(len(parts)), np.diff(bounds))
    columns = [
        (doc, mixed(word, 11)),
        (doc, mixed(span_hashes(total, begin, np.minimum(begin + PREFIX, end)), 12)),
        (doc, mixed(span_hashes(total, np.maximum(end - SUFFIX, begin), end), 13)),
        (doc, mixed(shape.astype(np.uint64), 14)),
    ]
    long = size > LONG
    if long.any():
        steps = np.zeros(len(buf) + 1, np.int64)
        steps[begin[long]] += 1
        steps[end[long] - GRAM + 1] -= 1
        at = np.flatnonzero(np.cumsum(steps)[:-1] > 0)
        owner = doc[np.searchsorted(begin, at, side="right") - 1]
        columns.append((owner, mixed(span_hashes(total, at, at + GRAM), 15)))
    # Distinct by text: the number of the text and the index in one number.
    distinct = np.unique(np.concatenate([d << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64) for d, h in columns]))
    return distinct & ((1 << BITS) - 1), np.searchsorted(distinct >> BITS, np.arange(len(parts) + 1))


def feature_sets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of whole texts, by blocks; a long text is read piece by piece, words beyond a block by parts."""
    for block in shingles.blocks([shingles.encoded(t) for t in texts]):
        most = shingles.BLOCK_BYTES
        if len(block) == 1 and len(block[0]) > most:
            found = np.unique(np.concatenate([block_features([p[i : i + most]])[0] for p in shingles.pieces(block[0]) for i in range(0, len(p), most)]))
            yield found, np.array([0, len(found)])
        else:
            yield block_features(block)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def scores(weights: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """The sum of the weights of a text's features over the fourth root of their number."""
    out = [_sums(weights[index], bounds) / np.maximum(np.diff(bounds), 1) ** 0.25 for index, bounds in feature_sets(texts)]
    return np.concatenate(out) if out else np.zeros(0)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(found: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds from the feature indices of each text, by AdaGrad over small batches in a fixed pseudorandom order."""
    index = np.concatenate([np.zeros(0, np.int32), *found])
    sizes = np.array([len(f) for f in found], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    scale = np.maximum(sizes, 1) ** -0.25
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    first, gaps = np.zeros(1), np.zeros(n_grades - 2)  # thresholds: first, then sums of exp(gaps)
    seen_t = np.full(n_grades - 1, 1e-2)
    rng = np.random.default_rng(20260701)
    for _ in range(epochs):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            own = np.concatenate([index[start[r] : start[r + 1]] for r in rows])
            bounds = np.concatenate([[0], np.cumsum(sizes[rows])])
            s = _sums(weights[own], bounds) * scale[rows]
            theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
            y = grades[rows]
            upper = sigmoid(np.append(theta, 1e9)[y] - s)  # P(grade <= y)
            lower = sigmoid(np.insert(theta, 0, -1e9)[y] - s)
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            ds = du - dl  # of -log p by the score
            dt = np.zeros(n_grades - 1)
            np.add.at(dt, y[y < n_grades - 1], -du[y < n_grades - 1])
            np.add.at(dt, y[y > 0] - 1, dl[y > 0])
            g = np.bincount(own, np.repeat(ds * scale[rows], sizes[rows]), 1 << BITS)[own] / len(rows)
            hit, once = np.unique(own, return_index=True)
            step = g[once]
            seen[hit] += step**2
            weights[hit] -= RATE * step / np.sqrt(seen[hit])
            dt /= len(rows)
            dgap = np.array([dt[k:].sum() for k in range(1, n_grades - 1)]) * np.exp(gaps)
            grad = np.concatenate([[dt.sum()], dgap])
            seen_t += grad**2
            move = RATE * grad / np.sqrt(seen_t)
            first, gaps = first - move[:1], gaps - move[1:]
    return weights.astype(np.float32), np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def fit_model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Fits on at most ``sample_rows`` labelled rows; the model that comes back has 2 ** BITS weights whatever the input.

    Features of whole texts are made where the texts lie; the task that fits gets their indices only.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    mark = F.xxhash64(F.lit("sample"), "doc_id")
    known = known.select("doc_id", grade.alias("grade"), mark.alias("mark")).orderBy("mark", "doc_id").limit(sample_rows)

    @F.pandas_udf(BinaryType())
    def indices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = [index.astype(np.int32)[a:b].tobytes() for index, bounds in feature_sets(texts.tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pd.Series(made, dtype=object)

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.lit(0).alias("all"), "doc_id", "grade", indices("text").alias("found"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "found"]).drop_duplicates("doc_id")
        weights, theta = fit([np.frombuffer(x, np.int32) for x in pdf["found"]], pdf["grade"].to_numpy(), epochs=epochs)
        return pd.DataFrame({"weights": [weights.tobytes()], "theta": [theta.tolist()]})

    model = rows.groupBy("all").applyInPandas(one, "weights binary, theta array<double>").first()
    if model is None:
        return np.zeros(1 << BITS, np.float32), np.array([-1.0, 0.0])
    return np.frombuffer(bytes(model["weights"]), np.float32), np.array(model["theta"])


def grade_documents(docs: DataFrame, labels: DataFrame, least: float = LEAST_TAIL, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with expected_grade, tail_probability (of the best grade) and selected.

    Null and empty texts have no features and get the score 0. Without labelled rows every text is
    scored alike. Repeated rows are scored each, whatever their ids; of rows that share a labelled id
    one is fitted on. An empty table gives no rows; columns of the three names are replaced, others kept.
    """
    bounded_batches(docs.sparkSession)
    weights, theta = fit_model(docs, labels, sample_rows, epochs)
    model = docs.sparkSession.sparkContext.broadcast((weights, theta))

    @F.pandas_udf("expected double, tail double")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, t = model.value
        for texts in batches:
            above = sigmoid(scores(w, texts.tolist())[:, None] - t[None, :])
            yield pd.DataFrame({"expected": above.sum(axis=1), "tail": above[:, -1]})

    new = ["expected_grade", "tail_probability", "selected"]
    kept = [F.col(c) for c in docs.columns if c not in new]
    name = fresh(docs, "graded")
    out = docs.select(*kept, graded("text").alias(name))
    expected, tail = F.col(name)["expected"], F.col(name)["tail"]
    return out.select(*kept, expected.alias(new[0]), tail.alias(new[1]), (tail >= least).alias(new[2]))
