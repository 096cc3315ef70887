"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary.

The merge result of a growing pre-token is fixed by the last token of each of its prefixes: the
last token at a place is the one vocabulary token ending there that is compatible with the last
token where it begins. Only places from which some token may still go on matter, that is the
suffixes of what was read that are proper prefixes of a token. A state is therefore the longest such
suffix with the last tokens and relative counts at those places: finitely many. States are compiled when
first met; each transition is annotated with the tokens that it adds to the count (it may take
some back). The symbol that ends a word leads back to the start.

A text is one string of symbols, cut into chunks of equal length wherever that falls. A chunk's
state map tells for states of entry where it leads and how many tokens it adds; maps compose by a
parallel prefix scan. A map holds the entries that are likely, found by reading on from the start
state some symbols before the chunk; an entry that it lacks is read beside a known one until both
are in one state, from where on they agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from larkaudit.llm import bpe
from larkaudit.llm.common import bounded_batches

#: States that a process keeps before it compiles afresh, and bytes between which it looks; a state takes about a kilobyte.
MAX_STATES, SPAN = 100_000, 1 << 16
#: Bytes in a chunk, and before it from which its likely entry is read.
CHUNK, LEAD = 2048, 64


class State(dict):
    """Transitions by symbol, (state, tokens added) each; compiled when first asked for."""

    __slots__ = ("machine", "suffix", "places")

    def __init__(self, machine: Transducer, suffix: str, places: tuple[tuple[int, int, int], ...]):
        super().__init__()
        self.machine, self.suffix = machine, suffix
        self.places = places  # (k, last token, count relative to the end) at k symbols before the end of what was read

    __hash__ = object.__hash__

    def __eq__(self, other: object) -> bool:
        return self is other

    def __missing__(self, symbol: str) -> tuple[State, int]:
        machine, text = self.machine, self.suffix + symbol
        tokens, compatible = machine.vocabulary.token_ids, machine.vocabulary.compatible
        for k, last, count in self.places:
            token = tokens.get(text[-k - 1 :], -1)
            if token >= 0 and compatible(last, token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte symbol")
        added = count + 1
        if ord(symbol) >= bpe.END_BASE:
            arc = machine.start, added
        else:
            begun = machine.open
            places = ((0, token, 0), *[(k + 1, last, c - added) for k, last, c in self.places if text[-k - 1 :] in begun])
            length = places[-1][0]
            arc = machine.state(text[-length:] if length else "", places), added
        self[symbol] = arc
        return arc


class Transducer:
    """Deterministic, compiled lazily; ``start`` is the start of a word."""

    def __init__(self, vocabulary: bpe.Vocabulary, max_states: int = MAX_STATES):
        self.vocabulary, self.max_states = vocabulary, max_states
        self.open = {""} | {t[:n] for t in vocabulary.token_ids for n in range(1, len(t))}
        #: Code points of the symbols of bytes, and of bytes that end a word.
        self.table = np.array([*map(ord, vocabulary.symbols), *(bpe.END_BASE + ord(s) for s in vocabulary.symbols)], "<u2")
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state("", ((0, -1, 0),))

    def state(self, suffix: str, places: tuple[tuple[int, int, int], ...]) -> State:
        found = self.states.get((suffix, places))
        if found is None:
            found = self.states[suffix, places] = State(self, suffix, places)
        return found

    def symbols(self, words: bytes, begin: int, end: int) -> str:
        """The symbols of bytes begin .. end - 1 of words that are joined by blanks."""
        part = np.frombuffer(words[begin : end + 1] + b" ", np.uint8)
        ends = part[1 : end - begin + 1] == 32
        part = part[: end - begin]
        return self.table[(part.astype(np.int16) + 256 * ends)[part != 32]].tobytes().decode("utf-16-le")


def read(state: State, symbols: str) -> tuple[State, int]:
    total = 0
    for s in symbols:
        state, added = state[s]
        total += added
    return state, total


class StateMap:
    """What a chunk, or a run of chunks, does to the state in which it is entered: state to (state, tokens added)."""

    __slots__ = ("arcs", "symbols", "parts")

    def __init__(self, arcs: dict[State, tuple[State, int]], symbols=None, parts: tuple[StateMap, StateMap] | None = None):
        self.arcs, self.symbols, self.parts = arcs, symbols, parts

    def through(self, entry: State) -> tuple[State, int]:
        """Where ``entry`` leads; an entry not met before is added to the map."""
        found = self.arcs.get(entry)
        if found is None:
            if self.parts is not None:
                middle, first = self.parts[0].through(entry)
                last, second = self.parts[1].through(middle)
                found = last, first + second
            else:
                found = self._beside(entry)
            self.arcs[entry] = found
        return found

    def _beside(self, entry: State) -> tuple[State, int]:
        """Reads from ``entry`` and from a known entry until both are in one state."""
        known, (last, total) = next(iter(self.arcs.items()))
        more = 0
        for s in self.symbols():
            entry, a = entry[s]
            known, b = known[s]
            more += a - b
            if entry is known:
                return last, total + more
        return entry, total + more


def chunk_maps(words: bytes, machine: Transducer, chunk: int, begin: int = 0, end: int | None = None) -> list[StateMap]:
    """The state maps of chunks of words that are joined by blanks, from ``begin`` to ``end``, each with the entry that is likely."""
    maps, end = [], len(words) if end is None else end
    for at in range(begin, end, chunk):
        def symbols(at: int = at) -> str:
            return machine.symbols(words, at, min(at + chunk, end))

        entry = read(machine.start, machine.symbols(words, max(0, at - LEAD), at))[0]
        maps.append(StateMap({entry: read(entry, symbols())}, symbols))
    return maps


def compose(a: StateMap, b: StateMap) -> StateMap:
    """a, then b."""
    arcs = {}
    for entry, (middle, first) in a.arcs.items():
        last, second = b.through(middle)
        arcs[entry] = last, first + second
    return StateMap(arcs, parts=(a, b))


def prefix_scan(maps: list[StateMap]) -> list[StateMap]:
    """The map of each leading run of chunks, in a number of rounds that grows with the logarithm of theirs."""
    step = 1
    while step < len(maps):
        maps = [compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
        step *= 2
    return maps


def count_text(text: str, machine: Transducer, chunk: int | None = None) -> int:
    """Tokens of a text. Special strings are a token each; the words between them, joined by blanks, go through the machine.

    A span of chunks is scanned at a time. Where the machine is full between two spans, it starts afresh in the
    state that was reached, so what a text of any length leaves behind is bounded.
    """
    pieces = machine.vocabulary.pieces(text)
    special = sum(1 for p in pieces if not isinstance(p, str))
    words = " ".join([p for p in pieces if isinstance(p, str)] if special else pieces).encode()
    del pieces
    state, total = machine.start, special
    for begin in range(0, len(words), SPAN):
        state, added = prefix_scan(chunk_maps(words, machine, chunk or CHUNK, begin, min(begin + SPAN, len(words))))[-1].through(state)
        total += added
        if len(machine.states) > machine.max_states:
            reached = state.suffix, state.places
            machine.reset()
            state = machine.state(*reached)
    return total


@lru_cache(maxsize=1)
def _machine(path: str) -> Transducer:
    return Transducer(bpe.vocabulary(path))


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text column (null: 0) under the vocabulary file at ``path``, which every node must have."""
    path = path or bpe.default_path()

    @F.pandas_udf(LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _machine(path)
        for texts in batches:
            yield pd.Series([count_text(t, machine) if t else 0 for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs`` (doc_id, text, ...).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a row; a null doc_id
    stays null; an empty table gives no rows; other columns are ignored. Every text is cut into
    chunks whose state maps are composed, so nothing depends on where a word is cut, and memory
    grows in proportion to the text, white space or not.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
