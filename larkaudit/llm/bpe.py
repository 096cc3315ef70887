"""Byte-pair vocabularies: loading, the backtracking encoder, the offset-table decoder.

A vocabulary is read from a ``tokenizers`` JSON file of kind "BPE with word ends": text is
NFC-normalised and lower-cased, cut into pre-tokens that never hold white space, and every
pre-token is a string of byte symbols whose last symbol carries the word-end mark.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

WORD_END = "</w>"
#: A byte symbol that ends a word is kept as one private character, so every symbol is one character.
END_BASE = 0xE000
#: Characters that str.split() takes for white space and the vocabulary's pattern does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[^\S\x1c-\x1f]+")
#: Entries that a task remembers before it starts afresh; an entry takes some 250 bytes.
CACHE_ENTRIES = 200_000
PAIR_ENTRIES = 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next of U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and the tables derived from them.

    A token is a string of symbols; ``token_ids`` maps it to its id. ``shorter[i]`` is the longest
    token that is a proper prefix of token i, or -1. ``compatible(a, b)`` tells whether merging the
    symbols of token a followed by those of token b gives exactly a, b again; answers are kept in
    the pair table. A token sequence is the merge result if and only if all neighbours are compatible.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.symbols = byte_symbols()
        self.plain = {b: s for b, s in enumerate(self.symbols)}
        raw = spec["model"]["vocab"]
        self.token_ids = {self._internal(t): i for t, i in raw.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self._internal(a), self._internal(b)] = rank
        size = max([*raw.values(), *self.special.values()]) + 1
        self.lengths = [0] * size
        self.tokens = [""] * size
        for t, i in self.token_ids.items():
            self.lengths[i], self.tokens[i] = len(t), t
        self.shorter = [-1] * size
        for t, i in self.token_ids.items():
            self.shorter[i] = next((self.token_ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.token_ids), -1)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.automaton = ahocorasick.Automaton()
        for t, i in self.token_ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts = {a + b: (a, b, rank) for (a, b), rank in self.merges.items()}
        #: Whether each merge joins what earlier merges made; then merging goes by rising rank.
        self.ordered = all(self.parts.get(x, (0, 0, -1))[2] < r for (a, b), r in self.merges.items() for x in (a, b)) and len(self.parts) == len(self.merges)
        self.edges: dict[tuple[int, int], list[tuple[str, int]]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[str, int]]:
        """What stands at a token's left (0) or right (1) edge while it is merged, each with the rank that ends its stand."""
        known = self.edges.get((token, side))
        if known is None:
            known, x, until = [], self.tokens[token], 1 << 60
            while True:
                known.append((x, until))
                if x not in self.parts:
                    break
                until = self.parts[x][2]
                x = self.parts[x][side]
            self.edges[token, side] = known
        return known

    def _internal(self, token: str) -> str:
        if not token.endswith(WORD_END) or token == WORD_END:
            return token
        body = token[: -len(WORD_END)]
        return body[:-1] + chr(END_BASE + ord(body[-1]))

    def word_symbols(self, word: str) -> str:
        """A pre-token as symbols, its last one with the word-end mark."""
        s = "".join([self.symbols[b] for b in word.encode()])
        return s[:-1] + chr(END_BASE + ord(s[-1]))

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings; lower-casing goes by character, so sigma has one form."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.replace("Σ", "σ").lower())

    def pieces(self, chunk: str) -> list[str | int]:
        """Ids of special strings and the pre-tokens between them, in order."""
        if self.special_pattern is None or "<" not in chunk:
            return self.pre_tokens(chunk)
        out: list[str | int] = []
        for part in self.special_pattern.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.pre_tokens(part)
        return out

    def merge(self, symbols: str) -> list[str]:
        """Merging by definition: again and again the leftmost pair of lowest rank. For short strings."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.merges.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """a = -1: whether token b alone comes out of its own symbols."""
        known = self.pairs.get((a, b))
        if known is None:
            if a < 0 or not self.ordered:
                want = [self.tokens[b]] if a < 0 else [self.tokens[a], self.tokens[b]]
                known = self.merge("".join(want)) == want
            else:
                # A merge across the border happens if both its parts stand there when its rank comes up;
                # of two places with one rank, the left one goes first.
                right, find = self._edge(b, 0), self.merges.get
                known = True
                for x, until_x in self._edge(a, 1):
                    for y, until_y in right:
                        rank = find((x, y))
                        if rank is not None and rank < until_x and rank <= until_y:
                            known = False
                            break
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def encode_symbols(self, s: str) -> list[int]:
        """Ids of one pre-token's symbols in time linear in its length.

        Takes the longest token at each place, or the next shorter one, as long as it is compatible
        with the token before it; where none is, the place is marked as dead and the last token is
        taken back. The merge result is unique, so a dead place stays dead.
        """
        n, lengths, known, compatible, shorter = len(s), self.lengths, self.pairs, self.compatible, self.shorter
        find = self.automaton.iter_long
        out: list[int] = []
        dead: set[int] = set()
        at, before, token = 0, -1, -1
        for _, token in find(s):  # longest tokens all along do for many words
            fits = known.get((before, token))
            if not (compatible(before, token) if fits is None else fits):
                break
            out.append(token)
            before = token
            at += lengths[token]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0:
                if at + lengths[token] not in dead:
                    fits = known.get((before, token))
                    if compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                token = next(find(s, at))[1] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte symbol")
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
        return out


def chunks(text: str) -> list[str]:
    """The runs of a text between white space; no pre-token crosses white space."""
    return text.split() if NOT_SPACE.search(text) is None else [x for x in SPACE.split(text) if x]


class Remembered(dict):
    """What ``make`` gives for a string; keeps CACHE_ENTRIES short strings at most, then starts afresh."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        out = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = out
        return out


class Encoder(Remembered):
    """Ids of chunks as little-endian bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(self._chunk)
        self.vocabulary = vocabulary
        self.words = Remembered(lambda word: array("I", vocabulary.encode_symbols(vocabulary.word_symbols(word))).tobytes())

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.words[x] if isinstance(x, str) else x.to_bytes(4, "little") for x in self.vocabulary.pieces(chunk)])

    def forget(self) -> None:
        """Drops what was remembered, so that an idle process holds little."""
        self.clear()
        self.words.clear()
        self.vocabulary.pairs.clear()
        self.vocabulary.edges.clear()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, chunks(text)))


class Decoder:
    """Token spellings laid end to end, and where each begins; the file names no decoder, so a blank joins them.

    Nothing else of the vocabulary is kept.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        spelt = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(spelt), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in spelt])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text, by blocks of ids so that memory stays bounded."""
        all_ids = np.frombuffer(ids, "<u4")
        parts = []
        for lo in range(0, len(all_ids), 1 << 18):
            block = all_ids[lo : lo + (1 << 18)]
            start, length = self.offsets[block], self.offsets[block + 1] - self.offsets[block]
            ends = np.cumsum(length)
            parts.append(self.blob[np.arange(ends[-1]) + np.repeat(start - (ends - length), length)].tobytes())
        return b"".join(parts)[:-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python process."""
    return Vocabulary(path)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """Kept between the tasks of a Python process."""
    return Encoder(vocabulary(path))


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
