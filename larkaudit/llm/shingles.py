"""Word shingles of many texts at once, as 64-bit hashes, in NumPy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SHINGLE = 5
#: Bytes of text that are hashed at a time; some twenty times as much is held meanwhile.
BLOCK_BYTES = 1 << 19
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BLANK = bytes(32 if SPACES[b] else b for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
JOIN = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h + np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base ** 2, ...: n of them; those of a block are kept, some megabytes."""
    return _powers(int(base), 2 * BLOCK_BYTES)[:n] if n <= 2 * BLOCK_BYTES else _powers.__wrapped__(int(base), n)


def running(buf: np.ndarray) -> np.ndarray:
    """A running sum over the bytes, from which ``span_hashes`` hashes any span of them."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf)), out=total[1:])
    return total


def span_hashes(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes begin .. end - 1, whole."""
    value = (total[end] - total[begin]) * powers(BASE_INVERSE, len(total))[begin]
    return mixed(value + (end - begin).astype(np.uint64))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def pieces(data: bytes) -> Iterator[bytes]:
    """A long text cut at white space into pieces of at most BLOCK_BYTES; a longer word is a piece of its own."""
    most = BLOCK_BYTES
    if len(data) <= most:
        yield data
        return
    flat, at = data.translate(BLANK), 0
    while len(data) - at > most:
        stop = flat.rfind(b" ", at, at + most)
        if stop <= at:
            stop = flat.find(b" ", at + 1)
            if stop < 0:
                break
        yield data[at:stop]
        at = stop
    yield data[at:]


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words begin, with the end."""
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    buf = np.frombuffer(b" ".join(parts).translate(LOWER) + b" ", np.uint8)
    space = SPACES[buf]
    before = np.concatenate([[True], space[:-1]])
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    return span_hashes(running(buf), begin, end), np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))


def long_word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one long text, piece by piece; a word beyond BLOCK_BYTES by its digest."""
    out = []
    for piece in pieces(data):
        if len(piece) <= BLOCK_BYTES:
            out.append(word_hashes([piece])[0])
        else:
            word = piece.translate(LOWER).strip(b" \t\n\v\f\r")
            out.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64))
    return np.concatenate(out)


def blocks(parts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in their order, as many together as BLOCK_BYTES holds; a longer one comes alone."""
    block, size = [], 0
    for p in parts:
        if block and size + len(p) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(p)
        size += len(p)
    if block:
        yield block


def runs_of(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    runs = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(SHINGLE):
            runs = runs * JOIN + words[k : n + k]
    return mixed(runs)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of SHINGLE words; of all its words if it has fewer; none if it has none."""
    out = []
    for block in blocks([encoded(t) for t in texts]):
        if len(block) == 1 and len(block[0]) > BLOCK_BYTES:
            words = long_word_hashes(block[0])
            bounds = np.array([0, len(words)])
        else:
            words, bounds = word_hashes(block)
        runs = runs_of(words)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(runs[a : b - SHINGLE + 1]))
            elif b > a:
                h = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        h = h * JOIN + w
                out.append(mixed(np.array([h]), 1))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes | None:
    """Sixteen bytes that stand for a set; None for the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
