"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of many texts at a time.

Words are runs of other bytes than ASCII white space, with A-Z lowered. A text with fewer words than a shingle
has its whole word sequence as its one shingle; a null or empty text, or one without words, has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import CHUNK_BYTES, byte_chunks, pieces

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which each bit depends on all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, b, U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and the number of words of each text. One very long text is read in pieces.
    Without ``lower``, words are taken as they are written."""
    if len(offsets) > 2 or len(data) <= CHUNK_BYTES:
        return _word_hashes(data, offsets, lower)
    words = np.concatenate([_word_hashes(p, np.array([0, len(p)]), lower)[0] for p in pieces(data)])
    return words, np.array([len(words)])


def _word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n, docs = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, U), np.zeros(docs, np.int64)
    low = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8) if lower else data
    space = (low == 32) | ((low >= 9) & (low <= 13))
    inside = ~space
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    first, last = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    begins[first], ends[last] = inside[first], inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = powers(n)
    terms = (low.astype(U) + U(1)) * up[:n]
    sums = np.cumsum(terms)
    hashes = mix((sums[stops] - sums[starts] + terms[starts]) * down[starts] + U(0x632BE59BD9B4E019))
    return hashes, np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=docs)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted."""
    words, counts = word_hashes(data, offsets)
    tops = np.concatenate(([0], np.cumsum(counts)))
    grams = np.zeros(0, U)
    if len(words) >= k:
        grams = words[: len(words) - k + 1] * _PLACES[0]
        for j in range(1, k):
            grams = grams + words[j : len(words) - k + 1 + j] * _PLACES[j]
        grams = mix(grams)
    for a, b in zip(tops[:-1].tolist(), tops[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            whole = sum((words[a + j : a + j + 1] * _PLACES[j] for j in range(b - a)), np.full(1, b - a, U))
            yield mix(mix(whole))
        else:
            yield np.zeros(0, U)


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit signature of a set, signed; equal sets have equal ones."""
    both = mix(shingles.sum(keepdims=True) + U(len(shingles))) ^ mix(np.bitwise_xor.reduce(mix(shingles ^ U(0x2545F4914F6CDD1D)), keepdims=True))
    return int(both.view(np.int64)[0])


def batch_sets(batch: pa.RecordBatch, k: int, column: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(row, its shingles) for each row of a batch."""
    for start, _, data, offsets in byte_chunks(batch, column):
        yield from enumerate(shingle_sets(data, offsets, k), start)


def one_set(text: str, k: int) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return next(shingle_sets(data, np.array([0, len(data)]), k))
