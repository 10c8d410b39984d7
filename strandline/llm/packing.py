"""Packing documents into sequences by non-negative least squares over length combinations.

Documents are tokenised and cut at full windows; what is left of each (at most a window) is a piece to pack.
Only the histogram of piece lengths, one number for each length of a window, reaches the driver. There,
combinations of up to three lengths that fill a window (or, alone, a power of two, which isn't padded) are
enumerated; non-negative least squares finds how often to use each, the counts are rounded down to what the
histogram allows, and the rest is packed greedily, longest first, still by counts. The plan so says, for each
length, which ranks of its pieces go into which sequences; ranks are dealt out where the pieces are.

Ranks go by a hash, or (``in_order``) by the order of the documents' rows: then the places of each length are
dealt out evenly along that order, so that what meets in a sequence comes from about the same part of it, and
sequences are numbered by the first of their pieces.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each on their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, HASH_BITS, byte_chunks, hash63, lean, local_only, materialise, pieces, rank_sliced, rank_within, with_order
from .shingles import U, mix, powers

WINDOW = 2048
END = 1
#: Combinations to enumerate for each largest length; steps of the solver; words that a worker's cache holds.
THIRDS = 24
STEPS = 400
CACHE_WORDS = 2_000_000
#: Places that one row of a plan is unfolded to at most by a task; a step that spreads any run of numbers evenly.
PLACES = 65_536
GOLDEN = 0.6180339887498949

#: What the fast path reads: ASCII and the letters of Latin-1; other texts go through the tokenizer as a whole.
PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")


class Tokens:
    """A tokenizer's ids of many texts, each distinct run of letters, digits or signs being tokenised once.

    For a tokenizer that lowers case, drops white space and splits letters, digits and signs before it merges,
    a text's ids are those of its runs in order. Runs are found and hashed over the bytes of many texts at a time.
    A run with an apostrophe, which can belong to letters, is kept whole up to white space. Texts with special
    tokens or with characters beyond ``PLAIN`` are left to the tokenizer. Runs are known by 64-bit hashes, which are
    not compared letter by letter: of a worker's two million runs two share one with a chance of about 10^-7.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        local_only()
        self.model = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, U), np.zeros(0, np.int64)
        self.tops, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends (exclusive), hashes of the runs, and their texts."""
        n = len(data)
        letter = (data >= 97) & (data <= 122) | (data >= 128)
        digit = (data >= 48) & (data <= 57)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        kind = (letter * 1 + digit * 2 + space * 3).astype(np.int8)
        new = np.ones(n, bool)
        new[1:] = (kind[1:] != kind[:-1]) | digit[1:]
        hard = np.ones(n, bool)  # where white space or another text begins or ends
        hard[1:] = space[1:] | space[:-1]
        hard[offsets[:-1][offsets[:-1] < n]] = True
        quote = data == 39
        if quote.any():
            chunk = np.cumsum(hard) - 1
            new &= ~(np.bincount(chunk, quote)[chunk] > 0)
        starts = np.flatnonzero((new | hard) & ~space)
        closes = np.flatnonzero(np.concatenate(((new | hard)[1:], [True]))) + 1
        stops = closes[np.searchsorted(closes, starts, "right")]
        up, down = powers(n)
        terms = (data.astype(U) + U(1)) * up[:n]
        sums = np.cumsum(terms)
        hashes = mix((sums[stops - 1] - sums[starts] + terms[starts]) * down[starts] + (stops - starts).astype(U))
        return starts, stops, hashes, np.searchsorted(offsets, starts, "right") - 1

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Tokenise runs that are new and add them to the cache."""
        found: list[list[int]] = []
        for k in range(0, len(words), 4096):
            found += [e.ids for e in self.model.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        first = len(self.tops) - 1
        self.tops = np.concatenate([self.tops, self.tops[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))])
        keys, slots = np.concatenate([self.keys, hashes]), np.concatenate([self.slots, np.arange(first, first + len(words))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text, without special ones. One very long text is read in pieces, which white space parts."""
        if len(offsets) > 2 or len(data) <= CHUNK_BYTES:
            yield from self._encode(data, offsets)
        else:
            yield np.concatenate([next(self._encode(p, np.array([0, len(p)]))) for p in pieces(data)])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        whole: dict[int, np.ndarray] = {}
        parts, raw = [], data.tobytes()
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = raw[a:b].decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text:
                parts.append(text.lower().encode())
            else:
                whole[i] = np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)
                parts.append(b"")
        tops = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        joined = b"".join(parts)
        counts, flat = np.zeros(len(parts), np.int64), np.zeros(0, np.uint32)
        if joined:
            starts, stops, hashes, text_of = self.runs(np.frombuffer(joined, np.uint8), tops)
            unique, first, where = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.keys) > CACHE_WORDS:
                self.clear()
            at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
            fresh = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool)
            if fresh.any():
                self.learn(unique[fresh], [joined[a:b].decode() for a, b in zip(starts[first[fresh]].tolist(), stops[first[fresh]].tolist(), strict=True)])
                at = np.searchsorted(self.keys, unique)
            slots = self.slots[at][where]
            begin, size = self.tops[slots], self.tops[slots + 1] - self.tops[slots]
            ends = np.cumsum(size)
            flat = self.ids[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
            counts = np.bincount(text_of, size, len(parts)).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(counts)))
        for i in range(len(parts)):
            yield whole[i] if i in whole else flat[at[i] : at[i + 1]]


_tokens: dict[str, Tokens] = {}


def cut(path: str, window: int, keep: tuple[str, ...] = ("doc_id",)):
    """Pieces of each document: full windows from its start, then the rest, with the check sums of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        for batch in batches:
            rows, starts, sizes, sums, totals = [], [], [], [], []
            for first, _, data, offsets in byte_chunks(batch, "text"):
                for row, ids in enumerate(_tokens[path].encode(data, offsets), first):
                    raw, n = ids.astype("<u4").tobytes() + END.to_bytes(4, "little"), len(ids) + 1
                    for start in range(0, n, window):
                        rows.append(row)
                        starts.append(start)
                        sizes.append(min(window, n - start))
                        sums.append(zlib.crc32(raw[4 * start : 4 * (start + window)]))
                        totals.append(n)
            own = {k: batch.column(k).take(pa.array(rows, pa.int64())) for k in keep}
            yield pa.RecordBatch.from_pydict(own | {"start": pa.array(starts, pa.int64()), "length": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": pa.array(totals, pa.int64())})

    return run


def combinations(lengths: np.ndarray, window: int, thirds: int = THIRDS) -> np.ndarray:
    """Rows of three lengths, 0 for none, that fill a window exactly, or of one that is a power of two."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found = [(int(x), 0, 0) for x in lengths if x & (x - 1) == 0]
    found += [(int(x), window - int(x), 0) for x in lengths if 2 * x >= window and x < window and there[window - x]]
    for x in lengths.tolist():
        rest = window - x
        second = lengths[(lengths <= x) & (2 * lengths >= rest) & (lengths < rest)]
        second = second[there[rest - second]]
        if len(second) > thirds:
            second = second[np.linspace(0, len(second) - 1, thirds).astype(int)]
        found += [(x, int(y), rest - int(y)) for y in second]
    return np.array(sorted(set(found)), np.int64).reshape(-1, 3)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Counts x >= 0 of the combinations with the least |A x - h|^2, by accelerated projected gradients."""
    scale = max(histogram.max(), 1)
    h = histogram / scale
    flat, used = combos.ravel(), combos.ravel() > 0

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat[used], np.repeat(x, 3)[used], len(h))

    def back(r: np.ndarray) -> np.ndarray:
        return np.where(combos > 0, r[combos], 0).sum(1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(apply(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(apply(y) - h) / (1.05 * bound))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x * scale


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the pieces of each length go.

    ``histogram``: pieces of each length from 0 to the window. The rows of the plan are bounded by the window
    and the number of combinations, whatever the counts. Ranks of a row go to consecutive sequences.
    """
    left = histogram.astype(np.int64).copy()
    given = np.zeros(len(left), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def use(parts: list[int], times: int) -> None:
        nonlocal sequence
        at = 0
        # A length that occurs twice takes one range of ranks after the other.
        for size in parts:
            rows.append((size, int(given[size]), times, sequence, at))
            given[size] += times
            left[size] -= times
            at += size
        sequence += times

    if left[window]:
        use([window], int(left[window]))
    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window)
    if len(combos):
        counts = solve(combos, left.astype(float))
        for k in np.argsort(-counts, kind="stable"):
            parts = [int(x) for x in combos[k] if x]
            times = min([int(counts[k] + 0.5), *(int(left[p]) // parts.count(p) for p in parts)])
            if times > 0:
                use(parts, times)
    while left.any():
        # The longest left, then again and again the longest that fits; as often as the counts allow.
        parts, room, free = [], window, left.copy()
        while True:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits) or fits[-1] == 0:
                break
            size = int(fits[-1])
            parts.append(size)
            free[size] -= 1
            room -= size
        use(parts, min(int(left[p]) // parts.count(p) for p in parts))
    return rows


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, in_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``in_order``: sequences follow the order of the rows of ``docs``.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = {"doc_id": kind} | ({"_part": "long", "_row": "long"} if in_order else {})
    rows_of = with_order(docs) if in_order else docs
    schema = ", ".join(f"{k} {v}" for k, v in own.items())
    pieces = rows_of.select(*own, "text").mapInArrow(lean(cut(tokenizer, window, tuple(own))), f"{schema}, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialise(pieces, "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    rows = plan(histogram, window)
    if in_order:
        return along(pieces, rows)
    keyed = pieces.withColumn("_key", hash63(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("start").cast("string")))
    ranked = rank_within(keyed, ["length"], "_key", ["doc_id", "ids_crc32"], "_rank", bits=8)
    schema = "length long, _from long, _times long, _sequence long, offset long"
    # For each length its ranges in order; a rank's range is found by how many begin at or before it.
    ranges = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
    ranges = ranges.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_from", "_sequence", "offset"))).alias("_ranges"))
    found = ranked.join(F.broadcast(ranges), "length").withColumn("_at", find(window))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_at")["_sequence"] + F.col("_rank") - F.col("_at")["_from"]).alias("sequence_id"), F.col("_at")["offset"].alias("offset"))


def along(pieces: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The pieces in the places of a plan, along the order (_part, _row, start) of the pieces.

    The sequences of a combination are spread evenly over 0 to 1. Of the places of each length, in that order, each
    takes the piece of the same rank; and a sequence's number is its rank by the first of its pieces.
    """
    schema = "length long, _from long, _times long, _sequence long, offset long, _of long"
    cuts = [(size, k, min(PLACES, times - k), sequence, at, times) for size, _, times, sequence, at in rows for k in range(0, times, PLACES)]
    places = pieces.sparkSession.createDataFrame(cuts, schema).select("*", F.explode(F.sequence(F.lit(0), F.col("_times").cast("int") - 1)).alias("_i"))
    # Combinations that are used once or a few times begin anywhere, so that they are spread over the order as well.
    shift = F.col("_sequence") * GOLDEN
    share = (F.col("_from") + F.col("_i") + shift - F.floor(shift)) / F.col("_of")
    places = places.select("length", "offset", (F.col("_sequence") + F.col("_from") + F.col("_i")).alias("_sequence"), F.least(share * 2.0**HASH_BITS, F.lit(2.0**HASH_BITS - 2**10)).cast("long").alias("_share"))
    places = rank_within(places, ["length"], "_share", ["_sequence", "offset"], "_rank", bits=8).drop("_share")
    ranked = rank_sliced(pieces.withColumn("_slice", F.col("_part")), ["length"], ["_row", "start", "ids_crc32"], "_rank")
    found = materialise(ranked.join(places, ["length", "_rank"]), "placed")
    first = found.groupBy("_sequence").agg(F.min(F.struct("_part", "_row", "start")).alias("_first")).select("_sequence", F.lit(0).alias("_all"), "_first", F.col("_first._part").alias("_slice"))
    numbers = rank_sliced(first, ["_all"], ["_first"], "sequence_id").select("_sequence", "sequence_id")
    return found.join(numbers, "_sequence").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def find(window: int):
    """The last range that begins at or before ``_rank``, by bisection over the sorted array."""
    steps = F.sequence(F.lit(0), F.lit(20))
    low_high = F.struct(F.lit(0).alias("a"), F.size("_ranges").alias("b"))

    def halve(s, _):
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        right = F.get("_ranges", mid)["_from"] <= F.col("_rank")
        done = s["b"] - s["a"] <= 1
        return F.struct(F.when(~done & right, mid).otherwise(s["a"]).alias("a"), F.when(~done & ~right, mid).otherwise(s["b"]).alias("b"))

    return F.get("_ranges", F.aggregate(steps, low_high, halve)["a"])
