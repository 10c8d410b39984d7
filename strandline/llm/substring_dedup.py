"""Passages that documents repeat, by seed and extend: winnowed anchors, extended both ways to windows and spans.

A window is ``least`` consecutive words. It repeats if its words also start in a document with a smaller doc_id, or
earlier in its own. Repeating windows, merged where they overlap or touch, are the maximal repeats.

1. Seeds. Of the shingles of ``seed`` words inside a window, that with the least hash (of equal ones the last) is its
   anchor. The windows of one anchor follow each other, so an anchor with the words around it that its windows cover,
   a run, stands for up to ``least - seed + 1`` windows, and equal windows have equal anchors at equal places. The least
   doc_id of every run (anchor, hash of all its words) is a sum combined before the shuffle: of a passage that a third
   of all documents share, each task sends one row.
2. Extension. Runs of one anchor that differ in their words share those windows that lie within what matches on either
   side of the anchor. Only such runs, and only in the first document of each, are extended into their windows, which
   find their least doc_id in the same way. All others are whole repeats, or first themselves.
3. Every document gets, by doc_id, the runs and windows of which it is the first: one row per different run, however
   many documents share it. What is in neither list repeats; a document's own repeats it sees itself.

So no two documents are ever paired, nothing is capped, and a text is moved twice: to its open runs, and to its lists.
Words are compared by 64-bit hashes; windows and runs by their own 64-bit hashes together with their anchor's.

Defined cases: null and empty texts have no words; a text of fewer words than a window keeps them all. Rows that share
a doc_id are one document's versions: none of them is earlier than another. A row without doc_id comes after all that
have one; such rows share "none" as their doc_id. Other columns take no part. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, materialise, pieces
from .shingles import U, mix, word_hashes

#: Words of a shingle that can be an anchor.
SEED = 8
#: Windows of a text that are looked at at a time; a run that is cut there is extended like any run of its anchor.
SLICE = 1 << 18
_ODD = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def spans_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words, from those of half as many."""
    if n == 1:
        return words
    half = (n + 1) // 2
    part = spans_hash(words, half)
    count = len(words) - n + 1
    return mix(part[:count] * _ODD[0] + part[n - half : n - half + count] * _ODD[1] + U(n))


def windows(words: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of a slice of one text: their hashes, each one's run, and anchor and content hash of each run."""
    count = len(words) - least + 1
    whole, grams = spans_hash(words, least), spans_hash(words, seed)
    wide = least - seed + 1
    backwards = np.lib.stride_tricks.sliding_window_view(grams, wide)[:, ::-1]
    at = np.arange(count) + wide - 1 - backwards.argmin(1)  # never falls, so runs are what shares a place
    begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    ends = np.append(begins[1:], count) - 1
    # First and last window of a run overlap, so that these two tell all its words.
    content = mix(whole[begins] * _ODD[2] + whole[ends] * _ODD[3] + (ends - begins).astype(U))
    return whole, np.repeat(np.arange(len(begins)), ends - begins + 1), grams[at[begins]], content


def slices(words: np.ndarray, least: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, what ``windows`` says) for slices of a text's windows."""
    for a in range(0, len(words) - least + 1, SLICE):
        yield a, *windows(words[a : a + SLICE + least - 1], least, seed)


def batch_words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words, as they are written) for each row of a batch."""
    for start, _, data, offsets in byte_chunks(batch, "text"):
        words, counts = word_hashes(data, offsets, lower=False)
        tops = np.concatenate(([0], np.cumsum(counts)))
        yield from ((start + k, words[tops[k] : tops[k + 1]]) for k in range(len(counts)))


def _rows(doc_ids: pa.Array, found: list[tuple[int, np.ndarray, np.ndarray]], name: str) -> pa.RecordBatch:
    rows = np.repeat([r for r, _, _ in found], [len(a) for _, a, _ in found]).astype(np.int64)
    both = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, U) for k in (1, 2)]
    return pa.RecordBatch.from_pydict({"doc_id": doc_ids.take(pa.array(rows)), "anchor": both[0].view(np.int64), name: both[1].view(np.int64)})


def seeds(least: int, seed: int):
    """(doc_id, anchor, run): the different runs of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for row, words in batch_words(batch):
                for _, _, _, anchors, content in slices(words, least, seed):
                    content, first = np.unique(content, return_index=True)
                    found.append((row, anchors[first], content))
                    size += len(content)
                if size > SLICE:
                    yield _rows(batch.column("doc_id"), found, "run")
                    found, size = [], 0
            yield _rows(batch.column("doc_id"), found, "run")

    return run


def extend(least: int, seed: int):
    """(doc_id, anchor, window): the different windows of the runs that ``open`` lists for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lists = [], batch.column("open")
            for row, words in batch_words(batch):
                asked = np.sort(np.asarray(lists[row].values))
                for _, whole, runs, anchors, content in slices(words, least, seed):
                    own = member(content.view(np.int64), asked)[runs]
                    seen, first = np.unique(whole[own], return_index=True)
                    found.append((row, anchors[runs[own][first]], seen))
            yield _rows(batch.column("doc_id"), found, "window")

    return run


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``values`` occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def repeated(words: np.ndarray, firsts: np.ndarray, least: int, seed: int) -> np.ndarray:
    """Which windows of a text repeat, ``firsts`` being the runs and windows of which it is the first document, sorted."""
    elsewhere, hashes = [], []
    for _, whole, runs, _, content in slices(words, least, seed):
        own = member(content.view(np.int64), firsts)[runs]
        own[~own] = member(whole[~own].view(np.int64), firsts)
        elsewhere.append(~own)
        hashes.append(whole)
    if not hashes:
        return np.zeros(0, bool)
    every = np.concatenate(hashes)
    out = np.ones(len(every), bool)
    out[np.unique(every, return_index=True)[1]] = False  # all but the first place of each window in the text itself
    return out | np.concatenate(elsewhere)


def maximal(windows_: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each maximal span that repeating windows cover, and the word after its last."""
    starts = np.flatnonzero(windows_)
    if not len(starts):
        return starts, starts
    apart = np.flatnonzero(np.diff(starts) > least)
    return starts[np.concatenate(([0], apart + 1))], starts[np.append(apart, len(starts) - 1)] + least


def kept_text(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """The words outside of the spans, joined by one space; a long text is read in pieces."""
    if not len(starts):
        return b" ".join(part for piece in pieces(data) if (part := b" ".join(piece.tobytes().split())))
    at, out = 0, []
    edges = np.stack([starts, stops], 1).ravel()
    for piece in pieces(data):
        words = piece.tobytes().split()
        # Words between edges 2k-1 and 2k are outside of all spans.
        inside = np.searchsorted(edges, np.arange(at, at + len(words)), "right") % 2
        out.append(b" ".join(w for w, cut in zip(words, inside.tolist(), strict=True) if not cut))
        at += len(words)
    return b" ".join(part for part in out if part)


def cut(least: int, seed: int):
    """(doc_id, n_words, spans, kept) of texts with the lists of what they are first with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n_words, begins, ends, sizes, kept = batch.column("firsts"), [], [], [], [], []
            for start, _, data, offsets in byte_chunks(batch, "text"):
                hashes, counts = word_hashes(data, offsets, lower=False)
                tops = np.concatenate(([0], np.cumsum(counts)))
                for k in range(len(counts)):
                    own = lists[start + k].values
                    firsts = np.sort(np.asarray(own)) if own is not None else np.zeros(0, np.int64)
                    a, b = maximal(repeated(hashes[tops[k] : tops[k + 1]], firsts, least, seed), least)
                    n_words.append(int(counts[k]))
                    begins.append(a)
                    ends.append(b)
                    sizes.append(len(a))
                    kept.append(kept_text(data[offsets[k] : offsets[k + 1]], a, b))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in (begins, ends)]
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.StructArray.from_arrays(flat, ["start", "stop"]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "spans": spans, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def first_runs(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """(_of, firsts): for each doc_id the runs and windows of which it is the first; docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = docs.mapInArrow(seeds(least, seed), f"doc_id {kind}, anchor long, run long")
    runs = materialise(runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("doc_id")), "runs")
    several = runs.groupBy("anchor").count().where("count > 1").select("anchor", F.lit(True).alias("several"))
    # An anchor with many different runs is many rows here, each of which finds its one partner: adaptive execution splits them.
    marked = runs.join(several, "anchor", "left")
    own = [F.collect_list(F.when(which, F.col("run"))).alias(name) for name, which in (("open", F.col("several")), ("firsts", F.col("several").isNull()))]
    lists = materialise(marked.groupBy(F.col("doc_id").alias("_of")).agg(*own), "lists")
    asked = lists.where(F.size("open") > 0).select("_of", "open")
    found = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_of"))).select("doc_id", "text", "open").mapInArrow(extend(least, seed), f"doc_id {kind}, anchor long, window long")
    opened = found.groupBy("anchor", "window").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("window").alias("windows"))
    every = lists.join(opened, F.col("_of").eqNullSafe(F.col("doc_id")), "left")
    return every.select("_of", F.concat("firsts", F.coalesce("windows", F.array().cast("array<long>"))).alias("firsts"))


def repeats(docs: DataFrame, least: int = 50, seed: int = SEED) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, spans and kept.

    spans: the maximal repeats as array of (start, stop) in words, stop being the word after the last; kept: the
    other words, joined by one space. ``least``: words of the shortest repeat, 2 at least.
    """
    seed = max(1, min(seed, least // 2))
    docs, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
    placed = docs.join(first_runs(docs, least, seed), F.col("doc_id").eqNullSafe(F.col("_of")), "left").select("doc_id", "text", "firsts")
    return placed.mapInArrow(cut(least, seed), f"doc_id {kind}, n_words long, spans array<struct<start: long, stop: long>>, kept string")


def removed() -> Column:
    """The number of words in ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
