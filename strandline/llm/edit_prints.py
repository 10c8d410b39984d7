"""Document fingerprints by randomised edit embedding: walks that map edit distance to Hamming distance.

All texts share one source of random bits. A walk reads a text's characters in order; at each time step it
repeats the present character or goes on to the next, as the bit for that character and time says. Texts that
differ by few edits have walks that meet again soon after each edit, so that what the walks read at equal times
differs in few places. The fingerprint keeps one bit, drawn by position, of what is read at BITS times.

The times are sampled alike for all lengths: each of the BITS samples has a fixed sequence of record times, and
takes the last one that lies within the walk, which is uniform over the walk, and the same for walks of nearly
the same length. The likeness of two fingerprints is 1 - 2 * differing bits / BITS, not below 0: unrelated
texts agree in half of their bits.

Defined cases: a null text is the empty one, whose fingerprint is all zeros; a table of one document is its own
next document; rows that repeat a doc_id follow each other by a hash of the text, then text; rows with a null doc_id come last; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise
from .components import components
from .shingles import U, mix

BITS = 512
#: Characters fall into so many classes, and random bits repeat after so many time steps.
CLASSES = 64
PERIOD = 8192
#: Characters that one vectorised run of walks handles; bounds a worker's memory.
CHARS = 4_000_000
#: So few walks or fewer are taken one by one. Bytes of a range of documents in order, which one task reads.
FEW = 48
RANGE_BYTES = 64 << 20
#: Bands, and the chance at least that two fingerprints of the likeness sought agree in one of them.
BANDS = 48
AGREE = 0.13
#: Fingerprints in a bucket whose pairs are listed; fingerprints in a block of a larger bucket.
SMALL = 64
BLOCK = 2048


@cache
def dwell() -> np.ndarray:
    """By class and time: for how many steps a walk that reaches a character then stays on it."""
    bits = mix(np.arange(CLASSES * PERIOD, dtype=U) + U(0x51ED270B0A1F39C1)).reshape(CLASSES, PERIOD) & U(1)
    twice = np.concatenate([bits, bits], axis=1) > 0
    ahead = np.where(twice, np.arange(2 * PERIOD)[None], 4 * PERIOD)
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1]
    return (ahead[:, :PERIOD] - np.arange(PERIOD)[None] + 1).astype(np.int32).ravel()


@cache
def records() -> np.ndarray:
    """By sample: its record times, ascending, up to 2^40. The record after r is above m with probability (r+1)/(m+1)."""
    out = np.zeros((BITS, 96), np.int64)
    for k in range(1, out.shape[1]):
        u = (mix(np.arange(BITS, dtype=U) * U(1009) + U(k * 7_368_787)) >> U(11)).astype(np.float64) / 2.0**53
        out[:, k] = np.minimum(np.floor((out[:, k - 1] + 1) / np.maximum(u, 2.0**-40)), 2.0**45 + k)
        out[:, k] = np.maximum(out[:, k], out[:, k - 1] + 1)
    return out


def sampled(ends: int) -> np.ndarray:
    """The times at which a walk of that many steps is read."""
    r = records()
    return np.take_along_axis(r, (r < ends).sum(1, keepdims=True) - 1, axis=1).ravel()


def prints(texts: list[str]) -> list[str]:
    """The fingerprint of each text as hex digits."""
    out = ["0" * (BITS // 4)] * len(texts)
    order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: (-len(texts[k]), k))
    at = 0
    while at < len(order):
        to, size = at, 0
        while to < len(order) and (to == at or size + len(texts[order[to]]) <= CHARS):
            size += len(texts[order[to]])
            to += 1
        for k, found in zip(order[at:to], _walk([texts[k] for k in order[at:to]]), strict=True):
            out[k] = found
        at = to
    return out


def _walk(texts: list[str]) -> Iterator[str]:
    """Fingerprints of texts that are sorted from long to short, all walks taking each step together."""
    sizes = np.array([len(t) for t in texts])
    # Walks that still read at step i: those of the first alive[i] texts. Step i's characters lie together.
    alive = np.cumsum(np.bincount(sizes, minlength=sizes[0] + 1)[::-1])[::-1][1:]
    rows = np.concatenate(([0], np.cumsum(alive)))
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    steps = np.empty(int(rows[-1]), np.int32)
    for k, p in enumerate(points):
        steps[rows[: len(p)] + k] = ((p * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int32) * PERIOD
    table, now = dwell(), np.zeros(len(texts), np.int32)
    # While many walks are left they take each step together; the last ones, of the longest texts, end one by one.
    together = int(np.searchsorted(-alive, -FEW, "right"))
    for first in range(0, together, 1 << 16):
        some = slice(first, min(first + (1 << 16), together))
        for top, n in zip(rows[some].tolist(), alive[some].tolist(), strict=False):
            part, t = steps[top : top + n], now[:n]
            part += t & (PERIOD - 1)
            t += table[part]
            part[:] = t
    for k in range(int(alive[together]) if together < len(alive) else 0):
        _finish(steps, rows[together : sizes[k]] + k, int(now[k]))
    lanes = np.arange(BITS, dtype=U) * U(0x9E3779B97F4A7C15)
    for k, p in enumerate(points):
        ends = steps[rows[: len(p)] + k]
        chars = p[np.searchsorted(ends, sampled(int(ends[-1])), "right")]
        yield np.packbits((mix(chars.astype(U) ^ lanes) & U(1)).astype(np.uint8)).tobytes().hex()


def _finish(steps: np.ndarray, where: np.ndarray, t: int) -> None:
    """The rest of one walk, in plain numbers: for a single text that is a hundred times faster than by arrays of one."""
    table = dwell_list()
    for first in range(0, len(where), 1 << 16):
        at, ends = where[first : first + (1 << 16)], []
        for kind in steps[at].tolist():
            t += table[kind + (t & (PERIOD - 1))]
            ends.append(t)
        steps[at] = ends


@cache
def dwell_list() -> list[int]:
    return dwell().tolist()


def likeness(a: str, b: str) -> float:
    differing = (int(a, 16) ^ int(b, 16)).bit_count()
    return max(0.0, 1 - 2 * differing / (4 * len(a)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(prints(texts), pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def sampler(width: int, bands: int):
    """(fingerprint, band, bits): the bits that each band samples, at places which a seeded hash draws once for all."""
    places = np.argsort(mix(np.arange(bands * BITS, dtype=U) + U(0xA24BAED4963EE407)).reshape(bands, BITS), axis=1)[:, :width]
    weights = np.int64(1) << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.column("fingerprint").slice(at, 1024)
                keys = bits_of(part.to_pylist())[:, places].astype(np.int64) @ weights
                rows = np.repeat(np.arange(len(part)), bands)
                yield pa.RecordBatch.from_pydict({"fingerprint": part.take(pa.array(rows)), "band": np.tile(np.arange(bands, dtype=np.int32), len(part)), "bits": keys.ravel()})

    return run


def bits_of(found: list[str]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bytes.fromhex("".join(found)), np.uint8)).reshape(len(found), BITS)


def differing(a: str, b: str) -> Column:
    def part(c: str, k: Column) -> Column:
        return F.conv(F.substring(c, k * 8 + 1, F.lit(8)), 16, 10).cast("long")

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS // 32 - 1)), F.lit(0), lambda s, k: s + F.bit_count(part(a, k).bitwiseXOR(part(b, k))))


def block_links(most: int):
    """Of all pairs in a block that differ in ``most`` bits at most, links that span their components."""

    def run(group: pa.Table) -> pa.Table:
        found = group.column("fingerprint").to_pylist()
        bits = bits_of(found).astype(np.float32)
        ones = bits.sum(1)
        linked = ones[:, None] + ones[None] - 2 * (bits @ bits.T) <= most
        seen, out = np.zeros(len(found), bool), []
        for i in range(len(found)):
            if seen[i]:
                continue
            edge = np.array([i])
            seen[i] = True
            while len(edge):
                new = np.flatnonzero(linked[edge].any(0) & ~seen)
                out += zip(edge[linked[edge][:, new].argmax(0)].tolist() if len(new) else [], new.tolist(), strict=True)
                seen[new], edge = True, new
        return pa.table({"a": pa.array([min(found[i], found[j]) for i, j in out], pa.string()), "b": pa.array([max(found[i], found[j]) for i, j in out], pa.string())})

    return run


def near(printed: DataFrame, least: float = 0.9, bands: int = BANDS) -> DataFrame:
    """(a, b, likeness): verified links, of ``least`` at least, between distinct fingerprints that share a band.

    A band samples so many bits that two fingerprints of that likeness agree in it with a chance of ``AGREE``; all
    bands miss such a pair with a chance of about 0.001. Copies are one fingerprint. Buckets of up to ``SMALL``
    fingerprints give all their links. Of larger ones each fingerprint is held against one leader; those that it
    leaves open, by the triangle inequality, are compared in blocks, and links that span their components come back.
    """
    apart = (1 - least) / 2
    most = int(apart * BITS + 1e-9)
    width = max(8, min(62, int(math.log(AGREE) / math.log(1 - apart)))) if apart > 0 else 62
    posted = materialise(printed.select("fingerprint").distinct().mapInArrow(sampler(width, bands), "fingerprint string, band int, bits long"), "bands")
    buckets = posted.groupBy("band", "bits").agg(F.count("*").alias("m"), F.min("fingerprint").alias("leader")).where("m > 1")
    posted = materialise(posted.join(buckets, ["band", "bits"]), "buckets")
    small, large = posted.where(F.col("m") <= SMALL), posted.where(F.col("m") > SMALL)
    pairs = small.alias("x").join(small.alias("y"), F.expr("x.band = y.band and x.bits = y.bits and x.fingerprint < y.fingerprint")).select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))

    led = large.where("fingerprint <> leader").withColumn("d", differing("leader", "fingerprint"))
    open_ = led.where(F.col("d") > most).groupBy("band", "bits").agg(F.min("d").alias("least"))
    left = led.join(open_, ["band", "bits"]).where((F.col("d") > most) | (F.col("d") + most >= F.col("least")))
    left = left.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    left = left.select("band", "bits", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = left.select("band", "bits", "fingerprint", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    spanning = left.groupBy("band", "bits", "i", "j").applyInArrow(block_links(most), "a string, b string")

    links = pairs.union(led.where(F.col("d") <= most).select(F.col("leader").alias("a"), F.col("fingerprint").alias("b"))).union(spanning).distinct()
    return links.withColumn("likeness", F.greatest(F.lit(0.0), 1 - 2 * differing("a", "b") / BITS)).where(differing("a", "b") <= most)


def near_groups(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id (the smallest doc_id that links of ``least`` reach).

    Null and empty texts are linked with nothing.
    """
    printed = materialise(fingerprints(docs), "prints")
    own = printed.where(F.col("fingerprint") != "0" * (BITS // 4))
    roots = components(near(own, least).select("a", "b"))
    classes = own.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("fingerprint", "component_id")
    return printed.join(named, "fingerprint", "left").select("doc_id", "fingerprint", F.coalesce("component_id", "doc_id").alias("component_id"))


#: Results of a document, and how they are sent.
RESULTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULTS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Ranges whose numbers one task puts in order.
SLICE = 1024


def in_order(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text): documents by descending doc_id, those without one last, in ranges of about ``RANGE_BYTES``.

    Rows of one doc_id (and those without) come by a hash of the text, which the ranges are cut by as well, so that
    however many there are, they are several ranges. The order is Spark's own range sort.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    by = [F.desc_nulls_last("doc_id"), F.col("h")]
    return rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by, "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")


def results(pairs: list[tuple]) -> list[list]:
    """Columns of results for (doc_id, text, text of the next document)."""
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for _, t, after in pairs]
    whole = list({t: None for _, t, after in pairs for t in (t, after)})
    found = prints([*whole, *edited])
    by = dict(zip(whole, found, strict=False))
    rows = [
        (doc_id, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), by[t], ep, likeness(by[t], ep), likeness(by[t], by[after]))
        for (doc_id, t, after), e, ep in zip(pairs, edited, found[len(whole) :], strict=True)
    ]
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)]


def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of ``in_order`` to results, and its ends (end: 1 the first, 2 the last document, with their texts): each
    document has the one after it, but for the last, whose next one is another range's first."""
    names = [*NAMES, "part", "end", "text"]

    def end(which: int, part: int, doc_id: int | None, text: str) -> pa.RecordBatch:
        empty = [pa.nulls(1, k) for k in KINDS[1:]]
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *empty, pa.array([part], pa.int32()), pa.array([which], pa.int32()), pa.array([text])], names)

    last: tuple | None = None  # the document that waits for its next one
    for batch in batches:
        ready: list[tuple] = []
        for part, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "text")], strict=True):
            text = text or ""
            if last is None:
                yield end(1, part, doc_id, text)
            else:
                ready.append((*last[1:], text))
            last = part, doc_id, text
        for at in range(0, len(ready), 1000):
            some = results(ready[at : at + 1000])
            yield pa.RecordBatch.from_arrays([*some, *[pa.nulls(len(some[0]), k) for k in (pa.int32(), pa.int32(), pa.string())]], names)
    if last is not None:
        yield end(2, *last)


def pair_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "after")], strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays(results(rows), NAMES)


def next_parts(parts: DataFrame) -> DataFrame:
    """(part, next): of the ranges that hold anything each one's next, and of the last the first."""
    sliced = parts.withColumn("slice", F.floor(F.col("part") / SLICE))
    heads = sliced.groupBy("slice").agg(F.min("part").alias("head"))
    # One number for each SLICE ranges.
    heads = heads.select("slice", F.coalesce(F.lead("head").over(Window.orderBy("slice")), F.min("head").over(Window.partitionBy(F.lit(0)))).alias("after"))
    own = F.lead("part").over(Window.partitionBy("slice").orderBy("part"))
    return sliced.withColumn("own", own).join(heads, "slice").select("part", F.coalesce("own", "after").alias("next"))


def edited_prints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its text with the last third replaced by the begin of the next
    document (descending doc_id, then by a hash of the text), and the likeness of its own to that and to the next document's.

    Texts are shuffled once. What a range can't say by itself is said by joins of the ranges' first and last documents;
    nothing but the number of bytes, and Spark's sample for the ranges, reaches the driver.
    """
    ordered = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = materialise(ordered.mapInArrow(pair_up, f"{RESULTS}, part int, end int, text string"), "ranges")
    firsts = found.where("end = 1").select("part", "text")
    after = next_parts(firsts.select("part")).join(firsts.select(F.col("part").alias("next"), F.col("text").alias("after")), "next")
    ends = found.where("end = 2").select("part", "doc_id", "text").join(after, "part").select("doc_id", "text", "after")
    return found.where("end is null").select(*NAMES).union(ends.mapInArrow(pair_ends, RESULTS))
