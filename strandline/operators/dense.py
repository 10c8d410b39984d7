"""Dense retrieval by inner products, over vectors that are dealt into cells around centres.

``index`` fits centres on a bounded sample (``SAMPLE`` vectors for each centre, ``MOST_CENTRES`` centres) and puts every
vector into the cell of its nearest centre. A query scores at most q.c + |q| * radius in the cell of centre c. Searching
reads the cells with the best centres first; then, unless it is asked to stop there, those cells whose bound reaches the
k-th best score so far. So the result is exact, and what it costs hangs on how well the vectors are clustered. Cells
and the queries that come to them are dealt into parts of bounded size, and a part gives its k best for each query: pairs
of queries and vectors are never rows.

Vectors without a value, with a null or a number that isn't finite, or of another length than most have no score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.bm25 import best
from strandline.session import stored

MOST_CENTRES = 4096
SAMPLE = 16
ROUNDS = 4
#: Vectors and queries in a part of a cell; cells that a query reads first.
PART, QUERY_PART = 4096, 512
PROBES = 8


@dataclass(frozen=True)
class Cells:
    """vectors(cell, part, doc_id, v), their centres and radii by cell, cells(cell, n, parts)."""

    vectors: DataFrame
    cells: DataFrame
    centres: np.ndarray
    radii: np.ndarray


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))


def fitted(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres of a sample: its first vectors, moved to the means of what is near them."""
    centres = sample[:k].copy()
    for _ in range(ROUNDS):
        own = nearest_centre(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        sizes = np.bincount(own, minlength=k)[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def nearest_centre(v: np.ndarray, centres: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and how far it is."""
    own, norms = np.zeros(len(v), np.int64), (centres**2).sum(1)
    for a in range(0, len(v), rows):
        own[a : a + rows] = (norms - 2 * v[a : a + rows] @ centres.T).argmin(1)
    return own, np.sqrt(((v - centres[own]) ** 2).sum(1))


def index(vectors: DataFrame, cells: int | None = None) -> Cells:
    """Cells of vectors(doc_id, v): by default the square root of their number."""
    rows = vectors.select("doc_id", "v").where(usable(F.col("v")))
    n, width = rows.agg(F.count("*"), F.mode(F.size("v"))).first()
    rows = rows.where(F.size("v") == (width or 0))
    k = max(1, min(n, cells or math.isqrt(n), MOST_CENTRES))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(k * SAMPLE).select("v").toArrow()
    centres = fitted(matrix(some.column("v")), k) if n else np.zeros((1, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, gap = nearest_centre(matrix(batch.column("v")), centres)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(own, pa.int32()), "gap": gap, "doc_id": batch.column("doc_id"), "v": batch.column("v")})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "v"))
    placed = stored(rows.mapInArrow(assign, f"cell int, gap double, {kinds}"), "placed")
    sizes = stored(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "cells")
    radii = np.full(len(centres), -np.inf)
    for r in sizes.select("cell", "radius").collect():  # a row per centre
        radii[r.cell] = r.radius
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    parts = placed.join(F.broadcast(sizes.select("cell", "parts")), "cell").select("cell", part.alias("part"), "doc_id", "v")
    return Cells(stored(parts, "vectors"), sizes.select("cell", "n", "parts"), centres, radii)


def met(found: Cells, queries: DataFrame, probes: int, late: bool) -> DataFrame:
    """(query_id, q, cell): of queries(query_id, q, least) the ``probes`` cells with the best centres; or ``late``, those
    of the others whose bound reaches ``least``, all of them where it is null."""
    centres, radii = found.centres, found.radii

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                q = matrix(some.column("q"))
                scores = np.where(np.isfinite(radii), q @ centres.T, -np.inf)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                first = np.zeros(scores.shape, bool)
                np.put_along_axis(first, order, True, 1)
                chosen = first & np.isfinite(scores)
                if late:
                    least = np.array([-np.inf if x is None else x for x in some.column("least").to_pylist()])
                    bound = scores + np.sqrt((q**2).sum(1))[:, None] * np.maximum(radii, 0) * (1 + 1e-9)
                    chosen = ~first & np.isfinite(scores) & (bound >= least[:, None] - 2e-6)
                row, cell = np.nonzero(chosen)
                yield pa.RecordBatch.from_pydict({"query_id": some.column("query_id").take(pa.array(row)), "q": some.column("q").take(pa.array(row)), "cell": pa.array(cell, pa.int32())})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "q", "least").mapInArrow(run, f"query_id {kind}, q array<double>, cell int")


def scored(found: Cells, pairs: DataFrame, choose: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, doc_id, score) of pairs(query_id, q, cell); ``choose`` picks from the scores of one query in a part,
    whose vectors are in the order of their ids."""
    asked = stored(pairs, "asked")
    sizes = found.cells.join(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_PART).cast("int").alias("query_parts")), "cell")
    sizes = F.broadcast(sizes)  # a row per centre
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = found.vectors.join(sizes, "cell").select("cell", "part", every("query_parts").alias("query_part"), "doc_id", "v")
    right = asked.join(sizes, "cell").select("cell", every("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int").alias("query_part"), "query_id", "q")

    def run(own: pa.Table, queries: pa.Table) -> pa.Table:
        if not own.num_rows or not queries.num_rows:
            return pa.table({"query_id": queries.column("query_id").slice(0, 0), "doc_id": own.column("doc_id").slice(0, 0), "score": pa.array([], pa.float64())})
        own = own.sort_by("doc_id")
        scores = matrix(queries.column("q")) @ matrix(own.column("v")).T
        picked = [choose(s) for s in scores]
        row = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
        at = np.concatenate(picked).astype(np.int64)
        return pa.table({"query_id": queries.column("query_id").take(pa.array(row)), "doc_id": own.column("doc_id").take(pa.array(at)), "score": scores[row, at]})

    kinds = f"query_id {pairs.schema['query_id'].dataType.simpleString()}, doc_id {found.vectors.schema['doc_id'].dataType.simpleString()}, score double"
    keys = ["cell", "part", "query_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, kinds)


def k_best(k: int) -> Callable[[np.ndarray], np.ndarray]:
    """The places of the k best positive scores, which count as equal within a millionth; then the first ones."""

    def run(scores: np.ndarray) -> np.ndarray:
        steps = np.floor(scores * 1e6 + 0.5)
        some = np.flatnonzero(scores > 0)
        if len(some) > k:
            some = some[steps[some] >= np.partition(steps[some], len(some) - k)[len(some) - k]]
        return some[np.argsort(-steps[some], kind="stable")][:k]

    return run


def nearest(vectors: DataFrame | Cells, queries: DataFrame, k: int = 20, exact: bool = True, probes: int = PROBES) -> DataFrame:
    """The k best of queries(query_id, q) in vectors(doc_id, v) or cells of them; not ``exact``: in ``probes`` cells only."""
    found = vectors if isinstance(vectors, Cells) else index(vectors)
    asked = ready(found, queries).withColumn("least", F.lit(None).cast("double"))
    one = scored(found, met(found, asked, probes, False), k_best(k))
    if not exact:
        return best(one, k)
    one = stored(one, "probed")
    least = best(one, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
    more = asked.drop("least").join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    return best(one.union(scored(found, met(found, more, probes, True), k_best(k))), k)


def within(vectors: DataFrame | Cells, queries: DataFrame, least: float = 0.65) -> DataFrame:
    """(query_id, doc_id, score) of all that score ``least``."""
    found = vectors if isinstance(vectors, Cells) else index(vectors)
    asked = ready(found, queries).withColumn("least", F.lit(float(least)))
    return scored(found, met(found, asked, 0, True), lambda s: np.flatnonzero(s >= least))


def ready(found: Cells, queries: DataFrame) -> DataFrame:
    """Queries of the vectors' length."""
    q = F.col("q").cast("array<double>")
    return queries.select("query_id", q.alias("q")).where(usable(q) & (F.size("q") == found.centres.shape[1]))


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(query_id, q): the unit mean vector of each label."""
    parts = vectors.select(F.col(label).alias("query_id"), F.posexplode("v").alias("k", "x")).groupBy("query_id", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("m"))
    return means.select("query_id", unit(F.col("m")).alias("q"))
