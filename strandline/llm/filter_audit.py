"""What filters of a chain remove, and how much of that hangs on their order: path counting on the lattice of subsets.

A state of the lattice is the set of filters that have been applied, and an edge applies one more. What an edge
removes hangs on its state alone, not on the order in which the state was reached, so 2^n states and n * 2^(n-1)
edges answer for all n! orders:

1. One pass reads every row's failures as a bit mask. Rows become counts by (part, mask), at most 2^n for a part,
   combined before they are shuffled.
2. Forward counts (orders that reach a state) and backward counts (orders that leave it) come from dynamic
   programming over the lattice. An edge from S to S + f lies on forward(S) * backward(S + f) orders.
3. Every edge gets what it removes, leaves and finds removed already. A filter's Shapley value is the sum of its edges'
   removals by that weight (over all orders, not divided by their number); the steps of an order are n of the same edges.

The lattice and the list of orders hang on the number of filters only. All n! orders are listed, so filters are few.

Defined cases: a null condition is no failure; null texts are empty; rows with a null part belong to the part of the
empty string; an empty table has no parts and gives no rows. Repeated rows count as often as they come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, materialise, pieces

#: Which bytes count as symbols.
SYMBOLS = np.isin(np.arange(256), list(b"#$%&*|"))
FACTS = "n_words long, n_distinct long, n_capitals long, n_symbols long, n_points long, digest binary"


def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every whole text, and its SHA-256; the other columns of the batch stay. Long texts are read in pieces."""
    for batch in batches:
        rows = []
        for _, _, data, offsets in byte_chunks(batch, "text"):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text, n, seen = data[a:b], 0, set()
                for piece in pieces(text):
                    words = piece.tobytes().split()  # on ASCII white space, as bytes do
                    n += len(words)
                    seen.update(words)
                rows.append((n, len(seen), int(((text >= 65) & (text <= 90)).sum()), int(SYMBOLS[text].sum()), int(((text & 0xC0) != 0x80).sum()), hashlib.sha256(text).digest()))
        kept = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        counts = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]] if rows else [pa.array([], pa.int64())] * 5
        named = dict(zip(("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points"), counts, strict=True))
        yield pa.RecordBatch.from_pydict(kept | named | {"digest": pa.array([r[5] for r in rows], pa.binary())})


def text_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, counts, digest, copy) of docs(doc_id, lang, text); copy: a smaller doc_id has the same text.

    The least doc_id of each text is found by a sum that is combined before the shuffle, and goes back to its row by
    doc_id. So a text that a third of all rows share is nowhere a group. Rows of one doc_id are no copies of each
    other; a row without doc_id is no copy, and has none.
    """
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang"))
    rows = materialise(docs.select("doc_id", "lang", "text").mapInArrow(facts, f"{kinds}, {FACTS}"), "facts")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("digest").alias("firsts"))
    # As the least of its text, a doc_id has as many digests as it has rows with different texts.
    joined = rows.join(firsts, "doc_id", "left")
    return joined.withColumn("copy", F.col("doc_id").isNotNull() & ~F.coalesce(F.array_contains("firsts", F.col("digest")), F.lit(False))).drop("firsts")


def paths(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through the edge that adds the filter to the state) for every edge of the lattice."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(1, full + 1):
        forward[state] = sum(forward[state ^ (1 << f)] for f in range(n) if state >> f & 1)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | (1 << f)] for f in range(n) if not state >> f & 1)
    return [(s, f, forward[s] * backward[s | (1 << f)]) for s in range(full + 1) for f in range(n) if not s >> f & 1]


def audit(rows: DataFrame, filters: dict[str, Column], part: Column, marks: Sequence[str] = ()) -> DataFrame:
    """One row for each part, order of ``filters`` (named by their letters) and step.

    filters: name and the condition under which a row fails. marks: boolean columns whose rows are counted where they
    are lost. Columns: part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost, shapley.
    """
    names = list(filters)
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(filters.values())), F.lit(0)).cast("int")
    one = [F.coalesce(F.col(m), F.lit(False)).cast("long").alias(m) for m in marks]
    sums = [F.sum(m).alias(m) for m in marks]
    counts = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *one).groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)

    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(w).cast("long").alias("orders")) for s, f, w in paths(len(names))])
    met = counts.select("part", "mask", "n", *marks, F.explode(edges).alias("e")).select("part", "mask", "n", *marks, "e.*")
    bit = F.expr("shiftleft(1, f)")
    fails, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0

    def total(which: Column, what: str, name: str) -> Column:
        return F.sum(F.when(which, F.col(what)).otherwise(0)).alias(name)

    lost = [total(fails & ~gone, m, f"{m}_lost") for m in marks]
    by_edge = met.groupBy("part", "state", "f", "orders").agg(
        total(~fails & ~gone, "n", "kept"), total(fails & ~gone, "n", "removed"), total(fails & gone, "n", "redundant"), total(F.col("mask") == bit, "n", "unique_fails"), *lost
    )
    weighed = by_edge.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    orders = [("".join(names[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(len(names))) for k in range(len(names))]
    steps = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, state int, f int")
    out = by_edge.join(weighed, ["part", "f"]).join(F.broadcast(steps), ["state", "f"])  # n! * n rows, whatever the input
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley")


def text_filters() -> dict[str, Column]:
    """Short texts, repeated words, capitals, symbols, copies: conditions over ``text_facts``."""
    c = F.col
    return {
        "A": c("n_words") < 100,
        "B": 100 * c("n_distinct") < 80 * c("n_words"),
        "C": 100 * c("n_capitals") > 10 * c("n_points"),
        "D": c("n_symbols") > 0,
        "E": c("copy"),
    }


def audit_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of ``text_filters`` over docs(doc_id, lang, text), by language; lost good and toxic rows are counted by
    labels(doc_id, quality, toxic). Of several labels of one doc_id each counts; rows of the same doc_id share them."""
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(text_facts(docs).join(marked, "doc_id", "left"), text_filters(), F.col("lang"), ("good", "toxic"))
