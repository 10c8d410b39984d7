"""N-gram Jaccard self-join by T-occurrence search over inverted lists, in the manner of DivideSkip.

Two sets whose Jaccard similarity reaches t share at least T = t * max(size) shingles. So of a set's lists the
L = T - 1 last ones of one common order (and, as pairs shall meet several times, a few less) can be left out of
the merge: what is linked to it occurs T - L times in the others. Long lists come last in that order. What remains:

1. One pass hashes every text to its shingle set, and gives sets that are equal one id (classes of equal sets
   are linked as such and go on as one).
2. Counts of the shingles that come first in plain hash order tell long lists from short ones. They go into
   a bitmap of fixed size; where two shingles share a bit, the order is another but still one common order.
3. A second pass posts the T-occurrence part of every set. Each set gets its short lists (up to ``SHORT`` sets),
   sorted, and merges them with a heap; sets that occur in fewer of them than a linked set must are dropped.
4. What is left is probed in the long lists by binary search, with the exact overlap as result. That b is in the
   list of shingle g says that g is in the set of b, so the lists, which no task could hold, are probed from that
   side: the shingles of the smaller set are looked up in the larger one's sorted array.
5. A list that is long all the same (a large family of near copies) isn't merged: each of its sets is probed
   against one leader only. Those linked to it are in one component. Sets that aren't are compared
   with each other, and with those linked sets that the triangle inequality for the Jaccard distance leaves
   possible, in blocks, of which only spanning links come back. Lists of the same sets are taken once.
6. Verified links go to connected components.

No pair is lost at any step, nothing is sampled or capped. Texts are read again rather than moved: only texts
of sets that some list brought up are shuffled. What belongs to one shingle or to one leader is dealt out over
``SPREAD`` keys, so that no family is a task of its own.

Defined cases: null or empty texts and texts without words have an empty set, are linked with nothing, and are
their own component; rows that repeat a doc_id are joined as separate rows; an empty table gives an empty one;
a null doc_id takes part, and is no component's name if the component has another.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import is_table, lean, materialise, with_order
from .components import components
from .shingles import U, batch_sets, one_set, set_id

#: Sets in a list that is merged; bits of the bitmap of long lists (4 MB); sets in a block of a long list.
SHORT = 64
BITMAP_BITS = 25
BLOCK = 1024
SALTS = 64
#: Keys that the rows of one long list, and the pairs of one leader, are dealt out over.
SPREAD = 16
#: Elements of one set's lists that are merged at once.
MERGED = 200_000
#: One more shingle is posted for so many of a set.
EXTRA = 50


def posted(n: int, percent: int) -> int:
    """Shingles to post of a set of n: all but the T - 1 last, and a few more, so that pairs must share several."""
    return min(n, n - -(-percent * n // 100) + 1 + n // EXTRA)


def hash_sets(k: int, percent: int):
    """doc_id, number of shingles, set id, and of the first of equal sets in a task the low bits of what hash order would post."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, ids, heads = [], [], []
            for _, s in batch_sets(batch, k):
                sizes.append(len(s))
                ids.append(key := set_id(s) if len(s) else None)
                fresh = key is not None and key not in seen
                seen.add(key)
                heads.append((s[: posted(len(s), percent)].astype(np.uint32).view(np.int32)) if fresh else np.zeros(0, np.int32))
            flat = np.concatenate(heads) if heads else np.zeros(0, np.int32)
            tops = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "sid": pa.array(ids, pa.int64()), "head": pa.ListArray.from_arrays(tops, pa.array(flat))})

    return run


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Which of 2^BITMAP_BITS residues occur, as packed bits: 4 MB whatever the input."""
    low = values.select((F.col(column).cast("long").bitwiseAND((1 << BITMAP_BITS) - 1)).alias("x"))
    parts = low.groupBy(F.shiftright("x", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("x").bitwiseAND(32767)).alias("bits")).collect()
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    x = values.astype(np.int64) & ((1 << BITMAP_BITS) - 1)
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 > 0


def post(k: int, percent: int, long_lists: np.ndarray):
    """Postings (shingle, salt, set id, size): short lists first, long ones salted as they are gathered elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            grams, ids, sizes, salts = [], [], [], []
            for _, s in batch_sets(batch, k):
                if not len(s) or (key := set_id(s)) in seen:
                    continue
                seen.add(key)
                is_long = in_bitmap(long_lists, s.view(np.int64))
                order = np.concatenate([np.flatnonzero(~is_long), np.flatnonzero(is_long)])[: posted(len(s), percent)]
                grams.append(s[order].view(np.int64))
                salts.append(np.where(is_long[order], 1 + (key >> 7) % SALTS, 0).astype(np.int32))
                ids.append(np.full(len(order), key, np.int64))
                sizes.append(np.full(len(order), len(s), np.int32))
            if grams:
                yield pa.RecordBatch.from_pydict({"gram": np.concatenate(grams), "salt": np.concatenate(salts), "sid": np.concatenate(ids), "n": np.concatenate(sizes)})

    return run


def lists(percent: int, short: int):
    """From postings sorted by (gram, salt, sid): for each set (a) of a short list those after it whose sizes fit
    (others, sizes); and the rows of long lists, with their gram.

    Holds one list of up to ``short`` rows beside the batch; of a longer one its rows leave as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32)]
        open_key = None  # the list whose rows already left as long ones
        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("gram", "salt", "sid", "n"), strict=True)]
            yield from _lists(rows, False, percent, short, state := {"open": open_key})
            held, open_key = state["held"], state["open"]
        yield from _lists(held, True, percent, short, {"open": open_key})

    return run


def _lists(rows: list[np.ndarray], ended: bool, percent: int, short: int, state: dict) -> Iterator[pa.RecordBatch]:
    gram, salt, sid, n = rows
    if len(gram):
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]) | (sid[1:] != sid[:-1])
        gram, salt, sid, n = (x[fresh] for x in rows)
    if not len(gram):
        state["held"] = rows
        return
    begins = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]))))
    sizes = np.diff(np.append(begins, len(gram)))
    key = (int(gram[-1]), int(salt[-1]))
    whole = len(begins) if ended or sizes[-1] > short or key == state["open"] else len(begins) - 1
    is_long = (sizes > short) | (salt[begins] > 0)
    if state["open"] == (int(gram[0]), int(salt[0])):
        is_long[0] = True
    state["held"] = [x[begins[whole] :] for x in (gram, salt, sid, n)] if whole < len(begins) else [x[:0] for x in (gram, salt, sid, n)]
    state["open"] = key if whole == len(begins) and is_long[-1] else None
    is_long, begins, sizes = is_long[:whole], begins[:whole], sizes[:whole]
    # Rows are sorted by set id, so of two sets the first has the smaller id.
    ends = np.repeat(begins + sizes, sizes)
    first = np.flatnonzero(np.repeat(~is_long, sizes) & (np.arange(len(ends)) + 1 < ends))
    after = ends[first] - first - 1
    i = np.repeat(np.arange(len(first)), after)
    j = np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after) + first[i] + 1
    own, other = n[first[i]].astype(np.int64), n[j].astype(np.int64)
    fits = 100 * np.minimum(own, other) >= percent * np.maximum(own, other)
    i, j = i[fits], j[fits]
    left = np.bincount(i, minlength=len(first))
    first, left = first[left > 0], left[left > 0]
    tops = np.concatenate(([0], np.cumsum(left))).astype(np.int32)
    if len(first):
        yield pa.RecordBatch.from_pydict({"gram": pa.nulls(len(first), pa.int64()), "a": sid[first], "na": n[first], "others": pa.ListArray.from_arrays(tops, pa.array(sid[j])), "sizes": pa.ListArray.from_arrays(tops, pa.array(n[j]))})
    if is_long.any():
        at = np.flatnonzero(np.repeat(is_long, sizes))
        none = pa.ListArray.from_arrays(pa.array([None] * len(at) + [0], pa.int32()), pa.array([], pa.int64())), pa.ListArray.from_arrays(pa.array([None] * len(at) + [0], pa.int32()), pa.array([], pa.int32()))
        yield pa.RecordBatch.from_pydict({"gram": gram[at], "a": sid[at], "na": n[at], "others": none[0], "sizes": none[1]})


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, seen) from each set's short lists, which come one after the other: a heap merges them, and what
    comes out of it several times in a row occurs in so many. Lists of a set that go on in the next batch wait for it."""
    a = na = None
    own: list[list[int]] = []
    sizes: dict[int, int] = {}
    before: Counter = Counter()
    elements = 0

    def counted() -> Counter:
        return before + Counter({b: sum(1 for _ in same) for b, same in groupby(heapq.merge(*own))})

    for batch in batches:
        out = []
        for set_, n, others, ns in zip(*[batch.column(c).to_pylist() for c in ("a", "na", "others", "sizes")], strict=True):
            if set_ != a:
                out += [(a, b, na, sizes[b], seen) for b, seen in counted().items()]
                a, na, own, sizes, before, elements = set_, n, [], {}, Counter(), 0
            own.append(others)
            sizes.update(zip(others, ns, strict=True))
            elements += len(others)
            if elements > MERGED:
                # Of a very large set the lists so far become counts, so that it is never held as a whole.
                before, own, elements = counted(), [], 0
        if out:
            yield _pairs(out)
    if a is not None:
        yield _pairs([(a, b, na, sizes[b], seen) for b, seen in counted().items()])


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("a", "b", "na", "nb", "seen"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def texts_of(docs: DataFrame, sids: DataFrame, k: int) -> DataFrame:
    """(sid, text) for the set ids in ``sids``: others are left where they are, but for a few that share a bit."""
    bits = bitmap(sids, "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, rows = [], []
            for row, s in batch_sets(batch, k):
                if len(s) and (key := set_id(s)) not in seen and in_bitmap(bits, np.array([key]))[0]:
                    seen.add(key)
                    keys.append(key)
                    rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pydict({"sid": pa.array(keys, pa.int64()), "text": batch.column("text").take(pa.array(rows))})

    found = docs.select("text").mapInArrow(lean(run), "sid long, text string")
    # Equal sets from other tasks: any of their texts will do.
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("sid").orderBy("sid"))).where("_r = 1").drop("_r")


def probe(k: int):
    """The overlap of each pair, by binary search of the smaller set in the larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            a = batch.column("a").to_pylist()
            text_a = batch.column("text_a")
            shared, sizes = [], []
            for row, other in batch_sets(batch, k, "text_b"):
                if a[row] != last:
                    last, own = a[row], one_set(text_a[row].as_py(), k)
                few, many = (own, other) if len(own) <= len(other) else (other, own)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                shared.append(int((many[at] == few).sum()))
                sizes.append(len(own) + len(other))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "shared": pa.array(shared, pa.int64()), "both": pa.array(sizes, pa.int64())})

    return run


def verify(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, shared, both) for the pairs (a, b, spread) of set ids; spread: 0, or one of ``SPREAD`` shares of a leader's pairs."""
    led = pairs.where("spread > 0").select(F.col("a").alias("sid"), "spread").distinct()
    own = texts.withColumn("spread", F.lit(0)).unionByName(texts.join(led, "sid"))
    right = pairs.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
    full = right.join(own.select(F.col("sid").alias("a"), "spread", F.col("text").alias("text_a")), ["a", "spread"])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(lean(probe(k)), "a long, b long, shared long, both long")


def share(sid: str) -> Column:
    return (F.pmod(F.xxhash64(sid), F.lit(SPREAD)) + 1).cast("int")


def with_gram(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """``rows`` with what ``grams`` has for their gram, a gram's rows being dealt out over ``SPREAD`` keys."""
    many = grams.withColumn("spread", F.explode(F.sequence(F.lit(1), F.lit(SPREAD))))
    return rows.withColumn("spread", share("sid")).join(many, ["gram", "spread"]).drop("spread")


def block_links(k: int, percent: int):
    """Spanning links of all linked pairs of one block with another (or with itself)."""

    def run(group: pa.Table) -> pa.Table:
        sids = group.column("sid").to_numpy()
        sets = [one_set(t, k) for t in group.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        codes, where = np.unique(np.concatenate(sets), return_inverse=True)
        uses = np.bincount(where, minlength=len(codes))
        columns = np.cumsum(uses > 1) - 1
        rows = np.repeat(np.arange(len(sets)), sizes)
        keep = uses[where] > 1
        rows, cols = rows[keep], columns[where[keep]]
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        shared, step = np.zeros((len(sets), len(sets)), np.float32), 1024
        for start in range(0, int(cols[-1]) + 1 if len(cols) else 0, step):
            a, b = np.searchsorted(cols, [start, start + step])
            part = np.zeros((len(sets), step), np.float32)
            part[rows[a:b], cols[a:b] - start] = 1
            for r in range(0, len(sets), 256):
                shared[r : r + 256] += part[r : r + 256] @ part.T
        linked = np.zeros(shared.shape, bool)
        for r in range(0, len(sets), 256):
            both = shared[r : r + 256].astype(np.int64)
            linked[r : r + 256] = 100 * both >= percent * (sizes[r : r + 256, None] + sizes[None] - both)
        root = np.full(len(sets), -1)
        for i in range(len(sets)):
            if root[i] < 0:
                root[i], edge = i, np.array([i])
                while len(edge):
                    new = np.flatnonzero(linked[edge].any(0) & (root < 0))
                    root[new], edge = i, new
        out = root != np.arange(len(sets))
        return pa.table({"a": sids[out], "b": sids[root[out]]})

    return run


def family_links(lists: DataFrame, checked: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """What the leaders of long lists leave open; None if nothing is."""
    apart = 1 - F.col("shared") / (F.col("both") - F.col("shared"))
    # Sets whose sizes rule out a link with the leader have been verified too, so each row has a distance.
    far = lists.where("sid <> leader").join(
        checked.select(F.col("a").alias("leader"), F.col("b").alias("sid"), apart.alias("d"), (100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).alias("linked")), ["leader", "sid"]
    )
    far = materialise(far.select("gram", "sid", "d", "linked"), "families")
    least = far.where("not linked").groupBy("gram").agg(F.min("d").alias("least"))
    # d(x, y) >= d(leader, y) - d(leader, x); the margin is for rounding.
    left = with_gram(far, least).where(~F.col("linked") | (F.col("d") + (1 - percent / 100) + 1e-9 >= F.col("least"))).select("gram", "sid")
    left = materialise(left, "left")
    sizes = left.groupBy("gram").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1")
    left = with_gram(left, sizes).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    left = left.select("gram", "sid", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = materialise(left.select("gram", "sid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "blocks")
    if left.isEmpty():
        return None
    texts = texts_of(docs, left.select("sid"), k)
    return left.join(texts, "sid").groupBy("gram", "i", "j").applyInArrow(block_links(k, percent), "a long, b long")


def enough(merged: DataFrame, skipped: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the merged pairs that met in as many short lists as two linked sets must: T - L.

    Of two sets, the one whose posted part ends first in the common order shares with the other what both
    posted, and at most all that it has not posted. What it shares in long lists isn't seen here, but is no more
    than the rows that either has there.
    """
    pairs = merged.join(skipped.select(F.col("sid").alias("a"), F.col("skipped").alias("sa")), "a", "left").join(skipped.select(F.col("sid").alias("b"), F.col("skipped").alias("sb")), "b", "left")

    def hidden(n: str) -> Column:
        own = F.col(n).cast("long")
        return own - F.least(own, own - F.ceil(percent * own / 100) + 1 + F.floor(own / EXTRA))

    needed = F.ceil(percent * (F.col("na") + F.col("nb")).cast("long") / (100 + percent))
    least = needed - F.greatest(hidden("na"), hidden("nb")) - F.least(F.coalesce("sa", F.lit(0)), F.coalesce("sb", F.lit(0)))
    return pairs.where(F.col("seen") >= least).select("a", "b")


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of every row, and links (a, b) between set ids that have the components of all links."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = materialise(docs.select("doc_id", "text").mapInArrow(lean(hash_sets(k, percent)), f"doc_id {kind}, n long, sid long, head array<int>"), "sets")
    counts = sets.select(F.explode("head").alias("gram")).groupBy("gram").count().where(F.col("count") > SHORT)
    long_lists = bitmap(counts, "gram")
    postings = docs.select("text").mapInArrow(lean(post(k, percent, long_lists)), "gram long, salt int, sid long, n int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "gram long, a long, na int, others array<long>, sizes array<int>"
    listed = materialise(postings.repartition(parts, "gram", "salt").sortWithinPartitions("gram", "salt", "sid").mapInArrow(lean(lists(percent, SHORT)), kinds), "lists")
    merged = listed.where("gram is null").drop("gram").repartition(parts, "a").sortWithinPartitions("a").mapInArrow(lean(merge), "a long, b long, na int, nb int, seen int")
    longs = listed.where("gram is not null").select("gram", F.col("a").alias("sid"), F.col("na").alias("n"))
    skipped = longs.groupBy("sid").agg(F.count("*").alias("skipped"))
    heads = longs.groupBy("gram").agg(F.count("*").alias("m"), F.min("sid").alias("leader"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("y")).where("m > 1")
    # Shingles of one passage have the same sets, again and again: one of them is enough.
    heads = materialise(heads.groupBy("m", "leader", "x", "y").agg(F.min("gram").alias("gram")).select("gram", "m", "leader"), "heads")
    longs = with_gram(longs, heads)
    short = longs.where(F.col("m") <= SHORT).select("gram", "sid", "n")
    near = F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    more = short.alias("x").join(short.alias("y"), F.expr("x.gram = y.gram and x.sid < y.sid") & near).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
    longs = materialise(longs.where(F.col("m") > SHORT).select("gram", "sid", "leader"), "long")
    led = longs.where("sid <> leader").select(F.col("leader").alias("a"), F.col("sid").alias("b"), share("sid").alias("spread"))
    pairs = enough(merged, skipped, percent).union(more).withColumn("spread", F.lit(0)).union(led).groupBy("a", "b").agg(F.max("spread").alias("spread"))
    pairs = materialise(pairs, "pairs")
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("sid")), k)
    checked = materialise(verify(pairs, texts, k), "checked")
    links = checked.where(100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).select("a", "b")
    rest = family_links(longs, checked, docs, k, percent)
    return sets.drop("head"), links if rest is None else links.union(rest)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Two rows are linked if 100 * shared shingles >= percent * shingles of either, by the distinct shingles
    of ``k`` words.
    """
    sets, links = jaccard_links(docs, k, percent)
    roots = components(links)
    classes = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(names, "root").select("sid", "component_id"), "named")
    return sets.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each group: that with the smallest doc_id, of several the first one of the table. Rows
    without a doc_id come last: one stays only if no other row of its group has a doc_id."""
    if not is_table(docs):
        docs = materialise(docs, "docs")
    part, row = (next(n for n in (name + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns) for name in ("_part", "_row"))
    placed = with_order(docs, part, row)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(part).alias("part"), F.col(row).alias("row"))
    grouped = jaccard_components(placed.select(own.alias("doc_id"), "text"), k, percent)
    kept = grouped.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.part").alias(part), F.col("doc_id.row").alias(row))
    return placed.join(kept, [part, row], "left_semi").drop(part, row)
