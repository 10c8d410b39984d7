"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's rows are shuffled by a seeded hash and cut into blocks. A source of weight w has its block i
(from 0) released at slot floor(i / w), due before slot ceil((i + 1) / w). In every slot the released block
with the earliest deadline is taken (ties: the source that sorts first). As the weights add up to one, every
block meets its deadline, so that at any time each source is less than one block away from its share.

Weights are whole parts of a period, and the schedule repeats with it: one period, a table of ``period`` rows
(a thousand, or four for each source) that depends on the weights alone, is computed once, and block i of a source
is put into repetition i div parts at the slot of block i mod parts. Tables of sources, not rows of documents, are
what a single task handles there: 10,000 sources take seconds. A source that has run out leaves its slots empty, and the others keep the
order in which they would come; no row is dropped or repeated.

Defined cases: null sources are a source of their own; a null or empty text is a row like others; rows that are
alike in doc_id, source and text are interchangeable; an empty table gives an empty one; sources without a
given weight get the smallest one, a part of the period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash63, rank_within

SEED = "mix-1"
#: Rows of a block; slots of a period (raised to four for each source); power of a source's size that is its weight.
BLOCK_ROWS = 8
PERIOD = 1000
POWER = 0.5
#: Slots that are placed before they are put aside.
SPAN = 256


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def parts(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, power: float = POWER) -> DataFrame:
    """(_source, parts, place, period): whole parts by largest remainder, at least one each; place: order by name.

    Without ``weights`` a source's weight is its number of rows to the power ``power``.
    """
    sizes = docs.groupBy(source_key().alias("_source")).count()
    if weights is None:
        weight = F.pow(F.col("count").cast("double"), F.lit(float(power)))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("=" + k, float(v))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(given[F.col("_source")], F.lit(0.0))
    everything = Window.partitionBy(F.lit(0))
    n = sizes.select("_source", weight.alias("w")).withColumn("n", F.count("*").over(everything))
    n = n.withColumn("period", F.greatest(F.lit(period), 4 * F.col("n")).cast("int"))
    # One part each, the others in proportion; what rounding leaves goes to the largest remainders.
    exact = (F.col("period") - F.col("n")) * F.col("w") / F.greatest(F.sum("w").over(everything), F.lit(1e-300))
    n = n.withColumn("exact", exact).withColumn("whole", F.floor("exact").cast("int"))
    n = n.withColumn("left", F.col("period") - F.col("n") - F.sum("whole").over(everything))
    by = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("exact") - F.col("whole")), "_source")
    n = n.withColumn("parts", (1 + F.col("whole") + (F.row_number().over(by) <= F.col("left")).cast("int")).cast("int"))
    return n.select("_source", "parts", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_source")).alias("place"), F.sum("parts").over(everything).cast("int").alias("period"))


def schedule(shares: DataFrame) -> DataFrame:
    """(_source, parts, period, turn, slot): the slot in a period of each of a source's blocks; one row per slot.

    Sources with as many parts have the same releases and deadlines, so they are one class that takes its blocks
    turn by turn and, in a turn, by place: what is due first among sources is due first among the heads of the
    classes. As classes differ in parts and all parts add up to the period, there are fewer than
    sqrt(2 * period) of them, and a slot is decided among so many heads, whatever the number of sources.
    """
    classes = shares.groupBy("period", "parts").agg(F.array_sort(F.collect_list("place")).alias("places"))
    one = classes.groupBy("period").agg(F.array_sort(F.collect_list(F.struct("parts", "places"))).alias("s"))

    def head(done: Column, slot: Column, x: Column, k: Column) -> Column:
        """Of a class of whose blocks ``done`` are placed, the next one, if it is released."""
        turn, member = F.floor(done / F.size(x["places"])), (done % F.size(x["places"])).cast("int")
        due = F.ceil((turn + 1) * F.col("period") / x["parts"])
        return F.when(F.floor(turn * F.col("period") / x["parts"]) <= slot, F.struct(due.alias("due"), F.get(x["places"], member).alias("place"), k.alias("k"), turn.cast("int").alias("turn")))

    def take(state: Column, slot: Column) -> Column:
        """Earliest deadline first among the released. The choice is bound by an array of one, so that it is made once."""
        choice = F.array_min(F.transform("s", lambda x, k: head(F.get(state["done"], k), slot, x, k)))
        step = lambda c: F.struct(
            F.transform(state["done"], lambda d, k: d + (k == c["k"]).cast("int")).alias("done"),
            F.array_append(state["out"], F.struct(c["place"].alias("place"), c["turn"].alias("turn"), slot.alias("slot"))).alias("out"),
        )
        return F.get(F.transform(F.array(choice), step), F.lit(0))

    nothing = F.expr("cast(array() as array<struct<place:int,turn:int,slot:int>>)")

    def run(state: Column, first: Column) -> Column:
        """SPAN slots; what they place is kept as one array, so that long periods don't copy long arrays."""
        begin = F.struct(state["done"].alias("done"), nothing.alias("out"))
        slots = F.sequence(first, F.least(first + SPAN, F.col("period")) - 1)
        step = lambda r: F.struct(r["done"].alias("done"), F.array_append(state["all"], r["out"]).alias("all"))
        return F.get(F.transform(F.array(F.aggregate(slots, begin, take)), step), F.lit(0))

    start = F.struct(F.transform("s", lambda x: F.lit(0)).alias("done"), F.expr("cast(array() as array<array<struct<place:int,turn:int,slot:int>>>)").alias("all"))
    spans = F.aggregate(F.sequence(F.lit(0), F.col("period") - 1, F.lit(SPAN)), start, run)["all"]
    slots = one.select(F.explode(spans).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return slots.join(shares, "place").select("_source", "parts", "period", "turn", "slot")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, power: float = POWER, seed: str = SEED) -> DataFrame:
    """Each row of ``docs`` as _doc, with _block (of its source), _row (in the block) and _slot (of the block, unique), by which to order."""
    # The row travels as one struct, so that no column of it can clash with those added here.
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")
    keyed = docs.select(row, source_key().alias("_source"), F.col("doc_id").alias("_id"), hash63(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"))
    ranked = rank_within(keyed, ["_source"], "_key", ["_id"], "_rank")
    # The sources of a corpus, and so the slots of a period, are few; still, Spark chooses the join by their size.
    turns = schedule(parts(docs, weights, period, power)).groupBy("_source").agg(
        F.first("parts").alias("_parts"), F.first("period").alias("_period"), F.array_sort(F.collect_list(F.struct("turn", "slot"))).alias("_slots")
    )
    placed = ranked.withColumn("_block", F.floor(F.col("_rank") / block_rows)).join(turns, "_source")
    slot = F.floor(F.col("_block") / F.col("_parts")) * F.col("_period") + F.get("_slots", (F.col("_block") % F.col("_parts")).cast("int"))["slot"]
    return placed.select("_doc", "_block", (F.col("_rank") % block_rows).cast("int").alias("_row"), slot.cast("long").alias("_slot"))


def interleave(docs: DataFrame, **how) -> DataFrame:
    """``docs`` in the order of the mix: later partitions hold later slots, rows are sorted inside each."""
    return mix(docs, **how).orderBy("_slot", "_row").select("_doc.*")
