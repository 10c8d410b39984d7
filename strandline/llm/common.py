"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline import session

#: Bytes of text that one vectorised step handles; bounds the memory of a Python worker.
CHUNK_BYTES = 500_000
#: Bytes of a batch that goes to a Python worker; the setting's name and default.
BATCH_BYTES = 4_000_000
BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Rows that are looked at at a time.
CHUNK_ROWS = 1024


def small_batches(spark: SparkSession) -> SparkSession:
    """Lets texts go to Python workers in batches of ``BATCH_BYTES``, unless the session asks for a size of its own:
    what a worker holds, and the JVM for it, then doesn't hang on how long the texts are."""
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.table(small_batches(spark), sf_dir, name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return session.shared_path(small_batches(spark), name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and survives the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def hash63(*cols: Column) -> Column:
    """A seeded hash in 0 .. 2^60-1 that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols).cast("binary")), 1, 15), 16, 10).cast("long")


HASH_BITS = 60


def rank_within(df: DataFrame, group: list[str], key: str, ties: list[str], out: str, bits: int = 10) -> DataFrame:
    """Add ``out``: the 0-based rank of each row in its group by ``key`` (a ``hash63``), then ``ties``.

    The hash range is cut into 2^bits slices. Ranks inside a slice come from a window over (group, slice),
    and what precedes a slice from a running sum over slice counts, so that a group of any size is spread
    over many tasks and no row passes through one place.
    """
    return rank_sliced(df.withColumn("_slice", F.shiftright(F.col(key), HASH_BITS - bits)), group, [key, *ties], out)


def rank_sliced(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the 0-based rank of each row in its group by ``_slice``, which is dropped, then ``order``."""
    by = [*group, "_slice"]
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by).count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = df.withColumn("_in", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    joined = ranked.join(counts, by, "left")
    return joined.withColumn(out, (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_slice", "_before", "_in")


def is_table(df: DataFrame) -> bool:
    """Whether rows come straight from files, so that their places in these are theirs whenever they are read."""
    # A relation itself, and not what is made of one: that may have another order, but shows the same metadata.
    return df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and bool(df.inputFiles())


def with_order(df: DataFrame, part_name: str = "_part", row_name: str = "_row") -> DataFrame:
    """Add ``_part`` and ``_row`` (or other names), by which the rows of ``df`` are in the order in which they come.

    Of a table that Spark wrote and that is just read they are the number of the file and the row in it, as reading
    deals files to partitions by size; of any other frame the partition and the row in it.
    """
    if is_table(df):
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long")
        nth = F.regexp_extract(F.col("_metadata.file_name"), r"-c(\d+)\.", 1).try_cast("long")
        part = F.shiftleft(F.coalesce(number, F.lit(0)), 24) + F.coalesce(nth, F.lit(0))
        return df.select("*", part.alias(part_name), F.col("_metadata.row_index").alias(row_name))
    row = F.monotonically_increasing_id()
    return df.select("*", row.alias(row_name)).withColumn(part_name, F.shiftright(row_name, 33))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A batch's texts, null as empty."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def byte_chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, their UTF-8 bytes, offsets of the texts) of about ``limit`` bytes; null is empty."""
    for first in range(0, batch.num_rows, CHUNK_ROWS):
        col = pc.fill_null(batch.column(name).slice(first, CHUNK_ROWS), "").cast(pa.large_string())
        n = len(col)
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield first + at, first + to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def pieces(data: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """The bytes of one text in runs of about ``limit``, cut before ASCII white space: a longer word stays whole."""
    at = 0
    while at < len(data):
        to, gap = min(at + limit, len(data)), np.zeros(0, np.int64)
        while to < len(data) and not len(gap):
            ahead = data[to : to + 4096]
            gap = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
            to += int(gap[0]) if len(gap) else len(ahead)
        yield data[at:to]
        at = to


def give_back() -> None:
    """Memory that was freed goes back to the system, where the system's library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose freed memory is given back at the end and about twice a second: a worker that is used again for
    other stages then doesn't keep the most that any of them held."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for out in run(batches):
            yield out
            del out
            if time.monotonic() - last > 0.5:
                give_back()
                last = time.monotonic()
        give_back()

    return wrapped


def local_only() -> None:
    """One thread for each worker's libraries: Spark sets the parallelism."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
