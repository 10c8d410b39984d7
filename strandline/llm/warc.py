"""WARC archives: writing page records with revisits, and reading them back by boundary-chain verification.

A record is written as text whose line separator is the two line breaks that end a WARC record, so that Spark's
own writer makes the archives, in parallel and with its commit protocol. Payloads of at least 100 bytes that
several pages share are stored once, with the smallest page_id; the others become revisit records.

Reading trusts no magic: for every place in a file that begins like a record a task takes down its offset and that of
its successor, which the declared length fixes. Pointer jumping from the start of the file then marks what the
chain reaches, doubling the distance in every step; record-like text inside payloads is never reached, and only
records that are reached are parsed and hashed, so that the work on a file grows with its length, whatever it holds.

Defined cases: a null html is an empty payload; null urls are left out of the record; of rows that repeat a
page_id and a payload all but revisits are responses; an empty table gives no records; a page of any size
gets a record, in a file of its own if it is large; a file whose chain ends
before the end of the file raises an error, rather than losing what follows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch

LEAST_SHARED = 100
#: More bytes than a record's headers have beside the url.
HEADERS = 2048
#: Records by size: those of up to so many bytes share a file with so many others at most. A file, which one task
#: reads, so has 64 MB at most, unless it is one record that is larger.
SIZES = ((16 << 10, 4096), (1 << 20, 64))
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\n[ \t]*content-length[ \t]*:[ \t]*([0-9]+)[ \t]*(?=\r\n)", re.I)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def lines(*parts: Column | str) -> Column:
    """Header lines; a line with a null in it is left out."""
    return F.concat(*[F.coalesce(F.concat(p, F.lit("\r\n")), F.lit("")) if isinstance(p, Column) else F.lit(p + "\r\n") for p in parts], F.lit("\r\n"))


def sized(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.octet_length(html).alias("size"), F.sha2(html.cast("binary"), 256).alias("digest"))


def shared_payloads(pages: DataFrame) -> DataFrame:
    """(digest, first): payloads that several pages have, with the least page_id. Only ids and digests are shuffled for
    this; whether the payloads then are broadcast hangs on their size as a file."""
    shared = sized(pages).where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return materialise(shared, "payloads")


def records(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """One WARC record (without its closing line breaks) per row of ``pages``."""
    found = sized(pages).join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("size")))
    head = lines(
        "WARC/1.1",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id"), F.lit(">")),
        "WARC-Date: 2024-01-01T00:00:00Z",
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: " + REVISIT)),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))),
    )
    return found.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, sizes: tuple[tuple[int, int], ...] = SIZES) -> None:
    """The archives, one folder for each class of sizes that occurs. Records of a class share files, so that no file is
    larger than the class allows, whatever a page holds; nothing is shuffled for it."""
    shared = shared_payloads(pages)
    size = F.octet_length("value")
    # The html gives a bound that needs no record: a class of large records is made from large pages alone.
    most_bytes = F.octet_length("html") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + HEADERS
    longest = pages.agg(F.max(most_bytes)).first()[0] or 0
    for k, most in enumerate([*[n for _, n in sizes], 1]):
        least = sizes[k - 1][0] if k else -1
        if k and longest <= least:
            break
        some = records(pages.where(most_bytes > least) if k else pages, shared)
        some.where((size > least) & (size <= sizes[k][0] if k < len(sizes) else F.lit(True))).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(f"{path}/size={k}")


def headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def page_of(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri)
    return int(found[1]) if found else None


def candidates(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place that begins like a record, whether real or in a payload, the begin of its body, and where its successor
    would be. Breaks and lengths are found once, so that candidates cost no more than a search among their places."""
    starts = np.array([m.start() for m in MAGIC.finditer(raw)], np.int64)
    breaks = np.array([*[m.start() for m in re.finditer(rb"(?=\r\n\r\n)", raw)], len(raw)], np.int64)
    found = [(m.start(), min(int(m[1][:4000]), 1 << 62)) for m in LENGTH.finditer(raw)]
    if not len(starts) or not found:
        return (np.zeros(0, np.int64),) * 3
    places, lengths = (np.array(x, np.int64) for x in zip(*found, strict=True))
    own = starts + 8  # the line break that ends the first line can begin the line of the length
    ends = breaks[np.searchsorted(breaks, own)]
    # The last length in a record's headers.
    at = np.searchsorted(places, ends) - 1
    known = (ends < len(raw)) & (at >= 0) & (places[np.maximum(at, 0)] >= own)
    after = ends + 4 + np.where(known, lengths[np.maximum(at, 0)], 0)
    whole = known & (after + 4 <= len(raw))
    whole[whole] = np.isin(after[whole], breaks)
    return starts[whole], ends[whole] + 4, after[whole] + 4


def parsed(raw: bytes, start: int, body: int, after: int) -> tuple:
    """The row of a record; its payload is from the inner headers' end to ``after`` less the closing line breaks."""
    own = headers(raw[start : body - 4])
    stop = after - 4
    http = raw.find(b"\r\n\r\n", body, stop)
    kind = own.get("warc-type", "")
    if kind == "revisit":
        inner = headers(raw[body : max(http, body)])
        length, digest = int(inner.get("content-length", "0") or 0), own.get("warc-payload-digest", "").removeprefix("sha256:")
    else:
        payload = memoryview(raw)[http + 4 if http >= 0 else body : stop]
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return page_of(own.get("warc-record-id", "")), length, digest, kind, page_of(own.get("warc-refers-to", ""))


def file_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that the chain of each file reaches."""
    names, kinds = [f.split()[0] for f in FOUND.split(", ")], [pa.string() if f.endswith("string") else pa.int64() for f in FOUND.split(", ")]
    for batch in batches:
        for cell in batch.column("content"):
            raw = cell.as_py()
            if not raw:
                continue
            starts, bodies, successors = candidates(raw)
            keep = np.flatnonzero(reach(starts, successors, len(raw)))
            rows = [parsed(raw, *x) for x in zip(starts[keep].tolist(), bodies[keep].tolist(), successors[keep].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def reach(starts: np.ndarray, successors: np.ndarray, size: int) -> np.ndarray:
    """Which records the chain from offset 0 reaches, by pointer jumping; an error if it doesn't end with the file."""
    order = np.argsort(starts)
    n, sorted_starts = len(starts), starts[order]
    # Node n stands for the end of the file, n + 1 for nowhere.
    at = np.searchsorted(sorted_starts, successors[order])
    hit = (at < n) & (sorted_starts[np.minimum(at, n - 1)] == successors[order])
    jump = np.concatenate((np.where(hit, at, np.where(successors[order] == size, n, n + 1)), [n, n + 1]))
    seen = np.zeros(n + 2, bool)
    seen[0 if n and sorted_starts[0] == 0 else n + 1] = True
    for _ in range(max(1, int(n + 2).bit_length())):
        seen[jump[seen]] = True
        jump = jump[jump]
    if seen[n + 1] or not seen[n]:
        raise ValueError("a chain of WARC records breaks off before its file ends")
    out = np.empty(n, bool)
    out[order] = seen[:n]
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(file_records, FOUND)  # a file is one row, bounded by the writer, and read by one task


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives (by default into the shared folder) and read them back."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write(pages, path)
    return read(spark, path)
