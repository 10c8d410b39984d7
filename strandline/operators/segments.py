"""A BM25 index that is kept in a folder and follows a table: segments that are added, deletions, and merges.

A segment holds what one change brought: files(file, path, length, modified, sign), documents(doc_id, file, dl),
removed(segment, doc_id, file, dl), counts(term, df), postings(term, range, doc_id, file, f, dl) by bucket of terms, and
blocks(term, range, n, most, least). Nothing in it is ever changed. Files and counts are signed, so that sums over all
segments hold for what is there now. A version lists the segments that belong together; readers keep theirs.

``file`` is a fingerprint of path, length and time of a file: a refresh reads those files whose fingerprints it doesn't
know, and removes the documents of those that are gone. doc_id is a key; of rows that share one in one table, each
counts towards the same document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import bm25
from strandline.sources.files import fingerprint, listing, plain_path

#: Documents of a range, in expectation; lengths of a range differ by a factor of 2^(1/4) at most.
RANGE_DOCS = 64
BANDS = 4
VERSION = "segment string, n long, words long, n_removed long, removed_words long"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions that were committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def _manifest(spark: SparkSession, folder: str, version: int | None = None) -> list:
    known = versions(spark, folder)
    if version is None and not known:
        return []
    return spark.read.schema(VERSION).parquet(f"{folder}/versions/{(known[-1] if version is None else version):08d}").collect()


def _all(spark: SparkSession, folder: str, segments: list[str], name: str) -> DataFrame:
    """A table of several segments, with the column ``segment``."""
    out = None
    for segment in segments:
        path = f"{folder}/segments/{segment}"
        # Documents without words leave no file of postings, of which Spark could learn their columns.
        reader = spark.read.schema(_postings(spark, path)) if name == "postings" else spark.read
        rows = reader.parquet(f"{path}/{name}").withColumn("segment_of", F.lit(segment))
        out = rows if out is None else out.unionByName(rows)
    return out


def _postings(spark: SparkSession, path: str) -> str:
    kind = spark.read.parquet(f"{path}/documents").schema["doc_id"].dataType.simpleString()
    return f"term string, range long, doc_id {kind}, file long, f long, dl int, bucket int"


def _filled(known: list) -> list:
    """Segments that brought documents, with which the segments that removed some come."""
    return [r for r in known if r.n or r.n_removed] if any(r.n for r in known) else []


def _files(spark: SparkSession, folder: str, known: list) -> DataFrame:
    """(file, path, length, modified) of the files that the index follows."""
    rows = _all(spark, folder, [r.segment for r in known], "files").groupBy("file").agg(F.sum("sign").alias("sign"), *[F.first(c).alias(c) for c in ("path", "length", "modified")])
    return rows.where("sign > 0").drop("sign")


def _removed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("segment_of").alias("segment"), "doc_id", "file", "dl")


def _live(spark: SparkSession, folder: str, known: list, name: str) -> DataFrame:
    """Documents or postings that no later segment removed."""
    rows = _all(spark, folder, [r.segment for r in known if r.n], name)
    dead = [r.segment for r in known if r.n_removed]
    if not dead:
        return rows
    gone = _all(spark, folder, dead, "removed").select(F.col("segment").alias("segment_of"), F.col("doc_id").alias("_doc"), "file")
    on = (rows.segment_of == gone.segment_of) & rows.doc_id.eqNullSafe(gone._doc) & (rows.file == gone.file)
    return rows.join(gone, on, "left_anti")


def _ranges(documents: DataFrame, segment: str) -> DataFrame:
    """(doc_id, range): documents of about one length, dealt by their ids."""
    own = documents.groupBy("doc_id").agg(F.min("dl").alias("dl")).select("doc_id", F.floor(BANDS * F.log2(F.col("dl") + 1)).alias("band"))
    # A few bands for each doubling of the lengths, whatever the number of documents.
    sizes = own.groupBy("band").agg(F.ceil(F.count("*") / RANGE_DOCS).alias("slots"))
    return own.join(F.broadcast(sizes), "band").select("doc_id", F.xxhash64(F.lit(segment), "band", F.pmod(F.xxhash64("doc_id"), F.col("slots"))).alias("range"))


def _write(spark: SparkSession, folder: str, known: list, kept: list, docs: DataFrame | None, postings: DataFrame | None, files: DataFrame, removed: DataFrame | None) -> int:
    """A new segment, and a version of ``kept`` and it; docs(doc_id, file, dl), postings(doc_id, file, dl, term, f)."""
    segment = uuid.uuid4().hex
    path = f"{folder}/segments/{segment}"
    files.write.parquet(f"{path}/files")
    empty = spark.createDataFrame([], "term string, df long")
    counts, n, words, n_removed, removed_words = empty, 0, 0, 0, 0
    if docs is not None:
        docs.write.parquet(f"{path}/documents")
        docs = spark.read.parquet(f"{path}/documents")
        # Documents without id are a range of their own. Postings that are dealt by doc_id stay where they are.
        ranges = _ranges(docs, segment).where("doc_id is not null").hint("shuffle_hash")
        placed = postings.join(ranges, "doc_id", "left").withColumn("range", F.coalesce("range", F.xxhash64(F.lit(segment)))).withColumn("bucket", bm25.bucket())
        # By ranges of documents: a term that is everywhere spans several tasks, and nothing is computed twice for a sample.
        placed.repartition("range").sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/postings")
        placed = spark.read.schema(_postings(spark, path)).parquet(f"{path}/postings")
        placed.groupBy("term", "range").agg(F.count("*").alias("n"), F.max("f").alias("most"), F.min("dl").alias("least")).write.parquet(f"{path}/blocks")
        counts = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"))
        n, words = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if removed is not None:
        removed.write.parquet(f"{path}/removed")
        gone = spark.read.parquet(f"{path}/removed")
        old = _live(spark, folder, _filled(known), "postings")
        on = (old.segment_of == gone.segment) & old.doc_id.eqNullSafe(gone.doc_id) & (old.file == gone.file)
        counts = counts.union(old.join(gone, on, "left_semi").groupBy("term").agg(-F.count("*").alias("df")))
        n_removed, removed_words = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    counts.write.parquet(f"{path}/counts")
    version = (versions(spark, folder) or [0])[-1] + 1
    rows = [*[tuple(r) for r in kept], (segment, n, words, n_removed, removed_words)]
    total = sum(r[1] - r[3] for r in rows)
    stats = spark.createDataFrame([(total, sum(r[2] - r[4] for r in rows) / max(total, 1))], "n long, avgdl double")
    stats.write.mode("overwrite").parquet(f"{folder}/stats/{version:08d}")
    df = _all(spark, folder, [r[0] for r in rows], "counts").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    bm25.weights(df, spark.read.parquet(f"{folder}/stats/{version:08d}")).write.mode("overwrite").parquet(f"{folder}/terms/{version:08d}")
    # Of two writers at a time the second one fails here.
    spark.createDataFrame(rows, VERSION).coalesce(1).write.parquet(f"{folder}/versions/{version:08d}")
    return version


def _with_documents(known: list) -> list:
    return [r for r in known if r.n]


def refresh(spark: SparkSession, folder: str, source: str, words: Column, doc_id: str = "doc_id", most_segments: int = 8) -> int:
    """Follow the Parquet files at ``source``, whose rows have ``doc_id`` and ``words``, an array made of their columns.

    Returns the version that then holds. Unknown files are read, and only those; more than ``most_segments`` segments
    are merged.
    """
    known = _manifest(spark, folder)
    now = listing(spark, source)
    lost = None
    if known:
        had = _files(spark, folder, known)
        fresh, gone = now.join(had, "file", "left_anti"), had.join(now, "file", "left_anti")
        lost = None if gone.isEmpty() else gone.withColumn("sign", F.lit(-1))
    else:
        fresh = now
    paths = [r.path for r in fresh.select("path").collect()]  # a list of files, as any reader has
    if known and not paths and lost is None:
        return versions(spark, folder)[-1]
    docs = postings = removed = None
    files = fresh.withColumn("sign", F.lit(1))
    if paths:
        meta = F.col("_metadata")
        own = fingerprint(plain_path(meta["file_path"]), meta["file_size"], meta["file_modification_time"])
        texts = spark.read.parquet(*paths).withColumn("_file", own)
        kind = [F.col(doc_id).alias("doc_id"), F.col("_file").alias("file"), words.alias("tokens")]
        docs = texts.select(*kind).select("doc_id", "file", F.size("tokens").alias("dl"))
        # Texts are dealt by doc_id, not their words, of which each takes as much room as a few rows of text.
        postings = texts.repartition(F.col(doc_id)).select(*kind).select("doc_id", "file", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "file", "dl", "term").agg(F.count("*").alias("f"))
    if lost is not None:
        files = files.unionByName(lost)
        removed = _removed(_live(spark, folder, _filled(known), "documents").join(lost.select("file"), "file", "left_semi")) if _filled(known) else None
    version = _write(spark, folder, known, known, docs, postings, files, removed)
    return merge(spark, folder) if len(known) + 1 > most_segments else version


def delete(spark: SparkSession, folder: str, doc_ids: DataFrame) -> int:
    """Remove documents, doc_ids(doc_id), as long as their files are as they are."""
    known = _manifest(spark, folder)
    found = _live(spark, folder, _filled(known), "documents").join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return _write(spark, folder, known, known, None, None, _files(spark, folder, known).withColumn("sign", F.lit(1)).where("false"), _removed(found))


def merge(spark: SparkSession, folder: str) -> int:
    """One segment of all that is there, without what was removed. Versions before keep their own."""
    known = _manifest(spark, folder)
    files = _files(spark, folder, known).withColumn("sign", F.lit(1))
    filled = _filled(known)
    if not filled:
        return _write(spark, folder, known, [], None, None, files, None)
    docs = _live(spark, folder, filled, "documents").select("doc_id", "file", "dl")
    return _write(spark, folder, known, [], docs, _live(spark, folder, filled, "postings").select("doc_id", "file", "dl", "term", "f"), files, None)


def load(spark: SparkSession, folder: str, version: int | None = None) -> bm25.Index:
    """The index as of a version, by default the last one."""
    version = versions(spark, folder)[-1] if version is None else version
    known = _manifest(spark, folder, version)
    stats, terms = spark.read.parquet(f"{folder}/stats/{version:08d}"), spark.read.parquet(f"{folder}/terms/{version:08d}")
    if not _filled(known):
        none = spark.createDataFrame([], "bucket int, term string, range long, doc_id long, f long, dl int, n long, most long, least int")
        return bm25.Index(none.select("bucket", "term", "range", "doc_id", "f", "dl"), terms, stats, (), none.select("term", "range", "n", "most", "least"))
    postings = _live(spark, folder, _filled(known), "postings").select("bucket", "term", "range", "doc_id", "f", "dl")
    blocks = _all(spark, folder, [r.segment for r in known if r.n], "blocks").select("term", "range", "n", "most", "least")
    return bm25.Index(postings, terms, stats, (), blocks)
