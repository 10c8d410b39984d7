"""Reading and writing the engine's files: metadata, graphs, section trees, question sets and their envelopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import stored

TEXT_LISTS = ("law_refs", "entity_refs", "guide_refs", "plan_refs", "special_refs", "section_refs")
METADATA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("doc_id", "filename", "doc_type", "section_number", "title", "revision", "pdf_path", "issue_date")]
    + [T.StructField("page_count", T.IntegerType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in TEXT_LISTS]
)
#: Names of the reference lists in metadata files, and here.
LIST_NAMES = dict(zip(("cfr_refs", "gdc_refs", "rg_refs", "srp_refs", "dsrs_refs", "section_refs"), TEXT_LISTS, strict=True))


def plain_path(uri: Column) -> Column:
    """A file's path as any reader names it: without its scheme and escapes."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), r"^\w+:/+", "/")


def fingerprint(path: Column, length: Column, modified: Column) -> Column:
    """What stands for one state of a file."""
    return F.xxhash64(path, length.cast("long"), modified.cast("timestamp"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, length, modified) of the files at ``path``, of which nothing is read; ``file`` is their fingerprint."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    plain = F.regexp_replace("path", r"^\w+:/+", "/")
    return rows.select(fingerprint(plain, F.col("length"), F.col("modified")).alias("file"), "path", "length", "modified")


def state_of(spark: SparkSession, *paths: str) -> tuple:
    """A value that differs when a file at one of the paths was added, removed or written again."""
    return tuple(tuple(listing(spark, p).agg(F.count("*"), F.bit_xor("file"), F.sum(F.col("file").cast("decimal(38,0)"))).first()) for p in paths)


def read_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of records, or one record a line; what a record lacks is empty. ``doc_ord``: its place by filename."""
    names = {v: k for k, v in LIST_NAMES.items()}
    schema = T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in METADATA])
    rows = spark.read.schema(schema).json(path, multiLine=not lines)
    empty = {"string": F.lit(""), "int": F.lit(0), "array<string>": F.array().cast("array<string>")}
    rows = rows.select(*[F.coalesce(names.get(f.name, f.name), empty[f.dataType.simpleString()]).alias(f.name) for f in METADATA])
    return with_order(rows, "filename", "doc_ord")


def write_metadata(rows: DataFrame, path: str) -> None:
    """Records for ``read_metadata`` with ``lines``: one JSON object a line, in as many files as there are tasks."""
    names = {v: k for k, v in LIST_NAMES.items()}
    rows.select(*[F.col(f.name).alias(names.get(f.name, f.name)) for f in METADATA if f.name in rows.columns]).write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """vectors(doc_id, v) as 32-bit floats."""
    vectors.select("doc_id", F.col("v").cast("array<float>").alias("v")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_order(rows: DataFrame, by: str, out: str) -> DataFrame:
    """0-based places in the order of a column, by counting in ranges rather than through one task. The ranges are
    written first: places come from files and rows in them, which no lost executor changes."""
    ranged = stored(rows.repartitionByRange(by).sortWithinPartitions(by), "ranges")
    placed = ranged.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int").alias("_part"), F.col("_metadata.row_index").alias("_in"))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(total)]
        total += sizes[part]
    start = F.create_map(*before)[F.col("_part")] if before else F.lit(0)
    return placed.withColumn(out, (start + F.col("_in")).cast("int")).drop("_part", "_in")


def read_trees(spark: SparkSession, folder: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """trees(doc_id, structure) from ``<doc_id>_structure.json`` files; with ``doc_ids``, those alone are opened."""
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.+)_structure\.json$", 1)
    paths = [folder]
    if doc_ids is not None:
        wanted = listing(spark, folder).select("path", name.alias("doc_id")).where("doc_id <> ''").join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        paths = [r.path for r in wanted.select("path").collect()]  # a list of files to read
        if not paths:
            return spark.createDataFrame([], "doc_id string, structure string")
    files = spark.read.text(paths, wholetext=True, pathGlobFilter="*_structure.json").select(F.input_file_name().alias("path"), "value")
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("doc_id"), F.coalesce(F.get_json_object("value", "$.structure"), F.lit("[]")).alias("structure"))


#: Parts of a store of tree nodes.
TREE_PARTS = 256


def tree_part() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(TREE_PARTS)).cast("int")


def write_tree_nodes(nodes: DataFrame, path: str) -> None:
    """A store of tree_nodes that documents can be read from without the others; a part's nodes come by document."""
    rows = nodes.withColumn("part", tree_part())
    rows.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id", "path_ord").write.mode("overwrite").partitionBy("part").parquet(path)


def read_tree_nodes(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """The nodes of a store; with ``doc_ids``, of those documents, from the parts that they are in (a list of bounded
    length)."""
    rows = spark.read.parquet(path)
    if doc_ids is None:
        return rows.drop("part")
    wanted = stored(doc_ids.select("doc_id").distinct(), "wanted")
    parts = [r.part for r in wanted.select(tree_part().alias("part")).distinct().collect()]
    return rows.where(F.col("part").isin(parts)).join(wanted, "doc_id", "left_semi").drop("part")


def read_envelope(spark: SparkSession, path: str, schema: str, start: int = 0, end: int = 0) -> DataFrame:
    """The rows in ``data``, with their place ``ord``; start to end - 1, end 0 for all."""
    found = spark.read.schema(f"data array<struct<{schema}>>").json(path, multiLine=True).select(F.posexplode("data").alias("ord", "x")).select("ord", "x.*")
    return found.where((F.col("ord") >= start) & ((F.lit(end) == 0) | (F.col("ord") < end)))


def read_questions(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Several question sets, each row with its ``source``; the order goes on from one to the next."""
    out = None
    for k, (source, path) in enumerate(paths.items()):
        rows = read_envelope(spark, path, schema).withColumn("source", F.lit(source)).withColumn("ord", F.col("ord") + F.lit(k).cast("long") * (1 << 40))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_documents(spark: SparkSession, folder: str, pages: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """files(filename, pages, error) by a reader of pages; of a file that can't be read pages are null, and the error says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows.append((name, pages(content), None))
                except Exception as error:  # one bad file is no reason to lose the others
                    rows.append((name, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["filename", "pages", "error"])

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content").mapInPandas(run, "filename string, pages array<string>, error string")


def write_envelope(rows: DataFrame, path: str, stats: DataFrame) -> None:
    """The data and its one row of statistics, as two tables of one folder."""
    rows.write.mode("overwrite").parquet(f"{path}/data")
    stats.write.mode("overwrite").json(f"{path}/metadata")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
