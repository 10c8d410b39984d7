"""Section trees as rows: tree_nodes(doc_id, node_id, parent_node_id, depth, path_ord, title, summary, start_index,
end_index, n_children). ``path_ord`` is the place of a node among its siblings on each level, zero-padded, so that
its order as a string is the order of reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import rounded, snippet, tokens, weighted_section
from strandline.operators.bm25 import Index, best, idf_of, raw_weight, scores
from strandline.session import stored


#: tree_nodes, or what gives those of doc_ids(doc_id): where nodes are parts of texts, other texts needn't be parted.
Nodes = DataFrame | Callable[[DataFrame], DataFrame]

#: Every node of the trees, from the roots down, each tree being parsed once.
DESCENT = """
WITH RECURSIVE nodes(doc_id, parent_node_id, path_ord, depth, node) AS (
  SELECT doc_id, CAST(NULL AS STRING), format_string('%06d', e.pos), 0, e.value FROM {trees}, LATERAL variant_explode(try_parse_json(structure)) e
  UNION ALL
  SELECT n.doc_id, coalesce(try_variant_get(n.node, '$.node_id', 'string'), n.parent_node_id), concat(n.path_ord, format_string('%06d', e.pos)), n.depth + 1, e.value
  FROM nodes n, LATERAL variant_explode(try_variant_get(n.node, '$.nodes', 'variant')) e)
SELECT doc_id, try_variant_get(node, '$.node_id', 'string') AS node_id, parent_node_id, depth, path_ord, try_variant_get(node, '$.title', 'string') AS title,
  try_variant_get(node, '$.summary', 'string') AS summary, try_cast(try_variant_get(node, '$.start_index', 'string') AS INT) AS start_index,
  try_cast(try_variant_get(node, '$.end_index', 'string') AS INT) AS end_index, coalesce(size(try_variant_get(node, '$.nodes', 'array<variant>')), 0) AS n_children
FROM nodes
"""
#: Neither rows nor levels of a descent are limited.
LIMITS = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")


def descended(trees: DataFrame) -> DataFrame:
    """All nodes of trees(doc_id, structure), with and without id, as a table."""
    conf = trees.sparkSession.conf
    before = [conf.get(name) for name in LIMITS]
    for name in LIMITS:
        conf.set(name, "-1")
    try:
        return stored(trees.sparkSession.sql(DESCENT, trees=trees.select("doc_id", "structure")), "nodes")
    finally:
        for name, value in zip(LIMITS, before, strict=True):
            conf.set(name, value)


def flatten(trees: DataFrame) -> DataFrame:
    """tree_nodes from trees(doc_id, structure), structure being the JSON array of root nodes.

    Nodes without an id are left out, but their children count, under the nearest ancestor with an id. Of nodes
    that share an id in a document, the last one's values stand at the first one's place. What isn't JSON, or no array, has
    no nodes. Trees are as deep as JSON can be read.
    """
    known = descended(trees).where(F.coalesce("node_id", F.lit("")) != "")
    columns = ["doc_id", "node_id", "parent_node_id", "depth", "path_ord", "title", "summary", "start_index", "end_index", "n_children"]
    # Only the ids of all nodes are dealt out; their texts are where an id is there more than once.
    again = known.groupBy("doc_id", "node_id").agg(F.count("*").alias("n")).where("n > 1")
    again = stored(again.select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_node")), "again")
    if again.isEmpty():
        return known.select(*columns)
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("node_id") == F.col("_node"))
    last = F.max_by(F.struct(*[c for c in columns if c not in ("doc_id", "node_id", "path_ord")]), "path_ord")
    one = known.join(again, on, "left_semi").groupBy("doc_id", "node_id").agg(F.min("path_ord").alias("path_ord"), last.alias("x"))
    return known.join(again, on, "left_anti").select(*columns).union(one.select("x.*", "doc_id", "node_id", "path_ord").select(*columns))


def browse(nodes: DataFrame, starts: DataFrame | None = None, depth: int = 1) -> DataFrame:
    """Nodes down to ``depth`` levels (one at least) in order of reading, with their relative depth.

    ``starts``: (doc_id, node_id) to look below, node_id null for the whole document; None: all documents.
    Unknown ids give nothing.
    """
    levels = max(depth, 1)
    if starts is None:
        return nodes.where(F.col("depth") < levels).withColumn("relative", F.col("depth"))
    tops = starts.join(nodes.select("doc_id", "node_id", F.col("path_ord").alias("top"), (F.col("depth") + 1).alias("base")), ["doc_id", "node_id"]).select("doc_id", "top", "base")
    tops = tops.union(starts.where("node_id is null").select("doc_id", F.lit(""), F.lit(0)))
    below = nodes.join(tops, "doc_id").where(F.col("path_ord").startswith(F.col("top")) & (F.col("path_ord") != F.col("top")))
    return below.withColumn("relative", F.col("depth") - F.col("base")).where(F.col("relative") < levels).drop("top", "base")


def overview(nodes: DataFrame, depth: int = 2, width: int = 60) -> DataFrame:
    """(doc_id, outline): indented titles, each with the number of its children."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.substring("title", 1, width), F.when(F.col("n_children") > 0, F.concat(F.lit(" ["), F.col("n_children").cast("string"), F.lit(" sub]"))).otherwise(""))
    rows = nodes.where(F.col("depth") < depth).select("doc_id", F.struct("path_ord", line.alias("line")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("outline"))


def nodes_in(nodes: Nodes, docs: DataFrame) -> DataFrame:
    """The nodes of docs(doc_id, ...)."""
    ids = docs.select("doc_id").distinct()
    return nodes.join(ids, "doc_id", "left_semi") if isinstance(nodes, DataFrame) else nodes(ids)


def section_key() -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.col("node_id"))


def results(found: DataFrame) -> DataFrame:
    """What is shown of ``section_search``: scores to two places."""
    return found.select("query_id", "doc_id", "node_id", "title", "start_index", "end_index", rounded(F.col("score")).alias("score"), "snippet")


def sized(picked: DataFrame, nodes: Nodes, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, key, dl, hit, x): each section of the documents picked(query_id, doc_id), as a table: its number of
    words, those of them that queries(query_id, text) ask for, and, where there are any, the other columns of the node.

    Words that no query asks for are neither rows nor written: a section is one row, whatever its length.
    """
    pairs = picked.select("query_id", "doc_id").distinct()
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    own = nodes_in(nodes, pairs)
    words = tokens(weighted_section(F.col("title"), F.col("summary")))
    rows = pairs.join(asked, "query_id", "left").join(own, "doc_id").withColumn("words", words)
    rows = rows.withColumn("hit", F.filter("words", lambda w: F.array_contains("asked", w)))
    x = F.when(F.size("hit") > 0, F.struct(*[c for c in own.columns if c != "doc_id"]))
    return stored(rows.select("query_id", "doc_id", section_key().alias("key"), F.size("words").alias("dl"), "hit", x.alias("x")), "sized")


def section_search(picked: DataFrame, nodes: Nodes, queries: DataFrame, k: int = 5, sections: DataFrame | None = None) -> DataFrame:
    """The k best sections inside the documents picked(query_id, doc_id) for queries(query_id, text).

    Statistics are those of the picked documents' sections alone, for each query; ties go to the later key. ``sections``:
    what ``sized`` gives for the same. Words that aren't asked for count only in the mean weight of all words, which is made for
    those queries alone that ask for a word that more than half of their sections have.
    """
    rows = sized(picked, nodes, queries) if sections is None else sections
    some = rows.where(F.size("hit") > 0)
    by = ("query_id",)
    stats = stored(rows.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).select("query_id", "n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl")), "stats")
    postings = some.select("query_id", F.col("key").alias("doc_id"), "dl", F.explode("hit").alias("term")).groupBy("query_id", "doc_id", "dl", "term").agg(F.count("*").alias("f"))
    postings = stored(postings, "postings")
    df = stored(postings.groupBy("query_id", "term").agg(F.count("*").alias("df")), "df")
    often = stored(df.join(stats, "query_id").where(F.col("df") > F.col("n") - F.col("df")).select("query_id").distinct(), "often")
    raw = df.join(stats, "query_id").withColumn("raw", raw_weight())
    if often.isEmpty():
        terms = raw.select("query_id", "term", "df", F.col("raw").alias("idf"))
    else:
        known = picked.join(often, "query_id", "left_semi").select("query_id", "doc_id").distinct()
        own = known.join(nodes_in(nodes, known), "doc_id")
        every = own.select("query_id", section_key().alias("key"), tokens(weighted_section(F.col("title"), F.col("summary"))).alias("words"))
        every = every.select("query_id", "key", F.size("words").alias("dl"), F.explode(F.array_distinct("words")).alias("term")).distinct().groupBy("query_id", "term").agg(F.count("*").alias("df"))
        mean = every.join(stats, "query_id").groupBy("query_id").agg(F.avg(raw_weight()).alias("mean"))
        terms = raw.join(mean, "query_id", "left").select("query_id", "term", "df", idf_of(F.col("raw"), F.col("mean")).alias("idf"))
    found = best(scores(Index(postings, terms, stats, by), queries.select("query_id", tokens(F.col("text")).alias("tokens"))), k, F.desc("doc_id"))
    found = found.select("query_id", F.col("doc_id").alias("key"), "score", "rank").join(some.select("query_id", "key", "doc_id", "x"), ["query_id", "key"]).join(queries.select("query_id", "text"), "query_id")
    found = found.select("query_id", "key", "score", "rank", "doc_id", "x.*", "text")
    return found.withColumn("snippet", snippet(F.col("text"), F.col("title"), F.col("summary"))).drop("text")
