"""Search by explicit references in a query: what they name directly, and what is next to it in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.bm25 import best
from strandline.session import few, stored

# Fixed values: (what a match names, pattern, the types that the section is looked up under; None: an entity; "*": all of the type).
PATTERNS: tuple[tuple[str, str, tuple[str, ...] | None], ...] = (
    ("gdc", r"(?i)GDC[)\s]+(\d+)", None),
    ("gdc", r"(?i)General Design Criteri(?:on|a)\s*\(?GDC\)?\s*(\d+)", None),
    ("section", r"(?i)(?:RG|Regulatory Guide)\s+([\d]+\.[\d]+)", ("RG",)),
    ("section", r"(?i)SRP\s+([\d]+\.[\d]+(?:\.[\d]+)*)", ("SRP",)),
    ("section", r"(?i)DSRS\s+([\d]+\.[\d]+(?:\.[\d]+)*)", ("DSRS",)),
    ("all", r"(?i)(10\s*CFR)", ("REG",)),
    ("section", r"(?:Section|SECTION)\s+([\d]+\.[\d]+(?:\.[\d]+)*)", ("SRP", "DSRS")),
)


def named(queries: DataFrame, patterns=PATTERNS) -> DataFrame:
    """(query_id, what, kind, value): all references in queries(query_id, text)."""

    def tagged(what: str, kind: str | None, pattern: str) -> Column:
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(what).alias("what"), F.lit(kind).cast("string").alias("kind"), v.alias("value")))

    found = [tagged(what, kind, p) for what, p, kinds in patterns for kind in (kinds or (None,))]
    return queries.select("query_id", F.explode(F.array_distinct(F.concat(*found))).alias("x")).select("query_id", "x.*").distinct()


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 20, direct: float = 1.0, beside: float = 0.5, patterns=PATTERNS) -> DataFrame:
    """(query_id, doc_id, score, rank): doc_id is a node id. Named documents get ``direct``; documents one step from
    those, or one or two steps from a named entity, get ``beside``; steps follow out-edges."""
    refs = stored(named(queries, patterns), "refs")
    refs = few(refs)
    # Nodes and edges are dealt out, as their files may be small enough to go to every task where their rows aren't.
    docs = nodes.where("node_kind = 'document'")
    ids = docs.select("id").hint("merge")
    by_section = refs.where("what = 'section'").join(docs, (F.col("kind") == F.col("doc_type")) & (F.col("value") == F.col("section_number"))).select("query_id", "id")
    by_type = refs.where("what = 'all'").select("query_id", "kind").distinct().join(docs, F.col("kind") == F.col("doc_type")).select("query_id", "id")
    directs = by_section.union(by_type).distinct()
    entities = refs.where("what = 'gdc'").select("query_id", F.concat(F.lit("gdc:"), "value").alias("id")).join(nodes.select("id").hint("merge"), "id", "left_semi")
    out = edges.select(F.col("src").alias("id"), "dst").hint("merge")
    one = entities.join(out, "id").select("query_id", F.col("dst").alias("id")).distinct()
    two = one.join(out, "id").select("query_id", F.col("dst").alias("id"))
    near = directs.join(out, "id").select("query_id", F.col("dst").alias("id"))
    others = one.union(two).union(near).join(ids, "id", "left_semi").select("query_id", "id")
    scored = directs.withColumn("score", F.lit(direct)).union(others.withColumn("score", F.lit(beside)))
    return best(scored.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.max("score").alias("score")), k)
