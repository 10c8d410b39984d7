"""The relation graph as two tables: nodes(id, node_kind, doc_type, ...) and edges(src, dst, relation).

One edge for each (src, dst): where several are written, the last one holds.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.bm25 import told
from strandline.session import few, stored

#: Laws in a block, which every entity and every citing document meets as a whole.
LAW_BLOCK = 1_000


def last_written(edges: DataFrame, order: str = "write_ord") -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.max_by("relation", order).alias("relation"))


def with_relation(pairs: DataFrame, schema: DataFrame, default: str | None = None) -> DataFrame:
    """Add the relation that the schema(src_type, dst_type, relation) has for a pair's types; without a default,
    pairs that it lacks are dropped."""
    joined = pairs.join(few(schema), ["src_type", "dst_type"], "inner" if default is None else "left")
    return joined if default is None else joined.withColumn("relation", F.coalesce("relation", F.lit(default)))


def pair_on(left: DataFrame, right: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """(a, b): the last id of each key on either side; ids are ``id``."""
    a = left.groupBy(key).agg(F.max_by("id", order).alias("a"))
    b = right.groupBy(key).agg(F.max_by("id", order).alias("b"))
    return a.join(b.hint("merge"), key)


def unless_there(new: DataFrame, edges: DataFrame) -> DataFrame:
    return new.join(edges.hint("merge"), ["src", "dst"], "left_anti")


def build(docs: DataFrame, relations: DataFrame, law: str = "REG", guide: str = "RG", plan: str = "SRP", special: str = "DSRS", entity: str = "GDC") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from typed documents with references.

    docs(doc_ord, doc_id, doc_type, section_number, title, entity_refs, guide_refs, plan_refs, special_refs,
    law_refs). Written in this order, later edges over earlier ones: laws contain all entities; documents cite
    entities and are addressed by them; documents refer to guides, plans and special plans; documents that cite
    a law and the law; plans and special plans of one section, the last of each, unless an edge is there.
    Sections that are empty meet each other like any others.
    """
    named = docs.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "doc_ord", "doc_type", "section_number", "title", "entity_refs", "guide_refs", "plan_refs", "special_refs", "law_refs")
    entities = docs.select(F.explode("entity_refs").alias("n")).distinct()
    nodes = named.select("id", F.lit("document").alias("node_kind"), "doc_type", "section_number", "title").union(
        entities.select(F.concat(F.lit("gdc:"), "n"), F.lit("entity"), F.lit(entity), "n", F.concat(F.lit(entity + " "), "n"))
    )
    laws = named.where(F.col("doc_type") == law).select(F.col("id").alias("law"))
    ord_ = F.col("doc_ord") * 10
    # Every law holds every entity: these pairs are the result itself. Laws, the side that is few, are dealt into blocks
    # and over as many keys as spread the other side, which is joined by block and key.
    many = laws.count()
    blocks = max(1, -(-many // LAW_BLOCK))
    keyed = laws.select("law", F.pmod(F.xxhash64("law"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("key"))
    keyed = few(keyed, 16 * many)

    def with_laws(rows: DataFrame, by: str) -> DataFrame:
        dealt = rows.withColumn("key", F.pmod(F.xxhash64(by), F.lit(16)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return dealt.join(keyed, ["block", "key"]).drop("block", "key")

    contains = with_laws(entities, "n").select(F.col("law").alias("src"), F.concat(F.lit("gdc:"), "n").alias("dst"), F.lit("CONTAINS_GDC").alias("relation"), F.lit(-1).alias("write_ord"))
    cites = named.select("id", "doc_type", "doc_ord", F.explode("entity_refs").alias("n"))
    forth = cites.select(F.col("id").alias("src"), F.concat(F.lit("gdc:"), "n").alias("dst"), F.lit("CITES_GDC").alias("relation"), ord_.alias("write_ord"))
    back = with_relation(cites.select(F.concat(F.lit("gdc:"), "n").alias("src"), F.col("id").alias("dst"), F.lit(entity).alias("src_type"), F.col("doc_type").alias("dst_type"), ord_.alias("write_ord")), relations)
    edges = contains.union(forth).union(back.select("src", "dst", "relation", "write_ord"))
    for step, (column, kind) in enumerate((("guide_refs", guide), ("plan_refs", plan), ("special_refs", special)), 1):
        targets = named.where(F.col("doc_type") == kind).select(F.col("id").alias("dst"), F.col("section_number").alias("section"))
        pairs = named.select(F.col("id").alias("src"), F.col("doc_type").alias("src_type"), "doc_ord", F.explode(column).alias("section")).join(few(targets), "section").where("src <> dst")
        found = with_relation(pairs.withColumn("dst_type", F.lit(kind)), relations, "REFERENCES")
        edges = edges.union(found.select("src", "dst", "relation", (ord_ + step).alias("write_ord")))
    citing = named.where((F.size("law_refs") > 0) & (F.col("doc_type") != law)).select("id", "doc_type", "doc_ord")
    citing = with_laws(citing, "id")
    down = with_relation(citing.select(F.col("law").alias("src"), F.col("id").alias("dst"), F.lit(law).alias("src_type"), F.col("doc_type").alias("dst_type"), (ord_ + 4).alias("write_ord")), relations)
    up = citing.join(down.select(F.col("dst").alias("id"), F.col("src").alias("law")), ["id", "law"], "left_semi").select(F.col("id").alias("src"), F.col("law").alias("dst"), F.lit("CITES_REGULATION").alias("relation"), (ord_ + 4).alias("write_ord"))
    # Read twice below: the pairs by section need to know what is there.
    edges = stored(last_written(edges.union(down.select("src", "dst", "relation", "write_ord")).union(up)), "edges")
    side = named.select("id", F.col("doc_ord").alias("ord"), "section_number", "doc_type")
    twins = pair_on(side.where(F.col("doc_type") == plan), side.where(F.col("doc_type") == special), "section_number")
    both = twins.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(plan).alias("src_type"), F.lit(special).alias("dst_type")).union(
        twins.select("b", "a", F.lit(special), F.lit(plan))
    )
    return nodes, edges.union(unless_there(with_relation(both, relations).select("src", "dst", "relation"), edges))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by type and edges by relation, each with its total (name null)."""
    by_type, by_relation = nodes.rollup("doc_type").count(), edges.rollup("relation").count()
    return by_type.select(F.lit("nodes").alias("what"), F.col("doc_type").alias("name"), F.col("count").alias("n")).union(by_relation.select(F.lit("edges"), "relation", "count"))


def hops(edges: DataFrame, starts: DataFrame, most: int = 2) -> DataFrame:
    """(start, id, hop): the fewest hops from each start along out-edges; the start itself is left out."""
    seen = starts.select(F.col("start"), F.col("start").alias("id"), F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, most + 1):
        step = front.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("start", F.col("dst").alias("id")).distinct()
        front = step.join(seen, ["start", "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def paths(edges: DataFrame, starts: DataFrame, most: int = 2) -> DataFrame:
    """(start, id, hop, path): as ``hops``, with the least of the shortest paths, an array of relations and ids."""
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("hop"), F.array().cast("array<string>").alias("path"))
    front = seen
    for hop in range(1, most + 1):
        step = front.join(edges.select(F.col("src").alias("id"), "dst", "relation"), "id").select("start", F.col("dst").alias("id"), F.concat("path", F.array("relation", "dst")).alias("path"))
        front = step.groupBy("start", "id").agg(F.min("path").alias("path")).join(seen, ["start", "id"], "left_anti").select("start", "id", F.lit(hop).alias("hop"), "path")
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def around_entities(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, id, score): the summed weights of the entity seeds(query_id, node, weight) next to each node, in
    either direction, once for each entity."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("id")).union(edges.select(F.col("dst"), F.col("src"))).distinct()
    return seeds.join(both, "node").groupBy("query_id", "id").agg(F.sum("weight").alias("score"))


def out_links(edges: DataFrame) -> DataFrame:
    """(src, dst, degree): each edge once, with the number of its source's."""
    out = edges.select("src", "dst").distinct()
    return stored(out.join(out.groupBy("src").agg(F.count("*").alias("degree")).hint("merge"), "src"), "links")


def jumps(seeds: DataFrame) -> DataFrame:
    """(query_id, id, v): the weights of seeds(query_id, node, weight), of each query as shares of one."""
    total = seeds.groupBy("query_id").agg(F.sum("weight").alias("total"))
    return seeds.join(total, "query_id").groupBy("query_id", F.col("node").alias("id")).agg((F.sum("weight") / F.first("total")).alias("v"))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, least: float = 1e-12) -> DataFrame:
    """(query_id, id, rank): personalised PageRank for all queries at once; nodes(id), seeds(query_id, node, weight).

    Weights are normalised for each query; what nodes without out-edges hold goes back to the seeds. So the ranks are
    the sum of what the seeds' weights become as they are pushed along edges, alpha of them each time, normalised: each
    round pushes the residual of every query, a frontier of its own, and only nodes that it touches are rows. Residuals
    below ``least`` aren't pushed on. Rounds go on until what is left is less than nodes * tolerance, or there is none.
    Nodes that no seed reaches have no rank and no row.
    """
    n = max(nodes.select("id").distinct().count(), 1)
    rounds = iterations if tolerance <= 0 else min(iterations, max(1, math.ceil(math.log(min(n * tolerance, 0.5)) / math.log(alpha))))
    links = out_links(edges)
    front = stored(jumps(seeds), "front")
    fronts = [front]
    for _ in range(rounds):
        pushed = front.where(F.col("v") >= least)
        many = pushed.count()
        if not many:
            break
        flow = few(pushed, many).join(links, F.col("id") == F.col("src"))
        front = stored(flow.groupBy("query_id", F.col("dst").alias("id")).agg(F.sum(alpha * F.col("v") / F.col("degree")).alias("v")), "front")
        fronts.append(front)
    summed = stored(reduce(DataFrame.union, fronts).groupBy("query_id", "id").agg(F.sum("v").alias("v")), "summed")
    total = summed.groupBy("query_id").agg(F.sum("v").alias("total"))
    return summed.join(total, "query_id").select("query_id", "id", (F.col("v") / F.col("total")).alias("rank"))


def walked(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, iterations: int, alpha: float = 0.85) -> DataFrame:
    """(id, rank) after so many iterations of one walk from the same rank everywhere; seeds(node, weight). A table per
    iteration; nodes without rank aren't carried along, but are in the result."""
    ids = nodes.select("id").distinct()
    n = max(ids.count(), 1)
    jump = stored(jumps(seeds.withColumn("query_id", F.lit(0))).select("id", F.col("v").alias("p")), "jump")
    links = out_links(edges)
    dead = stored(ids.join(links.select("src").distinct(), F.col("id") == F.col("src"), "left_anti").select("id"), "dead")
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        flow = ranks.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (alpha * F.col("rank") / F.col("degree")).alias("part"))
        lost = ranks.join(dead, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        back = jump.crossJoin(F.broadcast(lost)).select("id", ((alpha * F.col("lost") + (1 - alpha)) * F.col("p")).alias("part"))
        ranks = stored(flow.union(back).groupBy("id").agg(F.sum("part").alias("rank")).where("rank > 0"), "ranks")
    return ids.join(ranks, "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def overlap_seeds(node_words: DataFrame, queries: DataFrame, bonus: float = 0.1, least: float = 0.15, documents: int = 20) -> DataFrame:
    """(query_id, node, node_kind, weight): nodes by the share of a query's words that they have, plus a bonus for
    each; above ``least``; all entities, but the best ``documents`` documents. node_words(node, node_kind, words)."""
    return overlap_of(node_words.select("node", "node_kind", F.explode(F.array_distinct("words")).alias("w")), queries, bonus, least, documents)


def overlap_of(had: DataFrame, queries: DataFrame, bonus: float = 0.1, least: float = 0.15, documents: int = 20) -> DataFrame:
    """``overlap_seeds`` from the distinct words of the nodes as rows, had(node, node_kind, w)."""
    # Words are dealt by their nodes and then meet the queries: no pair of a query and a node is shuffled.
    asked, words = told(queries.select("query_id", F.size("words").alias("n"), F.explode("words").alias("term")))
    met = had.withColumnRenamed("w", "term").join(words, "term", "left_semi").repartition("node")
    shared = met.join(asked, "term").groupBy("query_id", "node", "node_kind", "n").agg(F.count("*").alias("o"))
    weighed = shared.withColumn("weight", F.col("o") / F.col("n") + bonus * F.col("o")).where(F.col("weight") > least).select("query_id", "node", "node_kind", "weight")
    # The two apart, as Spark then keeps only the first documents of each task.
    every = F.coalesce(F.col("node_kind") != "document", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("query_id", "node_kind").orderBy(F.desc(F.floor(F.col("weight") * 1e6 + 0.5)), "node"))
    return weighed.where(~every).withColumn("r", rank).where(F.col("r") <= documents).drop("r").union(weighed.where(every))
