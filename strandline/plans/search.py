"""Two-layer search for a batch of queries: documents first, then sections inside them, then a bounded context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.text import STOP_WORDS, chapter, page_range, tokens, without
from strandline.operators import bm25, constraint, dense, extract, fusion, graph, trees
from strandline.plans.providers import Policy, Provider, ask, echo, hints, no_hints
from strandline.session import few, stored


# The lines of a trace, and how a document without a tree is described.
PICKED = "[Layer 1] Selected %d docs: %s"
BROWSED = "[Layer 2] No search results, browsing top-level."
FOUND = "[Layer 2] Search found %d sections."
READ = "[Layer 2] Retrieved %d sections total."
DONE = "[Done] Context: %d chars."
DOCUMENT = "[%s] %s: %s\n  File: %s (%dp)\n  Cross-refs: RG=[%s], GDC=[%s], SRP=[%s]"


@dataclass(frozen=True)
class Limits:
    documents: int = 10
    sections: int = 5
    chars: int = 8000
    fallback_below: int = 2
    fallback_documents: int = 3
    fallback_sections: int = 2
    title: int = 60
    rank_iterations: int = 100

    @property
    def pool(self) -> int:
        """How many hits a retriever gives to the fusion."""
        return max(5 * self.documents, 50)


@dataclass
class Corpus:
    """What a search reads. docs(doc_id, words) or a BM25 index of them, nodes and edges of the graph with ids as doc_ids there,
    node_texts (node, node_kind, text) that seeds are found by (titles and sections, where there are none), vectors(doc_id, v)
    or cells of them, sections(tree_nodes) or what gives those of doc_ids, meta for documents without sections; cites and in_chapter (doc_id, concept), entities and chapters
    (concept, words). Parts that are None are skipped."""

    docs: DataFrame | bm25.Index
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    node_texts: DataFrame | None = None
    meta: DataFrame | None = None
    vectors: DataFrame | dense.Cells | None = None
    sections: trees.Nodes | None = None
    cites: DataFrame | None = None
    in_chapter: DataFrame | None = None
    entities: DataFrame | None = None
    chapters: DataFrame | None = None
    encoder: object = None
    decomposer: Provider = field(default=no_hints)
    decomposing: Policy = field(default=Policy())


def corpus_of(docs: DataFrame, relations: DataFrame, topics: DataFrame, descriptions: DataFrame, **more: object) -> Corpus:
    """What a search reads, made from metadata: docs as ``graph.build`` and ``extract.enriched`` take them, the relations of
    types, topics(chapter, topic) and descriptions(entity, description). doc_ids are node ids; ``more``: other parts."""
    docs = stored(docs, "docs")
    nodes, edges = (stored(x, "graph") for x in graph.build(docs, relations))
    id_ = F.concat(F.lit("doc:"), "doc_id")
    found = bm25.index(extract.enriched(docs, topics, descriptions).select(id_.alias("doc_id"), tokens(F.col("text")).alias("tokens")))
    cited = docs.select(id_.alias("id"), F.explode("entity_refs").alias("entity"))
    names = docs.select(id_.alias("id"), "display_name")
    texts = extract.node_texts(nodes, cited, descriptions, names)
    words = lambda c: tokens(F.col(c)).alias("words")
    parts = {
        "node_texts": stored(texts, "node_texts"), "meta": docs.withColumn("doc_id", id_), "cites": cited.select(F.col("id").alias("doc_id"), F.col("entity").alias("concept")).distinct(),
        "in_chapter": docs.select(id_.alias("doc_id"), chapter(F.col("section_number")).alias("concept")), "entities": descriptions.select(F.col("entity").alias("concept"), words("description")), "chapters": topics.select(F.col("chapter").alias("concept"), words("topic")),
    }
    return Corpus(found, nodes, edges, **(parts | more))


def graph_hits(corpus: Corpus, queries: DataFrame, k: int, iterations: int = 100) -> DataFrame:
    """Entities next to documents, plus personalised PageRank from all seeds; queries(query_id, words)."""
    named = corpus.nodes.select(F.col("id").alias("node"), "node_kind", F.concat_ws(" ", "title", "section_number").alias("text")) if corpus.node_texts is None else corpus.node_texts
    seeds = stored(graph.overlap_seeds(named.select("node", "node_kind", tokens(F.col("text")).alias("words")), queries), "seeds")
    near = graph.around_entities(corpus.edges, few(seeds.where("node_kind = 'entity'")))
    ranks = graph.pagerank(corpus.nodes, corpus.edges, seeds, iterations=iterations).withColumnRenamed("rank", "score")
    docs = corpus.nodes.where("node_kind = 'document'").select("id")
    both = near.select("query_id", "id", "score").union(ranks.select("query_id", "id", "score")).join(docs.hint("merge"), "id", "left_semi")
    return bm25.best(both.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.sum("score").alias("score")), k)


def route(corpus: Corpus, queries: DataFrame, limits: Limits | None = None, how: fusion.Fusion | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked documents, hits) for queries(query_id, text). Hits of sub-queries count for their query.

    A decomposer that fails gives no hints, and a query without a vector has no hits by vectors: its other sources stay.
    """
    limits = limits or Limits()
    # Each retriever reads the questions, and the decomposer is asked once.
    hinted = stored(hints(ask(queries.select("query_id", "text"), "text", "reply", corpus.decomposer, policy=corpus.decomposing), "reply"), "hinted")
    asked = hinted.select(F.col("query_id").alias("own"), F.posexplode(F.concat(F.array("text"), F.col("hints.sub_queries"))).alias("sub", "text"))
    asked = asked.select("own", F.struct("own", "sub").alias("query_id"), "text", tokens(F.col("text")).alias("tokens"))
    docs = corpus.docs if isinstance(corpus.docs, bm25.Index) else corpus.docs.select("doc_id", F.col("words").alias("tokens"))
    parts = [("rc", bm25.search(docs, asked, limits.pool))]
    if corpus.nodes is not None:
        parts.append(("kg_cs", constraint.search(asked, corpus.nodes, corpus.edges, limits.pool)))
        parts.append(("kg_fr", graph_hits(corpus, asked.select("query_id", without(F.col("tokens"), STOP_WORDS).alias("words")), limits.pool, limits.rank_iterations)))
    if corpus.vectors is not None and corpus.encoder is not None:
        parts.append(("rc_embed", dense.nearest(corpus.vectors, corpus.encoder(asked), limits.pool)))
    hits = None
    for source, found in parts:
        rows = found.select(F.col("query_id.own").alias("query_id"), F.lit(source).alias("source"), "doc_id", "score")
        hits = rows if hits is None else hits.union(rows)
    if corpus.cites is not None:
        # Criteria that the decomposer holds likely make their documents constraint hits.
        likely = hinted.select("query_id", F.explode("hints.likely_criteria").alias("concept")).join(corpus.cites, "concept")
        hits = hits.union(likely.select("query_id", F.lit("kg_cs").alias("source"), "doc_id", F.lit(0.8).alias("score")))
    # Several steps read the hits, and several the ranking: each is computed once.
    hits = stored(fusion.once(hits), "hits")
    scored = fusion.fused(hits, how)
    if corpus.cites is not None:
        words = queries.select("query_id", tokens(F.col("text")).alias("words"))
        scored = fusion.with_bonus(scored, fusion.concept_matches(words, corpus.entities), fusion.concept_matches(words, corpus.chapters), corpus.cites, corpus.in_chapter, how, limits.documents)
    return stored(fusion.top(scored, limits.documents), "ranked"), hits


def sections(picked: DataFrame, nodes: trees.Nodes, queries: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(query_id, place, doc_id, node_id, title, content, pages, from_search): the sections to read, in order.

    Sections without content are left out. A query with fewer than ``fallback_below`` gets the first root sections
    of its first documents as well, unless they were found (or found without content) before.
    """
    limits = limits or Limits()
    # One row for each section of the picked documents, without its text unless it has a word of the question.
    own = trees.sized(picked, nodes, queries)
    have = stored(picked.join(own.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi"), "have")
    found = stored(trees.section_search(have, nodes, queries, limits.sections, own), "found")
    columns = ["query_id", "doc_id", "node_id", "title", F.coalesce("summary", F.lit("")).alias("content"), page_range(F.col("start_index"), F.col("end_index")).alias("pages")]
    hit = found.select(*columns, F.col("rank").cast("long").alias("place"), F.lit(True).alias("from_search"))
    full = hit.where(F.length("content") > 0)
    enough = full.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= limits.fallback_below).select("query_id")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    heads = have.withColumn("r", first).where(F.col("r") <= limits.fallback_documents).join(enough, "query_id", "left_anti")
    # Which roots are a document's first hangs on no query: each task finds them before rows are dealt out.
    root = F.row_number().over(Window.partitionBy("doc_id").orderBy("path_ord"))
    tops = trees.nodes_in(nodes, heads).where("depth = 0").withColumn("k", root).where(F.col("k") <= limits.fallback_sections)
    roots = heads.select("query_id", "doc_id", "r").join(tops, "doc_id")
    more = roots.join(hit.select("query_id", "doc_id", "node_id"), ["query_id", "doc_id", "node_id"], "left_anti")
    more = more.select(*columns, (1000 * F.col("r") + F.col("k") + 1000).cast("long").alias("place"), F.lit(False).alias("from_search")).where(F.length("content") > 0)
    return full.unionByName(more)


def contexts(picked: DataFrame, chosen: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(query_id, context): documents, then sections until the budget of characters is used up.

    The first section that goes beyond it is cut, with dots; the budget counts what was added of contents, dots
    included. If sections are left, a last line says so.
    """
    limits = limits or Limits()
    order = Window.partitionBy("query_id").orderBy("place", "doc_id", "node_id")
    before = F.coalesce(F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chosen.withColumn("before", before).withColumn("left", F.lit(limits.chars) - F.col("before"))
    shown = F.when(F.length("content") > F.col("left"), F.concat(F.expr("substring(content, 1, cast(left as int))"), F.lit("..."))).otherwise(F.col("content"))
    block = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(" "), F.col("node_id"), F.lit("] "), F.substring("title", 1, limits.title), F.lit(" (pp. "), F.col("pages"), F.lit(")\n"), shown)
    text = F.when(F.col("left") > 0, block)
    body = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("left") > 0, F.struct("place", "doc_id", "node_id", text.alias("t"))))).alias("b"), F.max((F.col("left") <= 0).cast("int")).alias("cut"))
    names = picked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))), lambda x: x["d"]), ", ").alias("names"))
    head = F.concat(F.lit("Documents: "), F.col("names"))
    end = F.when(F.col("cut") == 1, F.lit("(context limit reached)"))
    return names.join(body, "query_id", "left").select("query_id", F.concat_ws("\n\n", head, F.array_join(F.transform("b", lambda x: x["t"]), "\n\n"), end).alias("context"))


def without_trees(picked: DataFrame, meta: DataFrame, shown: int = 3) -> DataFrame:
    """(query_id, context) from metadata alone, for queries none of whose documents has a tree: meta(doc_id, doc_type,
    display_name, title, filename, page_count, guide_refs, entity_refs, plan_refs). Documents without metadata are left out."""
    refs = [F.array_join(F.slice(c, 1, shown), ", ") for c in ("guide_refs", "entity_refs", "plan_refs")]
    block = F.format_string(DOCUMENT, "doc_type", "display_name", "title", "filename", "page_count", *refs)
    rows = picked.join(meta, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))).alias("b"))
    return rows.select("query_id", F.concat(F.lit("Documents (no trees available):\n"), F.array_join(F.transform("b", lambda x: x["t"]), "\n")).alias("context"))


def trace(picked: DataFrame, chosen: DataFrame, contexts_: DataFrame) -> DataFrame:
    """(query_id, step, line): what a search did, a line for each step."""
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))), 1, 5), lambda x: x["d"])
    one = picked.groupBy("query_id").agg(F.format_string(PICKED, F.count("*"), F.concat(F.array_join(names, ", "), F.when(F.count("*") > 5, "...").otherwise(""))).alias("line"))
    sections_ = chosen.groupBy("query_id").agg(F.count_if("from_search").alias("found"), F.count("*").alias("n"))
    both = picked.select("query_id").distinct().join(sections_, "query_id", "left").select("query_id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("n", F.lit(0)).alias("n"))
    two = both.select("query_id", F.when(F.col("found") == 0, BROWSED).otherwise(F.format_string(FOUND, "found")).alias("line"))
    three = both.select("query_id", F.format_string(READ, "n").alias("line"))
    four = contexts_.select("query_id", F.format_string(DONE, F.length("context")).alias("line"))
    out = None
    for k, lines in enumerate((one, two, three, four), 1):
        rows = lines.select("query_id", F.lit(k).alias("step"), "line")
        out = rows if out is None else out.union(rows)
    return out


def search(corpus: Corpus, queries: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(query_id, context) of the whole two-layer search. Where none of a query's documents has sections, or there are
    none at all, the context tells what the documents' metadata say."""
    picked, _ = route(corpus, queries, limits)
    if corpus.sections is None:
        return without_trees(picked, corpus.meta)
    chosen = stored(sections(picked, corpus.sections, queries, limits), "sections")
    if corpus.meta is None:
        return contexts(picked, chosen, limits)
    read = stored(picked.join(trees.nodes_in(corpus.sections, picked).select("doc_id").distinct(), "doc_id", "left_semi").select("query_id").distinct(), "read")
    whole = contexts(picked.join(read, "query_id", "left_semi"), chosen, limits)
    return whole.union(without_trees(picked.join(read, "query_id", "left_anti"), corpus.meta))


def answers(searched: DataFrame, queries: DataFrame, generator: Provider = echo, policy: Policy | None = None) -> DataFrame:
    """(query_id, context, answer, status): empty contexts get no answer, and where the generator fails or is late the
    context is all there is: the answer is the policy's default, or names the error."""
    rows = searched.join(queries.select("query_id", "text"), "query_id")
    prompt = F.concat(F.lit("Question: "), "text", F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("")))
    asked = ask(rows.select("query_id", "context", prompt.alias("prompt")), "prompt", "answer", generator, policy=policy, status="status")
    return asked.select("query_id", "context", F.when(F.length(F.coalesce("context", F.lit(""))) > 0, F.col("answer")).otherwise("").alias("answer"), "status")


def merged(sections_: DataFrame, chunks: DataFrame, chars: int) -> DataFrame:
    """(query_id, doc_id, place, first, last, content): sections first, then chunks whose pages they don't cover, while
    they fit; both (query_id, doc_id, score, first, last, content)."""
    covered = chunks.alias("c").join(sections_.alias("s"), F.expr("c.query_id = s.query_id and c.doc_id = s.doc_id and c.first >= s.first and c.last <= s.last"), "left_anti")
    both = sections_.withColumn("kind", F.lit(0)).unionByName(covered.select("c.*").withColumn("kind", F.lit(1)))
    order = Window.partitionBy("query_id").orderBy("kind", F.desc("score"), "doc_id", "first")
    placed = both.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where(F.col("used") <= chars).select("query_id", "doc_id", "place", "first", "last", "content")
