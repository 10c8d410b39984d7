"""Fusing the hits of several retrievers: hits(query_id, source, doc_id, score)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.text import CONCEPT_STOP_WORDS, micro, without
from strandline.session import stored


@dataclass(frozen=True)
class Fusion:
    """Weights by source. Where ``first`` has no hit for a query, its weight goes to the others in ``shares``."""

    weights: dict[str, float] = field(default_factory=lambda: {"kg_cs": 0.35, "kg_fr": 0.30, "rc": 0.15, "rc_embed": 0.20})
    first: str = "kg_cs"
    shares: dict[str, float] = field(default_factory=lambda: {"kg_fr": 0.5, "rc_embed": 0.3, "rc": 0.2})
    boost: float = 0.15
    bonus_both: tuple[float, float] = (0.8, 0.2)
    bonus_entity: float = 0.3
    enabled: tuple[str, ...] | None = None

    def only(self, *sources: str) -> Fusion:
        """Without the other sources: an ablation."""
        return Fusion(self.weights, self.first, self.shares, self.boost, self.bonus_both, self.bonus_entity, sources)


def once(hits: DataFrame) -> DataFrame:
    """The best score of each source for a document, over all of a query's sub-queries."""
    return hits.groupBy("query_id", "source", "doc_id").agg(F.max("score").alias("score"))


def normalised(hits: DataFrame) -> DataFrame:
    """Scores from 0 to 1 in each query and source; all 0 where they are equal."""
    w = Window.partitionBy("query_id", "source")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return hits.withColumn("norm", (F.col("score") - low) / F.when(span == 0, 1.0).otherwise(span))


def weights_of(hits: DataFrame, queries: DataFrame, how: Fusion) -> DataFrame:
    """(query_id, source, weight) for every query, the first source's weight shared out where it has no hits."""
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(w).alias("w"), F.lit(how.shares.get(s, 0.0) * how.weights.get(how.first, 0.0)).alias("more")) for s, w in how.weights.items()])
    there = hits.where(F.col("source") == how.first).select("query_id").distinct().withColumn("there", F.lit(True))
    out = queries.select("query_id").distinct().join(there, "query_id", "left").select("query_id", "there", F.explode(rows).alias("x"))
    weight = F.when(F.col("there"), F.col("x.w")).when(F.col("x.source") == how.first, 0.0).otherwise(F.col("x.w") + F.col("x.more"))
    return out.select("query_id", "x.source", weight.alias("weight"))


def fused(hits: DataFrame, how: Fusion | None = None) -> DataFrame:
    """(query_id, doc_id, sources, score): weighted sums, raised for documents that several sources found."""
    how = how or Fusion()
    if how.enabled is not None:
        hits = hits.where(F.col("source").isin(*how.enabled))
    weighed = normalised(once(hits)).join(weights_of(hits, hits, how), ["query_id", "source"])
    summed = weighed.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("norm")).alias("s"), F.count_distinct("source").alias("sources"))
    return summed.select("query_id", "doc_id", "sources", (F.col("s") * F.when(F.col("sources") >= 2, 1 + how.boost * (F.col("sources") - 1)).otherwise(1.0)).alias("score"))


def concept_matches(queries: DataFrame, concepts: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, concept): concepts(concept, words) that share at least ``least`` words, stop words aside, with
    queries(query_id, words)."""
    asked = queries.select("query_id", F.explode(without(F.col("words"), CONCEPT_STOP_WORDS)).alias("w"))
    had = concepts.select("concept", F.explode(without(F.col("words"), CONCEPT_STOP_WORDS)).alias("w"))
    return asked.join(had, "w").groupBy("query_id", "concept").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id", "concept")


def bonus_parts(entities: DataFrame, chapters: DataFrame, cites: DataFrame, in_chapter: DataFrame, key: str, how: Fusion) -> DataFrame:
    """(query_id, key, part): what ``with_bonus`` gives, as a share of the query's scale; cites and in_chapter (key, concept)."""
    cited = entities.join(cites, "concept").groupBy("query_id", key).agg(F.count_distinct("concept").alias("n"))
    covered = chapters.join(in_chapter, "concept").select("query_id", key).distinct()
    has_chapter = chapters.select("query_id").distinct()
    base, step = how.bonus_both
    both = cited.join(covered, ["query_id", key], "left_semi").select("query_id", key, (base + step * F.col("n")).alias("part"))
    alone = cited.join(has_chapter, "query_id", "left_anti").select("query_id", key, (how.bonus_entity * F.col("n")).alias("part"))
    return both.union(alone)


def kinds_of(cites: DataFrame, in_chapter: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, kind) of documents that cite anything, those with the same entities and chapters being of one kind, and
    what the kinds cite and are in: (kind, concept) each."""
    cited = cites.groupBy("doc_id").agg(F.array_sort(F.collect_set("concept")).alias("cited"))
    inside = in_chapter.groupBy("doc_id").agg(F.array_sort(F.collect_set("concept")).alias("inside"))
    rows = cited.join(inside, "doc_id", "left").withColumn("kind", F.sha2(F.to_json(F.struct("cited", "inside")), 256))
    one = stored(rows.groupBy("kind").agg(F.any_value("cited").alias("cited"), F.any_value("inside").alias("inside")), "kinds")
    return stored(rows.select("doc_id", "kind"), "kind_of"), one.select("kind", F.explode("cited").alias("concept")), one.select("kind", F.explode("inside").alias("concept"))


def with_bonus(scored: DataFrame, entities: DataFrame, chapters: DataFrame, cites: DataFrame, in_chapter: DataFrame, how: Fusion | None = None, k: int | None = None) -> DataFrame:
    """Add what matched concepts give: entities and chapters are (query_id, concept), cites and in_chapter (doc_id, concept).

    Where a query matched both, only documents under both gain, by the number of entities they cite; nothing is
    given if there are none. Where it matched entities only, each matched entity gives its documents a part.
    The scale is the query's best score before, 1 if it found nothing. Documents that no source found can enter.

    With ``k``, of those that no source found only such are among the rows as can be among the query's ``k`` first by
    ``top``. Gains are then made for kinds of documents, so that a concept that many documents cite gives no row
    for each query and document: a query has at most k + the most that any query found kinds, and as many rows of each.
    """
    how = how or Fusion()
    top = scored.groupBy("query_id").agg(F.max("score").alias("top"))
    if k is None:
        parts = bonus_parts(entities, chapters, cites, in_chapter, "doc_id", how)
    else:
        kind_of, cited, inside = kinds_of(cites, in_chapter)
        kinds = bonus_parts(entities, chapters, cited, inside, "kind", how)
        found = scored.select("query_id", "doc_id")
        most = k + (found.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
        # Each kind that comes before another has a document that does, and of them only those found don't count.
        firsts = kind_of.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("doc_id"))).where(F.col("nth") <= most)
        firsts = stored(firsts, "firsts")
        gain = micro(F.col("part") * F.coalesce("top", F.lit(1.0)))
        order = Window.partitionBy("query_id").orderBy(F.desc(gain), "doc_id")
        best = kinds.join(top, "query_id", "left").join(firsts.where("nth = 1"), "kind").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        new = best.select("query_id", "kind", "part").join(firsts.select("kind", "doc_id"), "kind").select("query_id", "doc_id", "part")
        known = found.join(kind_of, "doc_id").join(kinds, ["query_id", "kind"]).select("query_id", "doc_id", "part")
        parts = known.union(new.join(found, ["query_id", "doc_id"], "left_anti"))
    gains = parts.join(top, "query_id", "left").select("query_id", "doc_id", (F.col("part") * F.coalesce("top", F.lit(1.0))).alias("gain"))
    return scored.join(gains, ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.coalesce("sources", F.lit(0)).alias("sources"), (F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"))


def top(scored: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(micro(F.col("score"))), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def provenance(hits: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """(query_id, doc_id, found_by, one column per source): who found each document, with the best score."""
    columns = [F.max(F.when(F.col("source") == s, F.col("score"))).alias(s) for s in sources]
    return hits.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("source")).alias("found_by"), *columns)


def path_edges(hits: DataFrame, ranked: DataFrame, subs: DataFrame | None = None, likely: DataFrame | None = None, cites: DataFrame | None = None) -> DataFrame:
    """(query_id, src, dst, kind): the way of each query over its retrievers and their merger to its documents, the rank
    being in ``ranked``; and, where it was decomposed, over the decomposer to sub-queries, subs(query_id, sub), and likely
    entities, likely(query_id, concept), which lead to those of its documents that cite them, cites(doc_id, concept)."""

    def edges(rows: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
        return rows.select("query_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))

    text = lambda word, c: F.concat(F.lit(word), F.col(c).cast("string"))
    query, merger, decomposer = text("query:", "query_id"), F.lit("merger"), F.lit("decomposer")
    sources = hits.select("query_id", "source").distinct()
    parts = [edges(sources, query, text("source:", "source"), "asks"), edges(sources, text("source:", "source"), merger, "gives"), edges(ranked, merger, text("doc:", "doc_id"), "ranks")]
    found = hits.select("query_id", "source", "doc_id").distinct().join(ranked.select("query_id", "doc_id"), ["query_id", "doc_id"])
    parts.append(edges(found, text("source:", "source"), text("doc:", "doc_id"), "finds"))
    if subs is not None:
        parts += [edges(subs.select("query_id").distinct(), query, decomposer, "splits"), edges(subs, decomposer, text("sub:", "sub"), "makes")]
        if likely is not None:
            known = likely.join(subs.select("query_id").distinct(), "query_id", "left_semi")
            parts.append(edges(known, decomposer, text("entity:", "concept"), "suggests"))
            if cites is not None:
                cited = known.join(cites, "concept").join(ranked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
                parts.append(edges(cited, text("entity:", "concept"), text("doc:", "doc_id"), "is cited by"))
    return reduce(DataFrame.union, parts).distinct()
