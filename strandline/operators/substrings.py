"""Substrings of words by an inverted index of their n-grams.

What holds no white space occurs inside single words, so that an index of the vocabulary is enough: of each sought
string the rarest n-grams are intersected, the words found are verified, and their postings tell the texts. No
text is read again. A few strings that are sought once are cheaper counted in the texts (``counted_scores``) than by an index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.text import occurrences, tokens
from strandline.operators.bm25 import Index
from strandline.session import stored

#: Characters of the longest n-gram; n-grams of a string that are intersected.
LONGEST = 3
RAREST = 3
#: Different strings, and rows of queries with them, up to which texts are read instead of an index.
FEW_STRINGS, FEW_ROWS = 100, 1000


def grams(s: Column, n: Column) -> Column:
    """The different n-grams of a string of at least n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n)))


def gram_index(vocabulary: DataFrame) -> DataFrame:
    """(gram, term) of vocabulary(term): n-grams of one to three characters, a table of its own."""
    terms = vocabulary.select("term").distinct().where(F.length("term") > 0)
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(LONGEST))))
    return stored(terms.select("term", sizes.alias("n")).select(F.explode(grams(F.col("term"), F.col("n"))).alias("gram"), "term"), "grams")


def matches(strings: DataFrame, index: DataFrame) -> DataFrame:
    """(string, term): the words of the index that hold a string; strings(string), none of them with white space."""
    own = strings.select("string").distinct().where(F.length("string") > 0)
    size = F.least(F.length("string"), F.lit(LONGEST))
    asked = stored(own.select("string", F.explode(grams(F.col("string"), size)).alias("gram")), "asked")
    counts = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A string with an n-gram that no word has is in no word.
    counted = asked.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("string").orderBy("n", "gram"))
    chosen = counted.withColumn("r", rank).where(F.col("r") <= RAREST).select("string", "gram", F.max("r").over(Window.partitionBy("string")).alias("wanted"))
    both = chosen.join(index, "gram").groupBy("string", "term", "wanted").agg(F.count("*").alias("had"))
    return both.where((F.col("had") == F.col("wanted")) & F.contains("term", F.col("string"))).select("string", "term")


def substring_scores(found: Index, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): how often each word of queries(query_id, tokens) occurs in a text of the index, words or
    not; ``index`` has the n-grams of its terms."""
    asked = queries.select("query_id", F.explode("tokens").alias("string")).groupBy("query_id", "string").agg(F.count("*").alias("times"))
    held = matches(asked, gram_index(found.terms) if index is None else index).withColumn("in_term", occurrences(F.col("term"), F.col("string")))
    counts = held.join(found.postings, "term").groupBy("string", "doc_id").agg(F.sum(F.col("f") * F.col("in_term")).alias("n"))
    return counts.join(asked, "string").groupBy("query_id", "doc_id").agg(F.sum(F.col("n") * F.col("times")).cast("double").alias("score"))


def counted_scores(docs: DataFrame, queries: DataFrame) -> DataFrame | None:
    """What ``substring_scores`` gives for docs(doc_id, text), by counting in the texts: each is read once, and a document is one
    row with its counts. None if that is asked for more than a few strings, which an index is for."""
    asked = queries.select("query_id", F.explode("tokens").alias("string")).groupBy("query_id", "string").agg(F.count("*").alias("times"))
    asked = stored(asked.where((F.length("string") > 0) & ~F.regexp_like("string", F.lit(r"\s"))), "asked")
    strings = [r.string for r in asked.select("string").distinct().orderBy("string").limit(FEW_STRINGS + 1).collect()]
    rows = asked.limit(FEW_ROWS + 1).collect()
    if len(strings) > FEW_STRINGS or len(rows) > FEW_ROWS:
        return None
    low, place = F.lower("text"), {x: j for j, x in enumerate(strings)}
    counts = docs.select("doc_id", *[occurrences(low, F.lit(x)).alias(f"n{j}") for j, x in enumerate(strings)])
    counts = counts.groupBy("doc_id").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(len(strings))])
    own: dict = {}
    for r in rows:
        own[r.query_id] = own.get(r.query_id, F.lit(0).cast("long")) + F.coalesce(f"n{place[r.string]}", F.lit(0)) * r.times
    if not own:
        return docs.crossJoin(asked).where("false").select("query_id", "doc_id", F.lit(0.0).alias("score"))
    points = F.array(*[F.struct(F.lit(q).cast(asked.schema["query_id"].dataType).alias("query_id"), n.cast("double").alias("score")) for q, n in own.items()])
    return counts.select("doc_id", F.explode(points).alias("x")).select("x.query_id", "doc_id", "x.score").where("score > 0")


@dataclass(frozen=True)
class Words:
    """words(key, term) of a table's columns and the n-grams of the terms, for any number of keyword searches."""

    words: DataFrame
    grams: DataFrame
    key: str
    columns: tuple[str, ...]


def words_of(rows: DataFrame, key: str, *columns: str) -> Words:
    """The index of the columns' words; ``key`` tells rows apart."""
    texts = F.lower(F.concat_ws("\n", *columns))
    words = stored(rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(tokens(texts))).alias("term")), "words")
    return Words(words, gram_index(words), key, columns)


def keyword(rows: DataFrame, found: Words, word: str) -> DataFrame:
    """The rows one of whose indexed columns holds ``word``, whatever the case.

    White space parts a keyword: its longest part leads to rows, whose columns are then looked at. A keyword of white
    space alone leads nowhere, and all rows are looked at.
    """
    low = word.lower()
    parts = low.split()
    if parts:
        longest = rows.sparkSession.createDataFrame([(max(parts, key=len),)], "string string")
        keys = matches(longest, found.grams).join(found.words, "term").select(F.col("key").alias(found.key)).distinct()
        rows = rows.join(keys, found.key, "left_semi")
    held = F.lit(False)
    for c in found.columns:
        held |= F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    return rows.where(held)
