"""Retrieval and answer metrics."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.text import basename, tokens
from strandline.operators.bm25 import Index, index
from strandline.operators.substrings import gram_index, matches
from strandline.plans import search
from strandline.plans.providers import Policy, Provider
from strandline.session import stored


def retrieval(ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """One row: queries, hit rates at the cuts, mean reciprocal rank; relevant(query_id, doc_id) names the queries."""
    hits = ranked.join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = relevant.select("query_id").distinct().join(hits, "query_id", "left")
    metrics = [F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in cuts]
    return rows.agg(F.count("*").alias("queries"), *metrics, F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


#: Words of a passage that lead to documents.
RAREST = 3


def holding(questions: DataFrame, docs: DataFrame, found: Index | None = None) -> DataFrame:
    """(query_id, doc_id): documents(doc_id, text) whose text holds the passage of questions(query_id, text, tokens).

    A passage may begin or end inside a word of the document; the words between are its own. So the rarest of those
    lead to documents by their postings; of passages of one or two words, the index words that hold them do. Only
    documents that have all are looked at. ``found``: an index of the documents' tokens. A passage without words is held
    nowhere.
    """
    found = found or index(docs.select("doc_id", tokens(F.col("text")).alias("tokens")))
    long, short = questions.where(F.size("tokens") > 2), questions.where(F.size("tokens").between(1, 2))
    inner = long.select("query_id", F.explode(F.array_distinct(F.expr("slice(tokens, 2, size(tokens) - 2)"))).alias("string"))
    inner = inner.join(found.terms.select(F.col("term").alias("string"), "df"), "string", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "string"))
    chosen = inner.withColumn("r", rank).where(F.col("r") <= RAREST).select("query_id", "string", F.col("string").alias("term"))
    outer = short.select("query_id", F.explode(F.array_distinct("tokens")).alias("string"))
    # One row per query, its word, and an index word that stands for it.
    led = stored(chosen.union(outer.join(matches(outer, gram_index(found.terms)), "string").select("query_id", "string", "term")), "led")
    wanted = stored(chosen.select("query_id", "string").union(outer.select("query_id", "string")).groupBy("query_id").agg(F.count("*").alias("wanted")), "wanted")
    pairs = led.join(found.postings.select("term", "doc_id"), "term").select("query_id", "string", "doc_id").distinct().groupBy("query_id", "doc_id").agg(F.count("*").alias("had"))
    pairs = stored(pairs.join(wanted, "query_id").where("had = wanted").select("query_id", "doc_id"), "pairs")
    met = pairs.join(questions.select("query_id", "text"), "query_id").join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
    return met.where(F.contains("body", F.col("text"))).select("query_id", "doc_id").distinct()


def context_precision(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, precision): the mean, over relevant hits, of the precision up to their rank; 0 without any."""
    marked = ranked.join(relevant.select("query_id", "doc_id").distinct().withColumn("good", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    so_far = F.sum("good").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    at = marked.withColumn("p", so_far / F.col("rank"))
    return at.groupBy("query_id").agg(F.coalesce(F.avg(F.when(F.col("good") == 1, F.col("p"))), F.lit(0.0)).alias("precision"))


def exact_match(a: Column, b: Column) -> Column:
    """Whether two answers are alike but for case, punctuation and spaces."""
    return F.array_join(tokens(F.regexp_replace(a, r"[\p{Punct}]", "")), " ") == F.array_join(tokens(F.regexp_replace(b, r"[\p{Punct}]", "")), " ")


def common_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, one integer's bits standing for b's words."""
    places: dict[str, int] = {}
    for k, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    rows = full
    for w in a:
        hit = rows & places.get(w, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(b) - rows.bit_count()


def _rouge_l(answer: pd.Series, truth: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(answer, truth, strict=True):
        x, y = (a or "").lower().split(), (b or "").lower().split()
        n = common_length(x, y) if x and y else 0
        out.append(2 * n / (len(x) + len(y)) if n else 0.0)
    return pd.Series(out, dtype="float64")


def rouge_l(answer: str, truth: str) -> Column:
    """The harmonic mean of what the longest common subsequence of words is of either column's text."""
    return F.pandas_udf(_rouge_l, "double")(F.col(answer), F.col(truth))


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def reciprocal_chunks(found: DataFrame) -> DataFrame:
    """The chunks of a query's evaluation row: id, section, 1 / rank, and the text's begin."""
    return found.select("query_id", F.concat(F.col("doc_id").cast("string"), F.lit("_"), "node_id").alias("chunk_id"), "doc_id", F.col("title").alias("section_path"), (1.0 / F.col("rank")).alias("score"), "rank", F.substring("content", 1, 300).alias("text"))


#: How an evaluation row names what answered, and what stands for an answer that wasn't asked for.
BACKEND, UNASKED = "doc_search_2layer", "[SEARCH ONLY]"


def rows_of(picked: DataFrame, chosen: DataFrame, questions: DataFrame, top_k: int) -> DataFrame:
    """Evaluation rows without answers: questions(query_id, text, gt_answer, relevant_docs of structs (path, reference),
    matched_docs), documents picked(query_id, doc_id) and sections chosen in order of ``place``. A matched document that no
    relevant path names is added to those."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "doc_id", "node_id"))
    chunks = reciprocal_chunks(chosen.withColumn("rank", rank))
    chunks = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "section_path", "score", "text"))).alias("retrieved_chunks"))
    counts = picked.groupBy("query_id").agg(F.count("*").alias("n_docs_selected"))
    rows = questions.join(chunks, "query_id", "left").join(counts, "query_id", "left")
    relevant = F.coalesce("relevant_docs", F.expr("cast(array() as array<struct<path:string,reference:string>>)"))
    more = F.filter(F.coalesce("matched_docs", F.array().cast("array<string>")), lambda d: ~F.exists(relevant, lambda r: F.contains(r["path"], d)))
    added = F.transform(more, lambda d: F.struct(d.alias("path"), d.alias("reference")))
    none = F.array().cast(chunks.schema["retrieved_chunks"].dataType)
    return rows.select("query_id", F.col("text").alias("query"), "gt_answer", F.lit("").alias("answer_pdf"), F.concat(relevant, added).alias("relevant_docs"), F.coalesce("retrieved_chunks", none).alias("retrieved_chunks"), F.lit(top_k).alias("top_k"), F.lit(BACKEND).alias("backend"), F.coalesce("n_docs_selected", F.lit(0)).cast("int").alias("n_docs_selected"))


def run(corpus: search.Corpus, questions: DataFrame, out: str, limits: search.Limits | None = None, generator: Provider | None = None, policy: Policy | None = None) -> DataFrame:
    """A batch evaluation, which can be stopped and run again: questions as in ``rows_of`` that ``out`` has no rows of are
    searched and, with a generator, answered. Returns all rows of ``out``; times are a question's share of its batch's.
    """
    limits, spark = limits or search.Limits(), questions.sparkSession
    path = f"{out}/rows"
    if there(spark, path):
        questions = questions.join(spark.read.parquet(path).select("query_id"), "query_id", "left_anti")
    asked = stored(questions, "questions")
    n = asked.count()
    if n:
        begun = time.time()
        texts = asked.select("query_id", "text")
        picked, _ = search.route(corpus, texts, limits)
        chosen = stored(search.sections(picked, corpus.sections, texts, limits), "chosen")
        context = stored(search.contexts(picked, chosen, limits), "contexts")
        searched = (time.time() - begun) / n
        begun = time.time()
        said = context.select("query_id", F.lit(UNASKED).alias("answer")) if generator is None else stored(search.answers(context, texts, generator, policy), "answers").select("query_id", "answer")
        answered = (time.time() - begun) / n if generator else 0.0
        rows = rows_of(picked, chosen, asked, limits.sections).join(said, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
        rows.withColumn("retrieval_time", F.lit(searched)).withColumn("generation_time", F.lit(answered)).write.mode("append").parquet(path)
    found = spark.read.parquet(path)
    metrics(found).write.mode("overwrite").json(f"{out}/metrics")
    return found


def metrics(rows: DataFrame) -> DataFrame:
    """One row over evaluation rows: hit rates and reciprocal ranks of relevant documents among the chunks, exact matches
    and ROUGE-L of answers, latencies."""
    ranked = rows.select("query_id", F.explode("retrieved_chunks").alias("c")).groupBy("query_id", F.col("c.doc_id").cast("string").alias("doc_id")).agg(F.min("c.rank").alias("rank"))
    relevant = rows.select("query_id", F.explode("relevant_docs").alias("r")).select("query_id", F.replace(basename(F.col("r.path")), F.lit(".pdf"), F.lit("")).alias("doc_id"))
    told = rows.where(F.col("answer") != UNASKED)
    same = told.agg(F.avg(exact_match(F.col("answer"), F.col("gt_answer")).cast("double")).alias("exact_match"), F.avg(rouge_l("answer", "gt_answer")).alias("rouge_l"))
    times = rows.agg(*[F.percentile(F.col("retrieval_time") + F.col("generation_time"), F.lit(p)).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95))])
    return retrieval(ranked, relevant).crossJoin(same).crossJoin(times)  # one row each


def there(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
