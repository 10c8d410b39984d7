"""The index that follows a table, and searches that read the ranges of documents that can matter."""

import random

from pyspark.sql import functions as F

from strandline import queries
from strandline.functions import text as X
from strandline.operators import bm25, segments

def words():
    return X.tokens(F.col("text"))


def write(spark, path, rows, mode="overwrite", parts=1):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.mode(mode).parquet(path)


def answers(spark, found, asked, k=5):
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string").select("query_id", X.tokens(F.col("text")).alias("tokens"))
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in bm25.search(found, q, k).collect())


def plain(spark, rows, asked, k=5):
    """The same by an index made at once, all of whose postings are read."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", words().alias("tokens"))
    return answers(spark, bm25.index(docs), asked, k)


def made(seed, n, start=0):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rare = [f"rare{k}" for k in range(60)]
    return [(start + k, " ".join(r.choices(words[: r.choice((20, 300))], k=r.randrange(1, 120)) + (r.choices(rare, k=2) if k % 4 == 0 else []))) for k in range(n)]


ASKED = ["w1 w2 rare3", "rare7 rare8 w1 w1", "nothing here", "w250 w251 rare1 rare2 rare3", "w5"]


def test_index_follows_its_table(spark, tmp_path):
    table, folder = str(tmp_path / "docs"), str(tmp_path / "index")
    first, more = made(1, 60), made(2, 30, 1000)
    write(spark, table, first)
    one = segments.refresh(spark, folder, table, words())
    assert segments.refresh(spark, folder, table, words()) == one
    assert answers(spark, segments.load(spark, folder), ASKED) == plain(spark, first, ASKED)
    # More files: only they are read; a reader of the version before sees what it saw.
    write(spark, table, more, "append", 2)
    two = segments.refresh(spark, folder, table, words())
    assert two > one and answers(spark, segments.load(spark, folder), ASKED) == plain(spark, first + more, ASKED)
    assert answers(spark, segments.load(spark, folder, one), ASKED) == plain(spark, first, ASKED)
    new = segments._manifest(spark, folder)[-1]
    assert (new.n, new.n_removed) == (30, 0)
    # Single documents, then a merge, then another table in the place of the first.
    gone = {r[0] for r in (first + more)[::7]}
    segments.delete(spark, folder, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in first + more if r[0] not in gone]
    assert answers(spark, segments.load(spark, folder), ASKED) == plain(spark, left, ASKED)
    assert segments.refresh(spark, folder, table, words()) == segments.versions(spark, folder)[-1]
    segments.merge(spark, folder)
    assert len(segments._manifest(spark, folder)) == 1 and answers(spark, segments.load(spark, folder), ASKED) == plain(spark, left, ASKED)
    write(spark, table, more[:10])
    segments.refresh(spark, folder, table, words())
    assert answers(spark, segments.load(spark, folder), ASKED) == plain(spark, more[:10], ASKED)
    df = {r.term: r.df for r in segments.load(spark, folder).terms.collect()}
    assert df == {r.term: r.df for r in bm25.index(spark.createDataFrame(more[:10], "doc_id long, text string").select("doc_id", words().alias("tokens"))).terms.collect()}


def test_many_segments_are_merged(spark, tmp_path):
    table, folder, rows = str(tmp_path / "docs"), str(tmp_path / "index"), []
    for k in range(3):
        rows += made(k, 20, 100 * k)
        write(spark, table, rows[-20:], "append")
        segments.refresh(spark, folder, table, words(), most_segments=2)
    assert len(segments._manifest(spark, folder)) == 1
    assert answers(spark, segments.load(spark, folder), ASKED) == plain(spark, rows, ASKED)


def test_tables_without_words(spark, tmp_path):
    """An empty table, then documents without words, then one with some."""
    table, folder = str(tmp_path / "docs"), str(tmp_path / "index")
    for rows in ([], [(1, ""), (2, None)], [(1, ""), (3, "w5 w5")]):
        write(spark, table, rows)
        segments.refresh(spark, folder, table, words())
        assert [(q, d) for q, _, d, _ in answers(spark, segments.load(spark, folder), ASKED)] == [(q, d) for q, _, d, _ in plain(spark, rows, ASKED)]


def test_ranges_that_cannot_matter_are_not_read(spark, tmp_path):
    """The same results as from all postings, from a part of them; a word that is everywhere is in many ranges."""
    table, folder = str(tmp_path / "docs"), str(tmp_path / "index")
    rows = made(9, 2000)
    write(spark, table, rows, parts=3)
    segments.refresh(spark, folder, table, words())
    found = segments.load(spark, folder)
    q = spark.createDataFrame([(0, "w1 rare3 rare5"), (1, "w2 w3 rare7 rare8"), (2, "w4")], "query_id int, text string").select("query_id", X.tokens(F.col("text")).alias("tokens"))
    scored, read = bm25.bounded(found, q, 10)
    got = [(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in bm25.best(scored, 10).collect()]
    wanted = [(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in bm25.best(bm25.scores(found, q), 10).collect()]
    assert sorted(got) == sorted(wanted)
    blocks = bm25.weighed(found, q).join(found.blocks, "term")
    every = {r.query_id: r.n for r in blocks.groupBy("query_id").agg(F.sum("n").alias("n")).collect()}
    met = {r.query_id: r.n for r in blocks.join(read, ["query_id", "range"], "left_semi").groupBy("query_id").agg(F.sum("n").alias("n")).collect()}
    print("postings", every, "read", met)
    assert all(met[k] < every[k] for k in every) and sum(met.values()) < 0.7 * sum(every.values())
    assert found.blocks.where("term = 'w1'").count() > 20


def test_queries_see_a_table_that_changed(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "needle in a stack")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for place in (3, 7):
        write(spark, f"{d}/documents.parquet", [(k, "needle" if k == place else f"other words {k}") for k in range(10)])
        assert [r.doc_id for r in queries.bm25_topk(spark, d).collect()] == [place]
        assert [r.doc_id for r in queries._picked(spark, d).collect()] == [place]
