"""Indexes of vectors, substrings and names against all pairs; ranks by pushing; trees of any depth."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import bm25, dense, fuzzy, graph, substrings, trees
from strandline.plans import search


def made_vectors(n, width, clusters, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, width))
    v = centres[r.integers(0, clusters, n)] + 0.35 * r.normal(size=(n, width))
    v[: n // 4] = v[0]  # a quarter are one vector
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def plain_nearest(v, q, k):
    out = {}
    for i, x in enumerate(q):
        s = v @ x
        order = np.lexsort((np.arange(len(v)), -np.floor(s * 1e6 + 0.5)))
        out[i] = [int(j) for j in order[:k] if s[j] > 0]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    v = made_vectors(1500, 24, 12, 1)
    q = np.concatenate([v[[0, 400, 900, 1499]], made_vectors(6, 24, 3, 2)])
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 24), (9004, [None] * 24)], "doc_id long, v array<double>").repartition(5)
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "query_id int, q array<double>")
    return v, q, rows, asked


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.doc_id)
    return out


def test_cells_give_the_nearest(spark, vectors, monkeypatch):
    v, q, rows, asked = vectors
    monkeypatch.setattr(dense, "PART", 64)
    monkeypatch.setattr(dense, "QUERY_PART", 2)
    cells = dense.index(rows)
    assert cells.cells.agg(F.sum("n")).first()[0] == len(v) and cells.cells.agg(F.max("parts")).first()[0] > 4
    assert found_by(dense.nearest(cells, asked, 7, probes=2)) == plain_nearest(v, q, 7)
    within = {(r.query_id, r.doc_id) for r in dense.within(cells, asked, 0.7).select("query_id", "doc_id").collect()}
    assert within == {(i, j) for i, x in enumerate(q) for j in np.flatnonzero(v @ x >= 0.7).tolist()}
    assert dense.nearest(rows.limit(0), asked, 3).count() == 0


def test_cells_leave_out_what_cannot_be_near(vectors):
    v, q, rows, asked = vectors
    cells = dense.index(rows)
    asked = asked.where("query_id < 4").withColumn("least", F.lit(0.8))
    late = dense.met(cells, asked, 1, True).count()
    assert late < 4 * (cells.cells.count() - 1) / 2


def test_few_cells_find_most(spark, vectors):
    """Recall of eight cells out of some forty, against all vectors."""
    v, q, rows, asked = vectors
    got, wanted = found_by(dense.nearest(rows, asked, 10, exact=False)), plain_nearest(v, q, 10)
    hit = sum(len(set(got.get(i, [])) & set(w)) for i, w in wanted.items())
    assert hit >= 0.9 * sum(map(len, wanted.values()))


def test_few_cells_of_given_vectors(spark):
    """Recall on the given vectors, which hardly form clusters: three quarters of the cells."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    asked = rows.where("doc_id % 40 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))
    cells = dense.index(rows)
    exact, some = found_by(dense.nearest(cells, asked, 10)), found_by(dense.nearest(cells, asked, 10, exact=False, probes=3 * cells.cells.count() // 4))
    hit, every = sum(len(set(some[i]) & set(w)) for i, w in exact.items()), sum(map(len, exact.values()))
    print("recall", hit / every)
    assert hit >= 0.9 * every


TEXTS = ["Reading the nothing of things", "aaaa aab banana", "", None, "İstanbul straße STRASSE", "x", "the or", "or-or orb worry", "\u00a0odd\u00a0space ab"]
ASKED = ["th", "ana", "aa", "ING", "or", "x", "zz", "strasse", "e", "reading", "d\u00a0s"]


def test_substrings_by_hand(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    found = bm25.index(docs.select("doc_id", X.tokens(F.col("text")).alias("tokens")))
    asked = spark.createDataFrame([(k, [w.lower(), "the", w.lower()]) for k, w in enumerate(ASKED)], "query_id int, tokens array<string>")
    got = {(r.query_id, r.doc_id): r.score for r in substrings.substring_scores(found, asked).collect()}
    low = {r.doc_id: r.t or "" for r in docs.select("doc_id", F.lower("text").alias("t")).collect()}
    wanted = {(q, d): 2 * t.count(w.lower()) + t.count("the") for q, w in enumerate(ASKED) for d, t in low.items()}
    assert got == {k: v for k, v in wanted.items() if v}


def test_keywords_by_hand(spark):
    rows = spark.createDataFrame([(k, t, u) for k, (t, u) in enumerate(zip(TEXTS, TEXTS[::-1], strict=True))], "id int, a string, b string")
    found = substrings.words_of(rows, "id", "a", "b")
    for word in ("TH", "the n", "ana", "x", "nowhere", " ", "or orb"):
        wanted = {r.id for r in rows.collect() if any(word.lower() in (t or "").lower() for t in (r.a, r.b))}
        assert {r.id for r in substrings.keyword(rows, found, word).collect()} == wanted, word


def test_short_lists_lead_to_words(spark):
    """Candidates of a string are words that have its rarest n-grams, not all words."""
    r = random.Random(1)
    words = sorted({"".join(r.choices("abcdefgh", k=r.randrange(1, 9))) for _ in range(2000)})
    index = substrings.gram_index(spark.createDataFrame([(w,) for w in words], "term string"))
    asked = [r.choice(words)[:4] for _ in range(20)] + ["a", "hg"]
    got = {(x.string, x.term) for x in substrings.matches(spark.createDataFrame([(a,) for a in asked], "string string"), index).collect()}
    assert got == {(a, w) for a in asked for w in words if a in w}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.8, 1.0])
def test_names_alike_by_hand(spark, least):
    r = random.Random(int(10 * least))
    names = sorted({"".join(r.choices("abé ", k=r.randrange(1, 12))) for _ in range(120)} | {"a", "ab", "aaaaaaaaaa", "aaaaaaaaab"})
    mentions = []
    for name in names[:80]:
        t = list(name)
        for _ in range(r.randrange(0, 3)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randrange(2)] = r.choice(["", "a", "x"])
        mentions.append("".join(t))
    a, b = (spark.createDataFrame([(x,) for x in rows], f"{c} string") for rows, c in (([*mentions, "", None], "mention"), ([*names, "", None], "name")))
    like = lambda x, y: 1 - plain_distance(x, y) / max(len(x), len(y))
    wanted = {(x, y): like(x, y) for x in set(mentions) for y in names if x and like(x, y) >= least - 1e-12}
    got = {(x.mention, x.name): x.score for x in fuzzy.link(a, b, least).collect()}
    assert set(got) == set(wanted) and all(abs(got[k] - v) < 1e-12 for k, v in wanted.items())


def test_few_names_are_compared(spark):
    r = random.Random(7)
    parts = ["ra", "ben", "to", "kil", "sun", "mar", "del", "os", "vi", "tan", "por", "e", "lum", "ga", "nis"]
    words = sorted({"".join(r.choices(parts, k=r.randrange(3, 6))) for _ in range(800)})
    names = spark.createDataFrame([(w,) for w in words], "name string")
    mentions = names.select(F.concat("name", F.lit("s")).alias("mention"))
    banded = sum(abs(len(a) + 1 - len(b)) <= 0.2 * max(len(a) + 1, len(b)) for a in words for b in words)
    pairs = fuzzy.candidates(mentions, names, 0.8).count()
    print("names", len(words), "pairs of near lengths", banded, "candidates", pairs)
    assert len(words) <= pairs < banded / 4
    with pytest.raises(ValueError):
        fuzzy.candidates(mentions, names, 0.5)


def test_frontiers_stay_near_their_seeds(spark):
    """In a long chain a query's rows are the nodes after its seed, and what is too little isn't pushed on."""
    nodes = spark.range(400).select(F.col("id").cast("string").alias("id"))
    edges = spark.range(399).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    seeds = spark.createDataFrame([(1, "10", 1.0), (2, "397", 2.0)], "query_id int, node string, weight double")
    got = {}
    for r in graph.pagerank(nodes, edges, seeds, iterations=24, tolerance=0.0).collect():
        got.setdefault(r.query_id, {})[int(r.id)] = r.rank
    assert set(got[1]) == set(range(10, 35)) and set(got[2]) == {397, 398, 399}
    weights = [0.85**k for k in range(25)]
    assert all(abs(got[1][10 + k] - w / sum(weights)) < 1e-12 for k, w in enumerate(weights))
    few = graph.pagerank(nodes, edges, seeds, iterations=24, tolerance=0.0, least=0.5).where("query_id = 1").count()
    assert few == 6


def test_trees_of_any_depth(spark):
    node = None
    for k in reversed(range(45)):
        node = {"node_id": f"n{k}" if k % 9 else "", "title": f"t{k}", "nodes": [node] if node else []}
    rows = [("deep", json.dumps([node])), ("bad", "no json"), ("none", None), ("map", '{"node_id": "x"}'), ("odd", '[1, null, {"node_id": 7, "start_index": "3", "nodes": "no list"}]')]
    got = trees.flatten(spark.createDataFrame(rows, "doc_id string, structure string")).collect()
    deep = {r.node_id: r for r in got if r.doc_id == "deep"}
    assert len(deep) == 40 and deep["n44"].depth == 44 and deep["n44"].parent_node_id == "n43" and deep["n44"].path_ord == "000000" * 45
    assert [(r.doc_id, r.node_id, r.start_index, r.n_children) for r in got if r.doc_id != "deep" and r.doc_id != "map"] == [("odd", "7", 3, 0)]


def test_sections_without_asked_words_leave_no_rows(spark):
    """Words that no query asks for are not written, and roots are found without them."""
    nodes = spark.createDataFrame(
        [(d, f"L{k}", None, 0, f"{k:06d}", f"title {d}", " ".join(f"word{d}x{k}x{i}" for i in range(50)), k, k, 0) for d in range(3) for k in range(4)],
        "doc_id long, node_id string, parent_node_id string, depth int, path_ord string, title string, summary string, start_index int, end_index int, n_children int",
    )
    asked = spark.createDataFrame([(0, "nowhere"), (1, "word1x2x7 of all"), (2, "title")], "query_id long, text string")
    picked = asked.select("query_id", F.col("query_id").alias("doc_id"), F.lit(1).alias("rank"))
    rows = trees.sized(picked, nodes, asked).collect()
    assert len(rows) == 12 and {(r.query_id, tuple(r.hit)) for r in rows if r.hit} == {(1, ("word1x2x7",)), (2, ("title",) * 3)}
    assert all((r.x is None) == (not r.hit) and r.dl == 56 for r in rows)
    got = sorted((r.query_id, r.node_id, r.from_search) for r in search.sections(picked, nodes, asked).collect())
    assert [g for g in got if g[0] == 0] == [(0, "L0", False), (0, "L1", False)] and [g for g in got if g[0] == 1] == [(1, "L0", False), (1, "L1", False), (1, "L2", True)]
    # All sections have the word: its weight is a quarter of the mean over all words, asked for or not.
    found = trees.section_search(picked, nodes, asked).where("query_id = 2").collect()
    mean = (200 * (math.log(3.5) - math.log(1.5)) + (math.log(0.5) - math.log(4.5)) + (math.log(0.5) - math.log(4.5))) / 202
    assert len(found) == 4 and all(abs(r.score - 0.25 * mean * 3 * 2.5 / (3 + 1.5)) < 1e-9 for r in found)


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    """Postings are dealt by their documents, and each task keeps its best: only those are dealt by queries."""
    r = random.Random(3)
    docs = [(k, [f"w{r.randrange(30)}" for _ in range(r.randrange(12))]) for k in range(200)]
    asked = spark.createDataFrame([(q, [f"w{r.randrange(40)}" for _ in range(5)]) for q in range(20)], "query_id long, tokens array<string>")
    found = bm25.index(spark.createDataFrame(docs, "doc_id long, tokens array<string>"))
    plan = lambda df: re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning(query_id, doc_id" not in plan(bm25.search(found, asked, 3))
    assert sorted(bm25.search(found, asked, 3).select("query_id", "rank", "doc_id").collect()) == sorted(bm25.best(bm25.scores(found, asked), 3).select("query_id", "rank", "doc_id").collect())
    had = [(str(k), ("document", "entity", "law")[k % 3], w) for k, words in docs for w in set(words)]
    wanted = asked.select("query_id", F.array_distinct("tokens").alias("words"))
    got = graph.overlap_of(spark.createDataFrame(had, "node string, node_kind string, w string"), wanted, documents=2)
    assert "hashpartitioning(query_id, node," not in plan(got) and "WindowGroupLimit" in plan(got)
    kinds = {str(k): ("document", "entity", "law")[k % 3] for k, _ in docs}
    every = []
    for q in wanted.collect():
        points = [(q.query_id, str(k), o / len(q.words) + 0.1 * o) for k, words in docs if (o := len(set(words) & set(q.words)))]
        points = [p for p in points if p[2] > 0.15]
        first = sorted((p for p in points if kinds[p[1]] == "document"), key=lambda p: (-math.floor(p[2] * 1e6 + 0.5), p[1]))[:2]
        every += first + [p for p in points if kinds[p[1]] != "document"]
    assert sorted((x.query_id, x.node, round(x.weight, 9)) for x in got.collect()) == sorted((q, n, round(w, 9)) for q, n, w in every)


def test_texts_are_searched_without_an_index(spark, monkeypatch):
    """A batch gives what an index would, with words in most texts, rows of one doc_id, and texts that are empty or null."""
    r = random.Random(5)
    docs = [(k, ["all"] * (k % 8 > 0) + [f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randrange(14))]) for k in range(300)]
    asked = spark.createDataFrame([(q, ["all", "all"] + [f"w{r.randrange(70)}" for _ in range(5)]) for q in range(20)] + [(20, []), (21, ["nowhere"])], "query_id long, tokens array<string>")
    for rows in (docs + [(300, []), (301, None)], docs + [(k, docs[k][1]) for k in range(9)] + [(7, ["w1", "w2"]), (None, ["w3"])]):
        texts = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
        wanted = bm25.best(bm25.scores(bm25.index(texts), asked), 4)
        wanted = sorted((x.query_id, x.rank, x.doc_id, round(x.score, 9)) for x in wanted.collect())
        with monkeypatch.context() as m:
            m.setattr(bm25, "index", None)
            m.setattr(bm25, "BLOCK_SCORES", 300)
            got = bm25.search(texts, asked, 4)
            assert sorted((x.query_id, x.rank, x.doc_id, round(x.score, 9)) for x in got.collect()) == wanted
        assert len(wanted) == 80


def test_few_strings_are_counted_in_texts(spark):
    rows = [(1, "Aaaa or\nfor orr"), (2, "none"), (3, None), (1, "or"), (4, "x.y xxy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(0, ["or", "aa", "or"]), (1, ["x.y"]), (2, ["a o", "", "zz"])], "query_id long, tokens array<string>")
    found = bm25.index(docs.select("doc_id", X.tokens(F.col("text")).alias("tokens")))
    got = sorted(substrings.counted_scores(docs, asked).collect())
    assert got == sorted(substrings.substring_scores(found, asked).collect()) == [(0, 1, 10.0), (1, 4, 1.0)]
    many = spark.createDataFrame([(q, [f"s{q}"]) for q in range(substrings.FEW_STRINGS + 1)], "query_id long, tokens array<string>")
    assert substrings.counted_scores(docs, many) is None


def test_texts_of_nodes_are_not_dealt(spark):
    """Only where an id is there more than once, the nodes with that id are."""
    node = lambda i, *nodes: {"node_id": i, "title": f"t{i}", "summary": "long", "nodes": list(nodes)}
    rows = [("a", json.dumps([node("x", node("y"))])), (None, json.dumps([node("x")]))]
    flat = trees.flatten(spark.createDataFrame(rows, "doc_id string, structure string"))
    assert "Exchange" not in flat._jdf.queryExecution().executedPlan().toString() and flat.count() == 3
    twice = rows + [("b", json.dumps([{**node("x"), "title": "first"}, node("y"), {**node("x"), "title": "last"}])), (None, json.dumps([node("z"), node("z")]))]
    got = {(x.doc_id, x.node_id): (x.path_ord, x.title) for x in trees.flatten(spark.createDataFrame(twice, "doc_id string, structure string")).collect()}
    assert len(got) == 6 and got["b", "x"] == ("000000", "last") and got["b", "y"] == ("000001", "ty") and got[None, "z"] == ("000000", "tz")


def test_only_picked_documents_are_parted(spark):
    """Where nodes are made from texts, each step asks for those of its own documents."""
    columns = "doc_id long, node_id string, parent_node_id string, depth int, path_ord string, title string, summary string, start_index int, end_index int, n_children int"
    nodes = spark.createDataFrame([(d, f"L{k}", None, 0, f"{k:06d}", f"t{d}", f"word{k} of {d}", k, k, 0) for d in range(5) for k in range(3)], columns)
    asked = spark.createDataFrame([(0, "word1"), (1, "nowhere")], "query_id long, text string")
    picked = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 1)], "query_id long, doc_id long, rank int")
    seen = set()

    def made(ids):
        seen.update(r.doc_id for r in ids.collect())
        return nodes.join(ids, "doc_id", "left_semi")

    show = lambda found: sorted((r.query_id, r.place, r.doc_id, r.node_id, r.content) for r in found.collect())
    assert show(search.sections(picked, made, asked)) == show(search.sections(picked, nodes, asked)) and seen == {1, 2, 3}
