"""Small fixtures with results worked out by hand, for the rules that the given tables don't reach."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import bm25, constraint, extract, fusion, graph, trees
from strandline.plans import evaluate, providers, qa, search
from strandline.sources import files

RELATIONS = [
    ("REG", "RG", "ESTABLISHES_REQUIREMENT"), ("REG", "SRP", "ESTABLISHES_CRITERIA"), ("REG", "DSRS", "ESTABLISHES_CRITERIA"),
    ("GDC", "RG", "PROVIDES_GUIDANCE"), ("GDC", "SRP", "IMPOSES_REQUIREMENT"), ("GDC", "DSRS", "IMPOSES_REQUIREMENT"),
    ("SRP", "RG", "ACCEPTED_METHOD"), ("DSRS", "RG", "ACCEPTED_METHOD"), ("SRP", "DSRS", "ADAPTED_FOR_NUSCALE"), ("DSRS", "SRP", "BASED_ON"),
    ("SRP", "SRP", "CROSS_REFERENCES"), ("DSRS", "DSRS", "CROSS_REFERENCES"), ("RG", "RG", "CROSS_REFERENCES"),
]


@pytest.fixture(scope="module")
def graph_of(spark):
    """One law that cites entity 38, two plans and two special plans (one of each without section), a guide, an unknown."""
    row = lambda k, i, t, s, e=(), g=(), p=(), d=(), c=(): (k, i, t, s, i + " title", list(e), list(g), list(p), list(d), list(c))
    docs = spark.createDataFrame(
        [
            row(0, "L", "REG", "50", e=["38"]), row(1, "P", "SRP", "6.2.2", e=["38", "39"], g=["1.82"], c=["50.46"]), row(2, "P0", "SRP", ""), row(3, "D", "DSRS", "6.2.2", e=["38"], p=["6.2.2"]),
            row(4, "D0", "DSRS", ""), row(5, "G", "RG", "1.82"), row(6, "U", "UNKNOWN", "", g=["1.82"], c=["50"]),
        ],
        "doc_ord int, doc_id string, doc_type string, section_number string, title string, entity_refs array<string>, guide_refs array<string>, plan_refs array<string>, special_refs array<string>, law_refs array<string>",
    )
    nodes, edges = graph.build(docs, spark.createDataFrame(RELATIONS, "src_type string, dst_type string, relation string"))
    return nodes.cache(), edges.cache()


def test_graph_edges(graph_of):
    edges = {(r.src, r.dst): r.relation for r in graph_of[1].collect()}
    assert edges[("doc:L", "gdc:38")] == "CITES_GDC"  # written after CONTAINS_GDC
    assert edges[("doc:L", "gdc:39")] == "CONTAINS_GDC"
    assert edges[("gdc:38", "doc:P")] == "IMPOSES_REQUIREMENT" and ("gdc:38", "doc:L") not in edges
    assert edges[("doc:P", "doc:G")] == "ACCEPTED_METHOD" and edges[("doc:U", "doc:G")] == "REFERENCES"
    assert edges[("doc:L", "doc:P")] == "ESTABLISHES_CRITERIA" and edges[("doc:P", "doc:L")] == "CITES_REGULATION"
    assert ("doc:U", "doc:L") not in edges
    assert edges[("doc:P", "doc:D")] == "ADAPTED_FOR_NUSCALE" and edges[("doc:D", "doc:P")] == "BASED_ON"
    assert edges[("doc:P0", "doc:D0")] == "ADAPTED_FOR_NUSCALE"  # empty sections meet


def test_constraint_search(spark, graph_of):
    nodes, edges = graph_of
    q = spark.createDataFrame([(1, "What does SRP 6.2.2 say?"), (2, "what of GDC 39"), (3, "nothing here")], "query_id int, text string")
    found = {}
    for r in constraint.search(q, nodes, edges).collect():
        found.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert found[1]["doc:P"] == 1.0 and found[1]["doc:G"] == 0.5 and found[1]["doc:D"] == 0.5 and found[1]["doc:L"] == 0.5
    assert set(found[2].values()) == {0.5} and "doc:P" in found[2] and "doc:G" in found[2]
    assert 3 not in found


def test_pagerank_sums_to_one(spark, graph_of):
    """Against iterations to the end; nodes that a query's seeds don't reach have no row."""
    nodes, edges = graph_of
    seeds = spark.createDataFrame([(1, "gdc:38", 2.0), (1, "doc:P", 1.0), (2, "doc:G", 1.0)], "query_id int, node string, weight double")
    got = {1: {}, 2: {}}
    for r in graph.pagerank(nodes, edges, seeds, tolerance=1e-9, iterations=200).collect():
        got[r.query_id][r.id] = r.rank
    ids = [r.id for r in nodes.collect()]
    for q, want in ((1, {"gdc:38": 2 / 3, "doc:P": 1 / 3}), (2, {"doc:G": 1.0})):
        assert abs(sum(got[q].values()) - 1) < 1e-9
        out = {i: [r.dst for r in edges.collect() if r.src == i] for i in ids}
        x = dict.fromkeys(ids, 1 / len(ids))
        for _ in range(200):
            lost = sum(x[i] for i in ids if not out[i])
            y = {i: (0.85 * lost + 0.15) * want.get(i, 0) for i in ids}
            for i in ids:
                for j in out[i]:
                    y[j] += 0.85 * x[i] / len(out[i])
            x = y
        assert all(abs(x[i] - got[q].get(i, 0)) < 1e-7 for i in ids)
    assert set(got[2]) == {"doc:G"} and len(got[1]) < len(ids)


def test_hops_and_paths(spark, graph_of):
    edges = graph_of[1]
    starts = spark.createDataFrame([("doc:U",)], "start string")
    assert {(r.id, r.hop) for r in graph.hops(edges, starts, 2).collect()} == {("doc:G", 1)}
    p = {r.id: r.path for r in graph.paths(edges, spark.createDataFrame([("gdc:39",)], "start string"), 2).collect()}
    assert p["doc:G"] == ["IMPOSES_REQUIREMENT", "doc:P", "ACCEPTED_METHOD", "doc:G"]


def test_graph_files(spark, graph_of, tmp_path):
    files.write_graph(*graph_of, f"file://{tmp_path}/g")
    nodes, edges = files.read_graph(spark, f"file://{tmp_path}/g")
    assert nodes.count() == graph_of[0].count() and edges.exceptAll(graph_of[1]).count() == 0
    total = {(r.what, r.name): r.n for r in graph.stats(nodes, edges).collect()}
    assert total[("nodes", None)] == 9 and total[("nodes", "GDC")] == 2


def test_bm25_small_corpus(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c", "c"]), (3, [])], "doc_id int, tokens array<string>")
    q = spark.createDataFrame([(1, ["c", "c", "zz"])], "query_id int, tokens array<string>")
    got = {r.doc_id: r.score for r in bm25.scores(bm25.index(docs), q).collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert abs(got[2] - 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3)))) < 1e-12 and list(got) == [2]
    raws = [math.log(3 - 2 + 0.5) - math.log(2.5), idf, idf]
    terms = {r.term: r.idf for r in bm25.index(docs).terms.collect()}
    assert abs(terms["a"] - 0.25 * sum(raws) / 3) < 1e-12


def test_fusion_rules(spark):
    hits = spark.createDataFrame([(1, "kg_cs", "x", 0.5), (1, "kg_cs", "y", 0.5), (1, "rc", "x", 3.0), (1, "rc", "z", 1.0), (2, "rc", "x", 2.0)], "query_id int, source string, doc_id string, score double")
    got = {(r.query_id, r.doc_id): r for r in fusion.fused(hits).collect()}
    # Equal scores are 0 after normalising, and still count as a source.
    assert got[(1, "x")].sources == 2 and abs(got[(1, "x")].score - 0.15 * 1.15) < 1e-12
    assert got[(1, "y")].score == 0 and got[(2, "x")].score == 0
    shuffled = fusion.fused(hits.orderBy(F.desc("doc_id"), "source"))
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, got.values()))


def test_bonus_needs_both(spark):
    scored = spark.createDataFrame([(1, "x", 1, 0.5), (2, "x", 1, 0.4)], "query_id int, doc_id string, sources int, score double")
    entities = spark.createDataFrame([(1, "e"), (2, "e")], "query_id int, concept string")
    chapters = spark.createDataFrame([(1, "c")], "query_id int, concept string")
    cites = spark.createDataFrame([("x", "e"), ("n", "e")], "doc_id string, concept string")
    inside = spark.createDataFrame([("other", "c")], "doc_id string, concept string")
    got = {(r.query_id, r.doc_id): round(r.score, 9) for r in fusion.with_bonus(scored, entities, chapters, cites, inside).collect()}
    assert got == {(1, "x"): 0.5, (2, "x"): 0.52, (2, "n"): 0.12}


def test_bonus_of_the_first(spark):
    """With ``k``, the first rows are those of all gains, and a concept that all documents have gives few rows."""
    docs = [(n, f"e{n % 3}") for n in range(400)] + [(n, "e0") for n in range(400)] + [(7, "e5")]
    cites = spark.createDataFrame(docs, "doc_id int, concept string")
    inside = spark.createDataFrame([(n, f"c{n % 2}") for n in range(350)], "doc_id int, concept string")
    scored = spark.createDataFrame([(1, 399, 1, 0.5), (1, 6, 2, 0.9), (2, 3, 1, 1e-9), (4, 500, 1, 0.3)], "query_id int, doc_id int, sources int, score double")
    entities = spark.createDataFrame([(1, "e0"), (1, "e1"), (2, "e0"), (2, "e5"), (3, "e2"), (3, "e5"), (5, "none")], "query_id int, concept string")
    chapters = spark.createDataFrame([(1, "c1"), (3, "c1"), (4, "c0")], "query_id int, concept string")
    given = scored, entities, chapters, cites, inside
    some = fusion.with_bonus(*given, k=5)
    # At most 5 + 2 rows of each kind for a query, whatever the number of documents.
    kinds = fusion.kinds_of(cites, inside)[0].select("kind").distinct().count()
    assert some.count() <= 3 * 7 * kinds + 4 and 5 * some.count() < fusion.with_bonus(*given).count()
    first = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 12)) for r in fusion.top(df, 5).collect())
    assert first(some) == first(fusion.with_bonus(*given))
    assert first(fusion.with_bonus(scored, entities.limit(0), chapters, cites.limit(0), inside, k=5)) == first(scored)


def test_rounding_goes_by_the_exact_value(spark):
    values = [0.125, 0.375, 2.675, 1.005, -0.125, -2.675, 0.005, 0.015, -0.001, 0.0, 1e-320, 12345678.905, 2.0**45 - 0.5, 1e300, 99.995, 0.1 + 0.2] + [k / 8 for k in range(-40, 40)] + [k * 0.005 for k in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("inf")]], "v double").repartition(3)
    got = {r.v: (r.a, r.b) for r in df.select("v", X.rounded(F.col("v")).alias("a"), X.rounded(F.col("v"), 1).alias("b")).collect()}
    assert all(got[v] == (round(v, 2), round(v, 1)) for v in values) and got[None] == (None, None) and got[float("inf")][0] == float("inf")


def test_prompts_show_the_begin(spark):
    """A generator sees 1500 characters of a core question, a judge 1000 of an answer."""
    rows = spark.createDataFrame([("a", "1", "q" * 1501, None), ("b", None, None, ["x"])], "id string, section_number string, core_question string, difficulty array<string>").withColumn("difficulty", F.lit("easy")).withColumn("extracted_refs", F.struct(F.array(F.lit("1.1")).alias("rg")))

    def generator(prompts):
        return [json.dumps({"queries": [{"query": str(p.count("q")), "target_concepts": []}]}) if "1.1" in p and "qqq" in p else "none" for p in prompts]

    made = {r.id: [q.query for q in r.generated_queries] for r in qa.generated(rows, generator).collect()}
    assert made == {"a": ["1500"], "b": []}
    found = spark.createDataFrame([("a", "s", "w" * 30, "z" * 1001, True, "high", None, None)], "id string, source string, query string, ground_truth string, answerable boolean, confidence string, difficulty string, evidence_doc string")
    kept = qa.step_four(found, lambda ps: [json.dumps({"verdict": "PASS", "issues": [str(p.count("z"))]}) for p in ps]).first()
    assert (kept.id, kept.judge_issues, kept.ground_truth) == ("s_Q_0000", ["1000"], "z" * 1001)


def test_trees(spark):
    tree = [{"title": "A", "node_id": "1", "summary": None, "start_index": 1, "end_index": 9, "nodes": [{"title": "no id", "nodes": [{"title": "C", "node_id": "3", "nodes": [{"title": "D", "node_id": "4"}]}]}, {"title": "E", "node_id": "2"}]}, {"title": "again", "node_id": "2"}]
    nodes = trees.flatten(spark.createDataFrame([("d", json.dumps(tree)), ("empty", "[]")], "doc_id string, structure string"))
    got = {r.node_id: r for r in nodes.collect()}
    assert set(got) == {"1", "2", "3", "4"} and got["3"].parent_node_id == "1" and got["3"].depth == 2 and got["4"].depth == 3
    assert got["2"].title == "again" and got["2"].path_ord == "000000000001"
    assert [r.node_id for r in trees.browse(nodes).orderBy("path_ord").collect()] == ["1", "2"]  # the later 2 is a root
    start = spark.createDataFrame([("d", "3"), ("d", "unknown")], "doc_id string, node_id string")
    assert [(r.node_id, r.relative) for r in trees.browse(nodes, start, 2).collect()] == [("4", 0)]
    assert trees.overview(nodes, 1).first().outline == "- A [2 sub]\n- again"


def test_context_budget(spark):
    picked = spark.createDataFrame([(1, "d", 1)], "query_id int, doc_id string, rank int")
    rows = [(1, "d", str(k), "T", "x" * 30, "1-2", k, True) for k in range(4)]
    chosen = spark.createDataFrame(rows, "query_id int, doc_id string, node_id string, title string, content string, pages string, place long, from_search boolean")
    got = search.contexts(picked, chosen, search.Limits(chars=50)).first().context
    # The second is cut to 20 and dots; then 53 are used, and the third isn't shown.
    assert got.count("x" * 30) == 1 and "\n" + "x" * 20 + "..." in got and got.endswith("(context limit reached)")


def test_split_question(spark):
    core = "Please explain how the design meets the limits that are stated for the plant."
    cases = [
        ("Some background.\n" + core, "Some background.", core), ("Regulatory Basis:\nThe rules say so.\n" + core, "Regulatory Basis:\nThe rules say so.", core),
        ("10 CFR 50 says so. The design is new. " + core, "10 CFR 50 says so. The design is new.", core), ("Short question?", "", "Short question?"),
        ("a" * 200 + "\n" + "b" * 160, "a" * 200, "b" * 160), ("a" * 300 + "\n" + "b" * 20, "", "a" * 300 + "\n" + "b" * 20),
    ]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, q string").select("k", qa.split_question(F.col("q")).alias("s")).collect()
    assert {r.k: (r.s.background, r.s.core) for r in rows} == {k: c[1:] for k, c in enumerate(cases)}


def test_extraction(spark):
    files_ = spark.createDataFrame(
        [
            ("10 CFR Part 50.pdf", ["Part 52 of rules", "GDC 38 and GDC 4"]), ("a b.pdf", ["DESIGN-SPECIFIC REVIEW STANDARD for NuScale plants\n 6.2.2 HEAT REMOVAL,\nREVIEW Revision 3 DSRS 6.2.2, DSRS 5.1"]),
            ("c.pdf", ["1.2 NOT THIS STANDARD REVIEW PLAN REACTOR REGULATION 3.4 WATER LEVEL APPENDIX Regulatory Guide 1.82 SRP Section 3.4.1"]),
            ("d.pdf", ["REGULATORY GUIDE 1.82 (x)\n(Task)\n Water Sources for Cooling\n A. INTRODUCTION Issue Date: March 2012"]), ("e.pdf", ["else"]),
        ],
        "filename string, pages array<string>",
    )
    got = {r.doc_id: r for r in extract.documents(files_).collect()}
    assert (got["10_CFR_Part_50"].doc_type, got["10_CFR_Part_50"].section_number, got["10_CFR_Part_50"].entity_refs) == ("REG", "52", ["38", "4"])
    assert (got["a_b"].doc_type, got["a_b"].section_number, got["a_b"].title, got["a_b"].revision, got["a_b"].special_refs) == ("DSRS", "6.2.2", "HEAT REMOVAL", "3", ["5.1"])
    assert (got["c"].doc_type, got["c"].section_number, got["c"].title) == ("SRP", "3.4", "WATER LEVEL") and got["c"].guide_refs == ["1.82"]
    assert (got["d"].doc_type, got["d"].section_number, got["d"].title, got["d"].issue_date) == ("RG", "1.82", "Water Sources for Cooling", "March 2012")
    assert (got["e"].doc_type, got["e"].section_number, got["e"].law_refs) == ("UNKNOWN", "", [])


def test_rouge_l_against_plain_table(spark):
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 12))] for _ in range(2))
        assert evaluate.common_length(a, b) == plain(a, b)


def test_providers(spark):
    rows = spark.createDataFrame([(1, "q")], "query_id int, text string")

    def reply(texts):
        return ['```json\n{"sub_queries": ["a","b","c","d","e"], "likely_criteria": ["38"]}\n```' for _ in texts]

    def broken(texts):
        raise RuntimeError("no network")

    got = providers.hints(providers.ask(rows, "text", "reply", reply), "reply").first().hints
    assert got.sub_queries == ["a", "b", "c", "d"] and got.likely_criteria == ["38"] and got.key_concepts == []
    assert providers.hints(providers.ask(rows, "text", "reply", broken), "reply").first().hints.sub_queries == []


def test_route_and_search(spark, graph_of):
    nodes, edges = graph_of
    docs = spark.createDataFrame([("doc:P", ["heat", "removal"]), ("doc:G", ["water", "sources"]), ("doc:D", ["heat", "pumps"])], "doc_id string, words array<string>")
    tree = spark.createDataFrame([("doc:P", "1", None, 0, "000000", "Heat removal", "heat removal text", 1, 2, 0), ("doc:G", "1", None, 0, "000000", "Water", "water text", 1, 2, 0)], "doc_id string, node_id string, parent_node_id string, depth int, path_ord string, title string, summary string, start_index int, end_index int, n_children int")
    q = spark.createDataFrame([(1, "heat removal in SRP 6.2.2")], "query_id int, text string")
    corpus = search.Corpus(docs=docs, nodes=nodes, edges=edges, sections=tree)
    limits = search.Limits(rank_iterations=5)
    ranked, hits = search.route(corpus, q, limits)
    assert ranked.orderBy("rank").first().doc_id == "doc:P" and {r.source for r in hits.select("source").distinct().collect()} == {"rc", "kg_cs", "kg_fr"}
    found = search.search(corpus, q, limits).cache()
    assert "heat removal text" in found.first().context
    assert search.answers(found, q).first().answer.startswith("Question: heat")


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"doc_id": "b", "filename": "b.pdf", "doc_type": "RG", "section_number": "1.1", "title": "t", "gdc_refs": ["1"]}, {"doc_id": "a", "filename": "a.pdf", "doc_type": "SRP", "section_number": "", "title": ""}]))
    rows = {r.doc_id: r for r in files.read_metadata(spark, f"file://{tmp_path}/m.json").collect()}
    assert rows["b"].entity_refs == ["1"] and rows["a"].guide_refs == [] and rows["a"].page_count == 0 and (rows["a"].doc_ord, rows["b"].doc_ord) == (0, 1)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x_structure.json").write_text(json.dumps({"doc_name": "x", "structure": [{"title": "A", "node_id": "1"}]}))
    assert trees.flatten(files.read_trees(spark, f"file://{tmp_path}/t")).first().doc_id == "x"
    (tmp_path / "q.json").write_text(json.dumps({"metadata": {}, "data": [{"question": "a"}, {"question": "b"}, {"question": "c"}]}))
    assert [r.question for r in files.read_envelope(spark, f"file://{tmp_path}/q.json", "question:string", 1, 3).orderBy("ord").collect()] == ["b", "c"]
    assert [r.source for r in files.read_questions(spark, {"u": f"file://{tmp_path}/q.json"}, "question:string").collect()] == ["u"] * 3


def test_text_expressions(spark):
    row = spark.createDataFrame([("The Heat-removal (A) b", "aXbXc", None)], "t string, u string, n string")
    got = row.select(X.slug(F.col("t")).alias("a"), X.occurrences(F.col("u"), F.lit("X")).alias("b"), X.occurrences(F.col("u"), F.lit("")).alias("c"), X.page_range(F.col("n"), F.lit(3)).alias("d"), X.display_name(F.lit("ZZ"), F.lit("1"), {"A": "a"}).alias("e"), X.unfenced(F.lit("```json\n{}\n```")).alias("f")).first()
    assert tuple(got) == ("the_heatremoval_a_b", 2, 0, "?-3", " 1", "{}")
    assert re.fullmatch(r"x_0007", row.select(X.numbered(F.lit("x"), F.lit(7), 4).alias("x")).first().x)


def test_stop_words_are_no_concept(spark):
    asked = spark.createDataFrame([(1, ["the", "and", "of", "heat"]), (2, ["heat", "removal", "of"])], "query_id int, words array<string>")
    concepts = spark.createDataFrame([("c", ["the", "and", "of", "heat", "removal"])], "concept string, words array<string>")
    # The first shares four words, but only one that isn't a stop word.
    assert [r.query_id for r in fusion.concept_matches(asked, concepts, 2).collect()] == [2]


def test_sinks_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("b", "b.pdf", "RG", ["1"]), ("a", "a.pdf", "SRP", [])], "doc_id string, filename string, doc_type string, entity_refs array<string>").repartition(2)
    files.write_metadata(rows, f"file://{tmp_path}/m")
    got = {r.doc_id: r for r in files.read_metadata(spark, f"file://{tmp_path}/m", lines=True).collect()}
    assert (got["a"].doc_ord, got["b"].doc_ord, got["b"].entity_refs, got["a"].title) == (0, 1, ["1"], "")
    files.write_vectors(spark.createDataFrame([(1, [0.5, 2.0])], "doc_id int, v array<double>"), f"file://{tmp_path}/v")
    assert files.read_vectors(spark, f"file://{tmp_path}/v").first().v == [0.5, 2.0]
    files.write_envelope(rows, f"file://{tmp_path}/e", rows.groupBy().count())
    assert spark.read.parquet(f"file://{tmp_path}/e/data").count() == 2


def test_bad_files_say_why(spark, tmp_path):
    for name, content in (("a.pdf", b"x|y|z"), ("b.pdf", b"broken")):
        (tmp_path / name).write_bytes(content)

    def pages(content):
        if content == b"broken":
            raise ValueError("no pages")
        return content.decode().split("|")

    got = files.read_documents(spark, f"file://{tmp_path}", pages)
    texts = {r.filename: r.t for r in got.select("filename", extract.bounded_text(F.col("pages"), F.col("error"), 2).alias("t")).collect()}
    assert texts == {"a.pdf": "x\ny", "b.pdf": "[ERROR reading PDF: ValueError: no pages]"}


def test_judges_and_paths(spark):
    rows = spark.createDataFrame([(1, '{"verdict": "PASS"}'), (2, "no"), (3, '```json\n{"verdict": "FAIL", "issues": ["x"]}\n```')], "id int, reply string")
    assert [r.id for r in qa.judged(rows).collect()] == [1] and {r.judge_verdict for r in qa.judged(rows, None).collect()} == {"SKIP"}
    hits = spark.createDataFrame([(1, "rc", "x", 1.0), (1, "kg_cs", "y", 1.0)], "query_id int, source string, doc_id string, score double")
    edges = {(r.src, r.dst) for r in fusion.path_edges(hits, hits.where("doc_id = 'x'")).collect()}
    assert edges == {("query:1", "source:rc"), ("query:1", "source:kg_cs"), ("source:rc", "doc:x"), ("source:rc", "merger"), ("source:kg_cs", "merger"), ("merger", "doc:x")}
    found = spark.createDataFrame([(1, 7, "n", "T", "c" * 400, 4)], "query_id int, doc_id int, node_id string, title string, content string, rank int")
    row = evaluate.reciprocal_chunks(found).first()
    assert (row.chunk_id, row.score, len(row.text)) == ("7_n", 0.25, 300)


def test_node_texts(spark):
    nodes = spark.createDataFrame([("gdc:4", "entity", "GDC 4", "GDC 4"), ("doc:a", "document", "Pumps", "SRP 6")], "id string, node_kind string, title string, display_name string")
    got = {r.node: r.text for r in extract.node_texts(nodes, spark.createDataFrame([("doc:a", "4"), ("doc:a", "9")], "id string, entity string"), spark.createDataFrame([("4", "Missiles")], "entity string, description string")).collect()}
    assert got == {"gdc:4": "gdc 4 gdc 4 missiles", "doc:a": "pumps srp 6 missiles"}


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from strandline import session

    def made(master):
        conf = SimpleNamespace(get=lambda key, default=None: None, set=lambda key, value: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None)))

    assert session.shared_dir(made("local[2]")).startswith("file:///tmp/spark-")
    with pytest.raises(RuntimeError):
        session.shared_dir(made("spark://host:7077"))


def test_passages_of_any_length(spark):
    docs = {1: "a b c d e f g h i", 2: "xx b c d e f g yy", 3: "b", 4: "no such thing", 5: "zb c d e f gg and b c"}
    asked = {1: "b c d e f g", 2: "b c d e f g h", 3: "b", 4: "b c", 5: "such", 6: "a b c d e f g h i j", 7: "b c d e f g yy"}
    q = spark.createDataFrame(list(asked.items()), "query_id int, text string").withColumn("tokens", X.tokens(F.col("text")))
    got = {(r.query_id, r.doc_id) for r in evaluate.holding(q, spark.createDataFrame(list(docs.items()), "doc_id int, text string")).collect()}
    assert got == {(i, j) for i, a in asked.items() for j, t in docs.items() if a in t}


def test_sections_are_no_rows_of_their_own(spark):
    """The best section is found inside a row: nothing is dealt out, whatever the number of sections."""
    line = lambda *w: " ".join(w + ("filler",) * 20)
    rows = [(1, "\n".join([line("one"), line("Alpha", "beta"), line("alpha", "beta"), "short alpha beta gamma"]), "alpha beta gamma of"), (2, "nothing long", "alpha"), (3, "\n".join([line("one"), line("two")]), "")]
    got = extract.best_section(spark.createDataFrame(rows, "id long, text string, query string"), (r"(?dm)^(.+)$",), r"^(\S+)")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert {r.id: (r.title, r.body) for r in got.collect()} == {1: ("Alpha", line("Alpha", "beta")), 2: ("Full Document", "nothing long"), 3: ("one", line("one"))}
