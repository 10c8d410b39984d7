"""Jobs that fail, are late or start again, and stores of which a part is read."""

import json
import time

import pytest
from pyspark.sql import functions as F

from strandline import queries, session
from strandline.operators import bm25, constraint, fusion, graph
from strandline.plans import evaluate, providers, qa, search
from strandline.sources import files
from strandline.streaming import resume


def test_calls_by_policy():
    seen = []

    def model(texts):
        seen.append(texts)
        if len(seen) == 1:
            raise ConnectionError("once")
        return [t.upper() for t in texts]

    assert providers.Caller(model, providers.Policy(retries=1))(["a", "b"]) == (["A", "B"], "retried")
    assert providers.Caller(lambda t: ["one"], providers.Policy())(["a", "b"]) == (["[ERROR ValueError]"] * 2, "failed")
    begun = time.time()
    call = providers.Caller(lambda t: time.sleep(0.5), providers.Policy(seconds=0.05, retries=2, default=""))
    assert call(["a"]) == ([""], "late") and time.time() - begun < 0.45
    assert len(call.running) == 3
    for _ in range(4):
        call(["a"])
    assert len(call.running) <= providers.GIVEN_UP


def test_a_failing_model_leaves_the_context(spark):
    found = spark.createDataFrame([(1, "the context"), (2, "")], "query_id int, context string")
    asked = spark.createDataFrame([(1, "why"), (2, "what")], "query_id int, text string")

    def model(texts):
        raise RuntimeError("down")

    got = {r.query_id: (r.context, r.answer, r.status) for r in search.answers(found, asked, model, providers.Policy(default="")).collect()}
    assert got == {1: ("the context", "", "failed"), 2: ("", "", "failed")}


def test_late_hints_leave_the_question(spark):
    """A decomposer that is late gives no hints; the retrievers answer for the question itself."""
    docs = spark.createDataFrame([(k, f"pump valve w{k}".split()) for k in range(8)], "doc_id int, words array<string>")
    asked = spark.createDataFrame([(1, "pump w3")], "query_id int, text string")

    def slow(texts):
        time.sleep(1)
        return texts

    corpus = search.Corpus(docs, decomposer=slow, decomposing=providers.Policy(seconds=0.05))
    ranked, hits = search.route(corpus, asked)
    assert ranked.orderBy("rank").first().doc_id == 3 and {r.source for r in hits.collect()} == {"rc"}


def test_all_four_retrievers_have_hits(spark, sf):
    corpus = queries.typed_corpus(spark, sf)
    _, hits = search.route(corpus, queries.nation_questions(spark, sf), search.Limits(rank_iterations=4))
    assert {r.source for r in hits.select("source").distinct().collect()} == {"rc", "kg_cs", "kg_fr", "rc_embed"}
    texts = {r.node: r.text for r in corpus.node_texts.collect()}
    assert "dynamic effects" in texts["gdc:4"] and any("dynamic effects" in t for n, t in texts.items() if n.startswith("doc:"))


def test_no_table_of_the_corpus_goes_to_every_task(spark, sf, monkeypatch):
    """By the bytes of its files Spark would send a table of millions of rows to every task, through the driver's memory."""
    sent, nodes, folders = [], lambda x: [x.apply(k) for k in range(x.size())], ("/docs-", "/edges-", "/graph-", "/links-", "/customer.parquet")

    def look(plan, below):
        if plan.nodeName().startswith("Scan parquet"):
            sent.extend(f for f in folders if below and f in plan.relation().location().rootPaths().mkString(" "))
        for x in [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else nodes(plan.children()):
            look(x, below or plan.nodeName() == "BroadcastExchange")

    def seen(df, name):
        look(df._jdf.queryExecution().executedPlan(), False)
        return session.stored(df, name)

    for module in (bm25, constraint, fusion, graph, search):
        monkeypatch.setattr(module, "stored", seen, raising=False)
    monkeypatch.setattr(session, "MOST_TOLD", -1, raising=False)
    monkeypatch.setattr(queries, "_KEPT", {})
    found = queries.route_full(spark, sf)
    assert not sent
    monkeypatch.undo()
    few = queries.route_full(spark, sf)
    assert sorted(found.collect()) == sorted(few.collect()) and found.count() > 0


def test_a_job_that_fails_in_a_batch_gives_each_row_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(4):
        spark.createDataFrame([(10 * k + j, "x") for j in range(10)] + [(0, "again")], "id long, v string").coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema

    def broken(rows):
        # The second batch is written in part, then its task fails.
        return rows.withColumn("v", F.when(F.col("id") >= 15, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="broken"):
        resume.run(spark, source, schema, out, state, broken, files_per_batch=1)
    resume.run(spark, source, schema, out, state, lambda rows: rows, files_per_batch=1)
    resume.run(spark, source, schema, out, state, lambda rows: rows, files_per_batch=1)
    assert sorted(r.id for r in resume.results(spark, out).collect()) == list(range(40))
    # Rows that were seen are known in a later run too.
    spark.createDataFrame([(3, "late"), (99, "new")], "id long, v string").coalesce(1).write.mode("append").parquet(source)
    resume.run(spark, source, schema, out, state, lambda rows: rows, files_per_batch=1)
    assert sorted(r.id for r in resume.results(spark, out).collect()) == [*range(40), 99]


def files_read(df):
    """Files that the last run of a query opened."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan "):
            metric = node.metrics().get("numFiles")
            total += metric.get().value() if metric.isDefined() else 0
        inner = [node.plan()] if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")) else []
        inner += [node.children().apply(k) for k in range(node.children().size())]
        todo += inner
    return total


def test_few_parts_of_a_store_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    nodes = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("n").alias("node_id"), F.lit("000000").alias("path_ord"))
    files.write_tree_nodes(nodes, path)
    every = files_read(files.read_tree_nodes(spark, path))
    some = files.read_tree_nodes(spark, path, spark.createDataFrame([(5,), (77,), (999,), (5000,)], "doc_id long"))
    assert sorted(r.doc_id for r in some.collect()) == [5, 77, 999]
    assert every >= 200 and files_read(some) <= 12


def test_few_tree_files_are_opened(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"d {k}+x_structure.json").write_text(json.dumps({"structure": [{"node_id": f"n{k}"}]}) if k % 7 else "{")
    (tmp_path / "other.json").write_text("{}")
    folder = f"file://{tmp_path}"
    assert {r.doc_id for r in files.read_trees(spark, folder).collect()} == {f"d {k}+x" for k in range(30)}
    some = files.read_trees(spark, folder, spark.createDataFrame([("d 3+x",), ("d 7+x",), ("d 99+x",)], "doc_id string"))
    assert sorted((r.doc_id, r.structure) for r in some.collect()) == [("d 3+x", '[{"node_id":"n3"}]'), ("d 7+x", "[]")]
    assert files.read_trees(spark, folder, spark.createDataFrame([("none",)], "doc_id string")).count() == 0


def test_evidence_of_odd_rows(spark):
    """No queries, no document, an unreadable file, a section without file but a cited one that is there."""
    schema = "id int, section_number string, generated_queries array<struct<query:string>>, relevant_docs array<struct<path:string,reference:string,type:string>>"
    rows = spark.createDataFrame(
        [(1, "1.1", [("what of pumps",)], []), (2, "9.9", [("what",)], [("a/none.pdf", "r", "PDF"), ("a/c.pdf", "r", "PDF")]), (3, "9.9", [("what",)], []), (4, "1.1", [], []), (5, "2.2", [("why",)], [])], schema
    )
    docs = spark.createDataFrame([(2, "b.pdf", "SRP", "B", "1.1"), (1, "a.pdf", "SRP", "A", "1.1"), (3, "bad.pdf", "RG", "Bad", "2.2")], "doc_ord int, filename string, doc_type string, title string, section_number string")
    long = "II. ACCEPTANCE CRITERIA\n" + "pumps and valves " * 10
    read = spark.createDataFrame([("a.pdf", ["I. AREAS OF REVIEW\n" + "nothing here " * 20, long] + ["x"] * 40, None), ("c.pdf", ["short"], None), ("bad.pdf", None, "ValueError: no")], "filename string, pages array<string>, error string")
    found = {r.id: r for r in qa.evidence(rows, docs, read).collect()}
    assert set(found) == {1, 2, 5} and found[1].evidence_doc == "a.pdf" and found[1].section.startswith("II. ACCEPTANCE")
    assert (found[2].evidence, found[2].section, found[5].evidence) == ("short", "Full Document", "[ERROR reading PDF: ValueError: no]")
    model = lambda ps: ['{"ground_truth": "yes", "answerable": true}' if "pumps" in p else "no" for p in ps]
    got = {r.id: r for r in qa.step_three(qa.evidence(rows, docs, read), model).collect()}
    assert (got[1].ground_truth, got[1].answerable, got[1].confidence, got[1].evidence_section) == ("yes", True, "low", found[1].section)
    assert (got[2].ground_truth, got[2].answerable, got[2].evidence_section) == ("", False, "")


def test_an_evaluation_goes_on_where_it_stopped(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"pump valve w{k} part{k}".split()) for k in range(6)], "doc_id int, words array<string>")
    nodes = spark.createDataFrame([(k, f"n{j}", None, 0, f"00000{j}", f"w{k}", f"about part{k} and w{k}, {j}", 1, 2, 0) for k in range(6) for j in range(2)], "doc_id int, node_id string, parent_node_id string, depth int, path_ord string, title string, summary string, start_index int, end_index int, n_children int")
    schema = "query_id int, text string, gt_answer string, relevant_docs array<struct<path:string,reference:string>>, matched_docs array<string>"
    asked = spark.createDataFrame([(1, "w3 part3", "W3, part3!", [("a/3.pdf", "r")], ["3"]), (2, "w5", "no", None, ["5"]), (3, "zzz", "no", [], [])], schema)
    seen = []

    def model(texts):
        return [t.split("Question: ")[1].split("\n")[0] for t in texts]

    corpus, out = search.Corpus(docs, sections=nodes), str(tmp_path / "out")
    first = evaluate.run(corpus, asked.where("query_id = 1"), out, generator=model)
    assert first.count() == 1
    rows = {r.query_id: r for r in evaluate.run(corpus, asked, out, generator=model).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].answer == "w3 part3" and rows[1].relevant_docs[0].path == "a/3.pdf" and len(rows[1].relevant_docs) == 1
    assert rows[2].relevant_docs[0].path == "5" and rows[2].retrieved_chunks[0].doc_id == 5 and rows[2].retrieved_chunks[0].score == 1.0
    assert rows[3].retrieved_chunks == [] and rows[3].n_docs_selected == 0 and rows[3].answer == ""
    told = spark.read.json(f"{out}/metrics").first()
    assert told.queries == 2 and told.recall_at_2 == 1.0 and abs(told.exact_match - 1 / 3) < 1e-9 and told.p95 > 0
    assert evaluate.run(corpus, asked, out).count() == 3 and seen == []


def test_more_laws_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(graph, "LAW_BLOCK", 3)
    row = lambda k, kind, e=(), c=(): (k, f"{kind}{k}", kind, str(k), "t", list(e), [], [], [], list(c))
    docs = [row(k, "REG") for k in range(10)] + [row(20 + k, "SRP", [str(k)], ["50"]) for k in range(7)]
    frame = spark.createDataFrame(docs, "doc_ord int, doc_id string, doc_type string, section_number string, title string, entity_refs array<string>, guide_refs array<string>, plan_refs array<string>, special_refs array<string>, law_refs array<string>")
    relations = spark.createDataFrame([("REG", "SRP", "ESTABLISHES_CRITERIA")], "src_type string, dst_type string, relation string")
    _, edges = graph.build(frame, relations)
    counts = {r.relation: r["count"] for r in edges.groupBy("relation").count().collect()}
    assert counts["CONTAINS_GDC"] == 70 and counts["ESTABLISHES_CRITERIA"] == 70 and counts["CITES_REGULATION"] == 70
