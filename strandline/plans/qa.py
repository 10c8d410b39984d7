"""The question-answer benchmark set, step by step, and samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.text import basename, numbered, ordered_case, strip, unfenced
from strandline.operators.extract import best_section, bounded_text, question_refs
from strandline.plans.providers import Policy, Provider, ask

# Patterns of what a question's core begins with (at the begin of a line, in any case), and what a rule's text begins with.
MARKERS = (
    r"Information Request(?:ed)?[\s:\n]",
    r"Requested Information[\s:\n]",
    r"The (?:NRC )?staff request[s]?\s",
    r"Please (?:provide|explain|clarify|justify|describe|address|discuss)\s",
    r"Provide the following",
    r"Provide clarification",
    r"Provide a (?:description|justification|basis|summary)",
    r"The applicant (?:should|is requested|is asked|needs to|must)\s",
    r"(?:Clarify|Explain|Justify|Describe|Address|Discuss|Identify|Confirm|Verify|Update|Revise)\s",
    r"(?:In (?:light|view|consideration) of|Based on|Given) (?:the|this)",
    r"(?:In (?:FSAR|DCD|the DCA))",
    r"(?:FSAR|DCD) (?:Tier|Section|Table|Figure)",
    r"(?:NuScale|The applicant) (?:should|is|has|did not|does not)",
    r"(?:It appears|It is unclear|It is not clear|The staff notes)",
    r"(?:a|b|c|1|2|3)\.\s+(?:Provide|Explain|Clarify|Describe|Identify|Justify|Address)",
)
# Fixed values as well: what a rule's text begins with, and the header before a background.
RULE_BEGIN = r"^\s*(?:10\s*CFR|GDC|General Design|SRP Section|Standard Review|To meet the requirements|Regulatory [Bb]asis)"
HEADER = r"(?i)^\s*(Regulatory\s+(?:Background|Basis)\s*:?\s*\n)"


def first_of(names: tuple[str, ...]) -> str:
    return r"(?im)(?:^|\n)\s*(?:" + "|".join(names) + ")"


def split_question(question: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """struct(background, core): by the first marker; by a marker after a header; by the first sentence with a
    marker in a text that begins with a rule; at the first line break in the second half of a long text."""
    pattern = first_of(markers)
    n = F.length(question)

    def cut(at: Column, least: int) -> Column:
        """``at`` counts characters before the core; null or -1: no cut."""
        core = strip(F.substr(question, at + 1, n))
        return F.when((at >= 0) & (F.length(core) >= least), F.struct(strip(F.substr(question, F.lit(1), at)).alias("background"), core.alias("core")))

    def place(text: Column, regex: str) -> Column:
        return F.regexp_instr(text, F.lit(regex)) - 1

    head = F.length(F.regexp_extract(question, HEADER, 1)) + F.length(F.regexp_extract(question, r"^(\s*)", 1))
    after = F.substr(question, head + 1, n)
    second = F.when(F.regexp_like(question, F.lit(HEADER)) & (place(after, pattern) >= 0), head + place(after, pattern))
    sentences = F.split(question, r"(?<=[.!?])\s+(?=[A-Z])")
    marked = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(sentences) - 1, F.lit(1))), lambda k: F.when(F.regexp_like(F.get(sentences, k), F.lit(pattern)), k)), lambda k: k.isNotNull())
    j = F.get(marked, F.lit(0))
    third = F.when(
        F.regexp_like(question, F.lit(RULE_BEGIN)) & j.isNotNull(),
        F.struct(strip(F.array_join(F.slice(sentences, F.lit(1), j), " ")).alias("background"), strip(F.array_join(F.slice(sentences, j + 1, F.greatest(F.size(sentences), F.lit(1))), " ")).alias("core")),
    )
    half = F.floor(n / 2).cast("int")
    rest = F.substr(question, half + 1, n)
    line = F.when((n > 300) & (F.instr(rest, "\n") > 0), half + F.instr(rest, "\n") - 1)
    return F.coalesce(cut(place(question, pattern), 50), cut(second, 50), F.when(F.length(third["core"]) >= 50, third), cut(line, 80), F.struct(F.lit("").alias("background"), question.alias("core")))


def difficulty(references: Column, documents: Column) -> Column:
    return ordered_case([("easy", (references <= 2) & (documents <= 1)), ("hard", (references >= 5) | (documents >= 3))], "medium")


def total_refs(refs: Column) -> Column:
    return F.aggregate(F.map_values(refs), F.lit(0), lambda n, v: n + F.size(v))


def capped(rows: DataFrame, group: str, order: list[str], most: int = 15) -> DataFrame:
    """The first rows of each group; rows whose group is empty aren't capped. As the rank alone decides, tasks keep the
    first rows of a group before anything is shuffled."""
    empty = F.coalesce(F.col(group).cast("string") == "", F.lit(False))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.where(~empty).withColumn("_p", place).where(F.col("_p") <= most).drop("_p").union(rows.where(empty))


def with_ordinals(rows: DataFrame, group: list[str], order: list[str], out: str = "id", width: int = 3) -> DataFrame:
    """An id from the group's columns and the row's number in it."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn(out, numbered(F.concat_ws("_", *group), n, width))


def reject_reason(answer: Column, answerable: Column, confidence: Column, query: Column, least: int = 20) -> Column:
    """The first rule that a row breaks; null if it may stay."""
    return F.nullif(
        ordered_case(
            [
                ("short_answer", F.length(strip(F.coalesce(answer, F.lit("")))) < least),
                ("not_answerable", ~F.coalesce(answerable, F.lit(False))),
                ("low_confidence", F.coalesce(confidence, F.lit("")) == "low"),
                ("short_query", F.length(F.coalesce(query, F.lit(""))) < least),
            ],
            "",
        ),
        F.lit(""),
    )


def step_one(records: DataFrame, cap: int = 15) -> DataFrame:
    """records(ord, source, question, answer, section_number, srp_section, relevant_docs) with documents, in order of
    ``ord``, the sections' candidates as ``matched_docs``: filters, caps, splits, references, difficulty, ids."""
    kept = records.where(F.size("relevant_docs") > 0).where((F.col("srp_section") == "") | (F.size("matched_docs") > 0))
    kept = capped(kept, "srp_section", ["ord"], cap)
    parts = split_question(F.col("question"))
    refs = question_refs(F.concat("question", F.lit(" "), "answer"))
    rows = kept.withColumn("parts", parts).withColumn("extracted_refs", refs).withColumn("n_total_refs", total_refs(F.col("extracted_refs")))
    number = F.row_number().over(Window.partitionBy("source").orderBy("ord")) - 1
    return rows.select(
        numbered(F.col("source"), number, 4).alias("id"), "source", "section_number", "srp_section", difficulty(F.col("n_total_refs"), F.size("matched_docs")).alias("difficulty"),
        F.col("parts.background").alias("regulatory_background"), F.col("parts.core").alias("core_question"), F.col("question").alias("original_question"), F.col("answer").alias("original_answer"),
        "extracted_refs", "matched_docs", "relevant_docs", "n_total_refs",
    )


#: Characters of evidence that a prompt shows, of a core question, and of an answer to be judged.
EVIDENCE_CHARS, CORE_CHARS, ANSWER_CHARS = 6000, 1500, 1000


def unskipped(queries: Column) -> Column:
    """Generated queries that can be answered without the applicant's own report; unmarked ones can."""
    return F.filter(queries, lambda q: F.coalesce(q["answerable_without_fsar"], F.lit(True)))


GENERATED = "struct<queries:array<struct<query:string,sub_difficulty:string,target_concepts:array<string>,answerable_without_fsar:boolean>>,skip_reason:string>"


def step_two(replies: DataFrame, column: str = "reply") -> DataFrame:
    """A generator's replies as ``generated_queries``, those that need the applicant's report left out, and ``skip_reason``."""
    found = F.from_json(unfenced(F.col(column)), GENERATED)
    rows = replies.withColumn("_g", found)
    return rows.select("*", unskipped(F.coalesce(F.col("_g")["queries"], F.array().cast("array<struct<query:string,sub_difficulty:string,target_concepts:array<string>,answerable_without_fsar:boolean>>"))).alias("generated_queries"), F.coalesce(F.col("_g")["skip_reason"], F.lit("")).alias("skip_reason")).drop("_g")


def generated(rows: DataFrame, generator: Provider, policy: Policy | None = None) -> DataFrame:
    """``step_two`` of what a generator replies to the core questions of step one's rows; where it fails there are no queries."""
    prompt = F.format_string("Section: %s\nDifficulty: %s\nReferences: %s\nQuestion:\n%s", F.coalesce("section_number", F.lit("")), F.coalesce("difficulty", F.lit("medium")), F.to_json("extracted_refs"), F.substring(F.coalesce("core_question", F.lit("")), 1, CORE_CHARS))
    replies = ask(rows.select("id", prompt.alias("prompt")), "prompt", "reply", generator, policy=policy or Policy(default=""))
    return rows.join(step_two(replies).drop("prompt", "reply"), "id")


def flat_queries(rows: DataFrame) -> DataFrame:
    """One row for each of the generated queries: (id, section, place, difficulty, query, target_concepts)."""
    each = rows.select("id", "section_number", F.posexplode("generated_queries").alias("place", "q"))
    return each.select("id", F.col("section_number").alias("section"), "place", F.coalesce("q.sub_difficulty", F.lit("?")).alias("difficulty"), "q.query", F.coalesce("q.target_concepts", F.array().cast("array<string>")).alias("target_concepts"))


TRUTH = "struct<ground_truth:string,evidence_section:string,confidence:string,answerable:boolean>"


def evidence(rows: DataFrame, documents: DataFrame, files: DataFrame, most_pages: int = 30, **sections: object) -> DataFrame:
    """(id, place, query, section_number, doc_type, doc_title, evidence_doc, section, evidence): what each generated query
    is to be answered from.

    rows(id, section_number, generated_queries, relevant_docs of structs with path, reference, type), documents(doc_ord,
    filename, doc_type, title, section_number), files(filename, pages, error). The document is the first one of the row's
    section, or else the first relevant one that is among the files; of its first pages the section that fits the query
    best is taken. Rows without queries or without document give nothing.
    """
    by_section = documents.groupBy("section_number").agg(F.min_by(F.struct("filename", "doc_type", "title"), "doc_ord").alias("own"))
    cited = rows.select("id", F.posexplode("relevant_docs").alias("k", "x")).select("id", "k", basename(F.col("x.path")).alias("filename"), F.col("x.type").alias("doc_type"), F.col("x.reference").alias("title"))
    cited = cited.join(files.select("filename"), "filename", "left_semi").groupBy("id").agg(F.min_by(F.struct("filename", "doc_type", "title"), "k").alias("other"))
    found = rows.join(by_section, "section_number", "left").join(cited, "id", "left").withColumn("doc", F.coalesce("own", "other")).where("doc is not null")
    asked = found.select("id", "section_number", "doc", F.posexplode("generated_queries").alias("place", "q"))
    # What is known of a query goes along with it, so that the sections found need no join.
    key = F.struct("id", "place", "section_number", "doc", F.col("q.query").alias("query"))
    texts = asked.select(key.alias("id"), F.col("q.query").alias("query"), F.col("doc.filename").alias("filename")).join(files.select("filename", bounded_text(F.col("pages"), F.col("error"), most_pages).alias("text")), "filename").select("id", "text", "query")
    best = best_section(texts, **sections)
    return best.select("id.id", "id.place", "id.query", "id.section_number", "id.doc.doc_type", F.col("id.doc.title").alias("doc_title"), F.col("id.doc.filename").alias("evidence_doc"), F.col("title").alias("section"), F.col("body").alias("evidence"))


def step_three(found: DataFrame, generator: Provider, policy: Policy | None = None) -> DataFrame:
    """(id, place, query, ground_truth, evidence_doc, evidence_section, confidence, answerable) from ``evidence``: a
    generator's replies as JSON; a reply that isn't, and a generator that fails, leave the query unanswerable."""
    prompt = F.format_string("Query: %s\nDocument: %s %s, %s\nEvidence:\n%s", "query", F.coalesce("doc_type", F.lit("")), "section_number", F.coalesce("doc_title", F.lit("")), F.substring("evidence", 1, EVIDENCE_CHARS))
    rows = ask(found.select("id", "place", "query", "evidence_doc", "section", prompt.alias("prompt")), "prompt", "reply", generator, policy=policy or Policy(default=""))
    reply = F.from_json(unfenced(F.col("reply")), TRUTH)
    known = F.coalesce(reply["ground_truth"], reply["evidence_section"], reply["confidence"], reply["answerable"].cast("string")).isNotNull()
    return rows.select(
        "id", "place", "query", F.coalesce(reply["ground_truth"], F.lit("")).alias("ground_truth"), "evidence_doc", F.coalesce(reply["evidence_section"], F.when(known, F.col("section")).otherwise("")).alias("evidence_section"),
        F.coalesce(reply["confidence"], F.lit("low")).alias("confidence"), F.coalesce(reply["answerable"], F.lit(False)).alias("answerable"),
    )


def flat_truth(rows: DataFrame) -> DataFrame:
    """Questions to evaluate: answered and answerable ones, the evidence's file names as ids of documents."""
    good = rows.where((F.coalesce("ground_truth", F.lit("")) != "") & F.coalesce("answerable", F.lit(False)))
    return good.select(F.col("id").alias("query_id"), "query", F.col("ground_truth").alias("gt_answer"), F.transform(F.coalesce("evidence_docs", F.array().cast("array<string>")), lambda x: F.replace(x, F.lit(".pdf"), F.lit(""))).alias("matched_docs"), F.coalesce("difficulty", F.lit("?")).alias("difficulty"))


def judged(rows: DataFrame, column: str | None = "reply") -> DataFrame:
    """Rows that a judge's replies let pass, with ``judge_verdict`` and ``judge_issues``; a reply that isn't such JSON fails.
    Without a judge all rows pass, marked SKIP."""
    if column is None:
        return rows.withColumn("judge_verdict", F.lit("SKIP")).withColumn("judge_issues", F.array().cast("array<string>"))
    found = F.from_json(unfenced(F.col(column)), "struct<verdict:string,issues:array<string>>")
    marked = rows.withColumn("judge_verdict", F.coalesce(found["verdict"], F.lit("FAIL"))).withColumn("judge_issues", F.coalesce(found["issues"], F.array().cast("array<string>")))
    return marked.where(F.col("judge_verdict") == "PASS")


def verdicts(rows: DataFrame, judge: Provider, policy: Policy | None = None) -> DataFrame:
    """Rows (query, difficulty, ground_truth, evidence_doc, ...) with ``reply``: what a judge says of the answer's begin."""
    prompt = F.format_string("Query: %s\nDifficulty: %s\nAnswer: %s\nDocument: %s", "query", F.coalesce("difficulty", F.lit("")), F.substring("ground_truth", 1, ANSWER_CHARS), F.coalesce("evidence_doc", F.lit("")))
    return ask(rows.withColumn("prompt", prompt), "prompt", "reply", judge, policy=policy or Policy(default="")).drop("prompt")


def step_four(rows: DataFrame, judge: str | Provider | None = None, least: int = 20, policy: Policy | None = None) -> DataFrame:
    """The rows (id, source, query, ground_truth, answerable, confidence, ...) that no rule and no judge rejects, with ids
    given anew. ``judge``: a column of replies, or a provider that is asked about what the rules leave."""
    kept = rows.where(reject_reason(F.col("ground_truth"), F.col("answerable"), F.col("confidence"), F.col("query"), least).isNull())
    if judge is not None and not isinstance(judge, str):
        kept, judge = verdicts(kept, judge, policy), "reply"
    kept = judged(kept, judge)
    number = F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1
    return kept.withColumn("id", numbered(F.concat("source", F.lit("_Q")), number, 4))


def pending(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows that an earlier run didn't finish."""
    return rows.join(done.select(key), key, "left_anti")


def first_file(rows: DataFrame, primary: DataFrame, other: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``file``: the first of primary(key, file, order), else of other(key, file, order)."""
    one = primary.groupBy(key).agg(F.min_by("file", order).alias("_one"))
    two = other.groupBy(key).agg(F.min_by("file", order).alias("_two"))
    return rows.join(one, key, "left").join(two, key, "left").withColumn("file", F.coalesce("_one", "_two")).drop("_one", "_two")


def with_evidence(relevant: Column, doc: Column) -> Column:
    """A document's id added to an array of paths none of which holds it."""
    return F.when(F.exists(relevant, lambda p: F.contains(p, doc)), relevant).otherwise(F.array_append(relevant, doc))


def round_robin(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """One row of each group in turn, groups by name, until there are n: of no group more than n are needed."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group, *order).limit(n)


def heads(rows: DataFrame, group: str, names: list[str], order: list[str], n: int) -> DataFrame:
    """The first max(1, n div groups) rows of each named group, n in all at most; other groups are left out."""
    each = max(1, n // max(len(names), 1))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    rank = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(group))
    return rows.where(F.col(group).isin(*names)).withColumn("place", place).where(F.col("place") <= each).withColumn("stratum", rank).orderBy("stratum", "place").limit(n)


def most_common(rows: DataFrame, column: str, k: int = 5) -> DataFrame:
    return rows.groupBy(column).count().orderBy(F.desc("count"), column).limit(k)
