"""Queries over the given tables for the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, edit_prints, filter_audit, html_text, jaccard_join, language_id, mixing, neighbours, packing, sharding, substring_dedup, toxicity, warc
from .common import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and the matches and words behind the score."""
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "hits", "n_words")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page's main text."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return language_id.language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of every vector whose id 100 divides, among all others."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block (of its source), row (in the block), slot (of the block) of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("_doc.doc_id", "_doc.source", F.col("_block").alias("block"), F.col("_row").alias("row"), F.col("_slot").alias("slot"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that was read back."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, over 24 shards."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, for shingles of 4 words and a similarity of 0.85."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return edit_prints.edited_prints(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of five filters."""
    return filter_audit.audit_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, for repeats of 20 words."""
    out = substring_dedup.repeats(table(spark, sf_dir, "documents"), 20)
    return out.select("doc_id", "n_words", substring_dedup.removed().alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows = conversation_trie.borrowed(materialise(conversation_trie.turns(table(spark, sf_dir, "conversations")), "turns"))
    return conversation_trie.trie(conversation_trie.paths(rows)).drop("node", "parent")


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_neighbours": op2_neighbours,
        "op3_mixing": op3_mixing,
        "op4_html_text": op4_html_text,
        "op5_language_id": op5_language_id,
        "op6_warc": op6_warc,
        "op7_sharding": op7_sharding,
        "op8_packing": op8_packing,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_edit_prints": op10_edit_prints,
        "op11_filter_audit": op11_filter_audit,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_conversation_trie": op13_conversation_trie,
    }


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MIXING_SQL = """
WITH RECURSIVE sizes AS (SELECT coalesce('=' || source, 'null') AS s, count(*) AS c FROM documents GROUP BY 1),
  w AS (SELECT s, pow(c, 0.5) AS w, count(*) OVER () AS n, sum(pow(c, 0.5)) OVER () AS total FROM sizes),
  x AS (SELECT s, n, greatest(1000, 4 * n) AS period, (greatest(1000, 4 * n) - n) * w / total AS exact FROM w),
  y AS (SELECT s, period, floor(exact)::INT AS whole, exact - floor(exact) AS frac, period - n - sum(floor(exact)) OVER () AS rest FROM x),
  parts AS (SELECT s, period, 1 + whole + (row_number() OVER (ORDER BY frac DESC, s) <= rest)::INT AS parts, row_number() OVER (ORDER BY s) AS place FROM y),
  pl AS (SELECT list(parts ORDER BY place) AS p, any_value(period) AS period FROM parts),
  run(slot, done, k, turn) AS (
    SELECT -1, list_transform(p, lambda v: 0), 0, 0 FROM pl
    UNION ALL
    SELECT slot + 1, list_transform(done, lambda v, i: v + (i = ch)::INT), ch, done[ch] FROM (
      SELECT slot, done, (list_min(list_transform(p, lambda v, i: CASE WHEN floor(done[i] * period / v) <= slot + 1 THEN ceil((done[i] + 1) * period / v)::BIGINT * 1000000 + i END)) % 1000000)::INT AS ch
      FROM run, pl WHERE slot + 1 < period)),
  turns AS (SELECT s, parts, period, turn, slot FROM run JOIN parts ON place = k WHERE slot >= 0),
  ranked AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('mix-1:' || doc_id), 1, 15))::BIGINT, doc_id) - 1 AS r FROM documents)
SELECT doc_id, source, r // 8 AS block, (r % 8)::INT AS row, ((r // 8) // t.parts) * t.period + t.slot AS slot
FROM ranked JOIN turns t ON t.s = ranked.s AND t.turn = (r // 8) % t.parts
"""

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(doc, other) AS (SELECT a, b FROM edges UNION SELECT r.doc, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON doc = d.doc_id GROUP BY d.doc_id
"""


AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
  f AS (SELECT part,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM t),
  g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
  l AS (SELECT unnest(range(1, 6)) AS k),
  o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM l a, l b, l c, l d, l e WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k),
  s AS (SELECT o, k AS step, o[k] AS own, list_transform(o, lambda x: substr('ABCDE', x::INT, 1)) AS names FROM o, l),
  m AS (SELECT part, names, step, own, fails[own] AS failing, list_bool_or(list_transform(range(1, step), lambda i: fails[o[i]])) AS gone, list_sum(list_transform(fails, lambda x: x::INT)) = 1 AS one, n, good, toxic FROM g, s),
  r AS (SELECT part, array_to_string(names, '') AS filter_order, step::INT AS step, own,
    coalesce(sum(n) FILTER (WHERE NOT failing AND NOT coalesce(gone, false)), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE failing AND NOT coalesce(gone, false)), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failing AND one), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE failing AND NOT coalesce(gone, false)), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE failing AND NOT coalesce(gone, false)), 0)::BIGINT AS toxic_lost
    FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""

REPEATS_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
  v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
  r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
  words AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t)),
  kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""

TRIE_SQL = """
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), b)) AS crcs),
  rows AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT c, xor(list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT), lambda s, b: xor(s // 256, crcs[(xor(s % 256, b) + 1)::INT]), 4294967295), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM rows), bits),
  built AS (SELECT c, place, role, text FROM convs JOIN rows ON conv_id = c - c % 5 AND place <= h UNION ALL SELECT c, place, role, text FROM convs JOIN rows ON conv_id = c AND place > h),
  paths AS (SELECT c, coalesce(list({'role': role, 'text': text} ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS p FROM convs LEFT JOIN built USING (c) GROUP BY c),
  steps AS (SELECT c, d, p[1:d] AS prefix, len(p) AS whole FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM paths)),
  nodes AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE whole = d), '')) AS ends_sha256 FROM steps GROUP BY ALL),
  up AS (SELECT x.*, y.conv_id AS parent_conv_id, CASE WHEN x.d > 0 THEN (x.n_convs - 1) * strlen(x.prefix[x.d].text) ELSE 0 END AS own, x.prefix[1:x.d - 1] AS parent FROM nodes x LEFT JOIN nodes y ON x.d > 0 AND y.d = x.d - 1 AND y.prefix = x.prefix[1:x.d - 1]),
  kids AS (SELECT parent AS prefix, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
  families AS (SELECT up.*, coalesce(n, 0) AS n_children FROM up LEFT JOIN kids USING (prefix, d)),
  sums AS (SELECT prefix[1:a] AS prefix, a AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT prefix, own, n_children, unnest(range(0, d + 1)) AS a FROM families) GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM families JOIN sums USING (prefix, d)
"""


def oracle_sql() -> dict[str, str]:
    """Learnt models, tokenizers, walks, check sums and searches that may miss are beyond SQL; tests/llm has their brute force."""
    return {"op3_mixing": MIXING_SQL, "op6_warc": WARC_SQL, "op9_jaccard_join": JACCARD_SQL, "op11_filter_audit": AUDIT_SQL, "op12_substring_dedup": REPEATS_SQL, "op13_conversation_trie": TRIE_SQL}
