"""The ten operators against brute force, exact round trips and held-out labels, on small tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import edit_prints, entries, html_text, jaccard_join, language_id, mixing, neighbours, packing, sharding, shingles, toxicity, warc
from strandline.llm.common import pieces

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, count long, rank int, sid long, _source string, _key long, part int, _kept long, _part long, _row int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns whose names operators use themselves."""
    extra = (0.5, 1, 2, 3, 4, "x", 5, 6, 7, 8, 9)
    texts = [None, "", "  \n\t", "one two", "ONE  two", "Plain words of one text that repeats here again", "Plain words of one text that repeats here again", "x" * 50_000, "word " * 30_000, "é ü 日本 🙂 ́", "a\x0bb\x1cc", "12 34 !!", "it's <|endoftext|> l'eau"]
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, None, *extra) for k, t in enumerate(texts)]
    rows += [(6, texts[6], "en", "s", 1, *extra), (None, "no id", "en", "s", 1, *extra), (None, None, None, None, None, *extra)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_toxicity_held_out(spark):
    got = toxicity.toxicity(*[spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    seen = [r for r in rows_of(got) if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows_of(got))
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in seen]) > 0.93


def test_toxicity_matching():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): (3.0, False), toxicity.fold("clown"): (2.0, False), "achi": (1.0, True)}, slope=1.0)
    found = lexicon.automaton()
    hits = lambda t: toxicity.density(t, found)[1]
    assert [hits(t) for t in ("an idiot.", "ID10T", "іdіоt$$$", "ｉｄｉｏｔ", "idiotic", "xidiot", "c1own", "clown fish", "a clown, a fish", "achievement", "")] == [1, 1, 1, 1, 0, 0, 1, 0, 1, 1, 0]
    assert toxicity.density("idiot " * 4 + "w " * 36, found)[0] == pytest.approx(12 / 40)


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(edge, labels).count() == edge.count() and toxicity.toxicity(none, labels).count() == 0
    assert toxicity.keep_clean(edge, labels.limit(0)).count() == edge.count()
    assert toxicity.keep_clean(edge, labels).columns == edge.columns


@pytest.mark.parametrize("sf", ["sf0.1", "check_l"])
def test_neighbours_recall(spark, sf):
    if not os.path.exists(f"/root/testdata/{sf}"):
        pytest.skip("this table isn't here")
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    pdf = v.toPandas()
    ids, e = pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float)
    got = defaultdict(dict)
    for r in neighbours.search(v, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    hit, place = 0, {i: k for k, i in enumerate(ids.tolist())}
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    for q, found in got.items():
        d = np.sqrt(((e - e[place[q]]) ** 2).sum(1))
        d[place[q]] = np.inf
        best = np.lexsort((ids, d))[:10]
        hit += len({ids[k] for k in best} & {i for i, _ in found.values()})
        for i, s in found.values():
            assert abs(d[place[i]] - s) < 1e-12
        assert sorted(found) == list(range(1, 11)) and [found[k][::-1] for k in sorted(found)] == sorted(x[::-1] for x in found.values())
    print(sf, "recall", hit / (10 * len(got)))
    assert hit >= 0.9 * 10 * len(got)


def test_neighbours_with_one_id(spark):
    """Rows that repeat a vec_id are queries and candidates each on their own."""
    v = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.search(v, F.col("vec_id") % 100 == 0).collect())
    assert got == sorted([(100, 1, 1, 0.1), (100, 2, 2, 1.345362), (100, 3, 100, 1.414214), (100, 1, 2, 0.1), (100, 2, 1, 1.345362), (100, 3, 100, 1.414214)])


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("pivot", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(v, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert neighbours.search(v.limit(0), F.lit(True)).count() == 0


def test_schedule_is_fair(spark):
    shares = spark.createDataFrame([("=a", 601, 1, 1000), ("=b", 250, 2, 1000), ("=c", 100, 3, 1000), ("null", 49, 4, 1000)], "_source string, parts int, place int, period int")
    done, worst = Counter(), 0
    for t, r in enumerate(mixing.schedule(shares).orderBy("slot").collect(), 1):
        assert r.slot == t - 1 and r.turn == done[r._source]
        done[r._source] += 1
        worst = max(worst, *(abs(done[s] - n * t / 1000) for s, n in (("=a", 601), ("=b", 250), ("=c", 100), ("null", 49))))
    assert worst < 1 and done == {"=a": 601, "=b": 250, "=c": 100, "null": 49}


def test_mixing(spark, docs, edge, none):
    got = rows_of(entries.op3_mixing(spark, "/root/testdata/sf0.001"))
    assert len(got) == docs.count() and len({(r["slot"], r["row"]) for r in got}) == len(got)
    for s in {r["source"] for r in got}:
        own = sorted((r["block"], r["row"]) for r in got if r["source"] == s)
        assert own == [divmod(k, mixing.BLOCK_ROWS) for k in range(len(own))]
    given = {r._source: r.parts for r in mixing.parts(docs, {"src1": 3.0, "src2": 1.0}).collect()}
    assert sum(given.values()) == 1000 and given["=src1"] > 2.9 * given["=src2"] > 2 and given["=src3"] == 1
    mixed = mixing.interleave(edge)
    assert mixed.columns == edge.columns and mixed.exceptAll(edge).count() == 0 and mixed.count() == edge.count() and mixing.interleave(none).count() == 0


PAGE = """<html><head><title>T</title></head><body><header>Site <a href=/>home</a></header><nav><a>x</a></nav><div id="cookie-banner">We use cookies on this site</div>
<div class="content"><article class="post"><header><h1>Head &amp; line</h1></header><p class=lead>First  para<p>Second &lt;b&gt; <b>bold</b>text <a href=x>a link</a> here.<ul><li>one<li>two</ul><aside>side</aside>
<div class="share"><a>Share</a> this</div><form><label>Mail</label></form><script>if(a<b){"</p>"}</script><div class="comments"><p>Reader says this is a long comment with many words</p></div></article></div><footer>c</footer>"""


def test_html(spark):
    tree = html_text.train(spark)
    assert html_text.main_text(PAGE, tree) == "Head & line First para Second <b> boldtext a link here. one two"
    plain = "<div><a>Home</a> <a>About</a></div><h2>A title of it</h2><p>" + "word " * 60 + "<p>short one</p><p>" + "more " * 50 + "</p><div><a>l1</a></div>"
    assert html_text.main_text(plain, tree) == " ".join(["A title of it", *["word"] * 60, "short one", *["more"] * 50])
    for broken in (None, "", "<", "<p", "a<b", "<a href='x", "<p>x</p", "<!-- x", "<script>", "<" * 3000, "<p " + "\"'" * 3000, "<div>" * 3000):
        assert html_text.main_text(broken, tree) is not None
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", PAGE), (None, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("other")).withColumn("n_chars", F.lit("x"))
    assert Counter((r["page_id"], r["n_chars"]) for r in rows_of(html_text.extract(pages))) == {(1, 0): 2, (2, 63): 1, (None, 0): 1}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_given_pages(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in entries.op4_html_text(spark, "/root/testdata/sf0.01").collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[1])).split()) and r.n_chars == len(r.text)


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    seen = [r for r in rows_of(entries.op5_language_id(spark, "/root/testdata/sf0.01")) if r["held_out"]]
    assert len(seen) > 250 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in seen]) > 0.97


def test_language_distance():
    def plain(text):
        t = "".join(c if c.isalpha() else " " for c in text.lower())
        t = " " + " ".join(t.split()) + " "
        grams = Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n] != " ")
        code = lambda g: sum((1 if c == " " else ord(c)) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
        return [c for c, _ in sorted(((code(g), n) for g, n in grams.items()), key=lambda x: (-x[1], x[0]))]

    texts = ["The cat and the hat.", "Der Hund und die Katze, über", "a", "Ünïcode 日本 ok"]
    for t in texts:
        assert language_id.ranking(t).tolist() == plain(t)[: language_id.RANKS]
    ranked = language_id.Ranked({"x": language_id.ranking(texts[0]), "y": language_id.ranking(texts[1])})
    own = plain(texts[2])
    for k, p in enumerate((plain(texts[0]), plain(texts[1]))):
        assert ranked.distances(language_id.ranking(texts[2]))[k] == sum(abs(p.index(g) - i) if g in p else language_id.RANKS for i, g in enumerate(own))


def test_language_edges(edge, none):
    got = {r["doc_id"]: r for r in rows_of(language_id.language_id(edge)) if r["doc_id"] is not None}
    assert [got[k]["lang_pred"] for k in (0, 1, 2, 11)] == ["und"] * 4 and got[5]["lang_pred"] == "en"
    assert language_id.language_id(none).count() == 0 and language_id.keep_known(edge, {}).count() == 0
    assert language_id.keep_known(edge, language_id.learn(edge)).columns == edge.columns


def test_warc_round_trip(spark):
    evil = "junk WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + "x" * 100
    html = {1: evil, 2: None, 3: "", 4: evil, 5: "x" * 99, 6: "x" * 99, 7: "é" * 60, 8: "é" * 60, 9: "\r\n\r\n", 10: "y" * 300_000}
    pages = spark.createDataFrame([(k, None if k == 2 else f"http://a b/{k}\r\n", v) for k, v in html.items()], "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(1))
    got = {r.page_id: r for r in warc.archive(pages.repartition(2)).collect()}
    assert set(got) == set(html)
    for k, v in html.items():
        raw = (v or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[k].record_type, got[k].refers_to) == {4: ("revisit", 1), 8: ("revisit", 7)}.get(k, ("response", None))
    assert warc.archive(pages.limit(0)).count() == 0
    assert warc.archive(pages.where("page_id = 7").union(pages.where("page_id = 7"))).count() == 2


def test_pointer_jumping():
    starts, size = np.array([0, 10, 15, 30, 32]), 40
    assert warc.reach(starts, np.array([10, 30, 20, 40, 39]), size).tolist() == [True, True, False, True, False]
    with pytest.raises(ValueError):
        warc.reach(starts, np.array([10, 30, 20, 39, 40]), size)
    r = random.Random(2)
    for _ in range(50):
        n = r.randrange(1, 200)
        chain = np.arange(n) * 7
        fake = np.array([k * 7 + 3 for k in range(n) if r.random() < 0.5], int)
        s, t = np.concatenate([chain, fake]), np.concatenate([chain + 7, fake + r.choice([4, 7])])
        assert warc.reach(s, t, 7 * n).tolist() == [True] * n + [False] * len(fake)


def test_sharding(spark, docs, edge, none):
    got = rows_of(entries.op7_sharding(spark, "/root/testdata/sf0.01"))
    source = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) == set(range(24)) and {len(v) for v in by.values()} <= {1000 // 24, 1000 // 24 + 1}
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
        assert max(Counter(source[r["doc_id"]] for r in v).values()) <= 4
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows_of(sharding.shard(docs)):
        assert r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    odd = rows_of(sharding.shard(edge))
    assert len(odd) == edge.count() and {r["size"] for r in odd if r["doc_id"] == 0} == {8} and sharding.shard(none).count() == 0
    again = {(r["doc_id"], r["size"], r["shard"]) for r in rows_of(sharding.shard(edge.repartition(7)))}
    assert again == {(r["doc_id"], r["size"], r["shard"]) for r in odd}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_tokens_are_the_tokenizers(tokenizer):
    path, model = tokenizer
    r, alphabet = random.Random(1), "aZbé ñ'stredmvl1203.,!#$<|>\n\t ́œ日本𝒳 ß\x1c\x85İ\x00_-"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(2000)] + ["it's don't 'tis ''s '", "<|endoftext|> x", "", "a" * 3000]
    parts = [t.encode() for t in texts]
    got = packing.Tokens(path).encode(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
    assert [g.tolist() for g in got] == [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def check_packing(rows, expected):
    """``expected``: ids with the end token, by document."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, ids in expected.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for v in by_sequence.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    return padding / sum(r["length"] for r in rows)


def test_packing(spark, docs, tokenizer, edge, none):
    path, model = tokenizer
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = rows_of(packing.pack(docs, path))
    assert check_packing(rows, {k: [*model.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}) < 0.02
    odd = packing.pack(edge, path)
    assert sum(r["length"] for r in rows_of(odd) if r["doc_id"] in (0, 1, 2)) == 3 and odd.where("doc_id = 6").count() == 2
    assert packing.pack(none, path).count() == 0


def test_plan_uses_each_piece_once():
    r = random.Random(5)
    for _ in range(10):
        h = np.zeros(2049, np.int64)
        for _ in range(r.randrange(1, 400)):
            h[r.choice([2048, r.randrange(1, 2049), r.randrange(1, 200), 700])] += r.randrange(1, 50)
        given, ends = np.zeros(2049, np.int64), defaultdict(int)
        for size, first, times, sequence, at in packing.plan(h):
            assert first == given[size]
            given[size] += times
            for k in range(sequence, sequence + times):
                assert ends[k] == at
                ends[k] += size
        assert (given == h).all() and max(ends.values()) <= 2048


def brute_components(texts, k, percent):
    sets, lists = {}, defaultdict(list)
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        for g in sets[i]:
            lists[g].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = Counter((a, b) for v in lists.values() for n, a in enumerate(v) for b in v[n + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def made_texts(seed=3):
    """A large family of near copies with many edits, copies, a common passage, small families, and odd texts."""
    r, words, out = random.Random(seed), [f"w{i}" for i in range(500)], []

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(words)
        return " ".join(w)

    base, passage = [r.choice(words) for _ in range(150)], [r.choice(words) for _ in range(60)]
    out += [edited(base, r.randrange(0, 7)) for _ in range(300)] + [" ".join(base)] * 40
    out += [" ".join(passage + [r.choice(words) for _ in range(r.randrange(1, 80))]) for _ in range(120)]
    for _ in range(30):
        x = [r.choice(words) for _ in range(r.randrange(3, 60))]
        out += [edited(x, r.randrange(0, 3)) for _ in range(r.randrange(1, 6))]
    return list(enumerate([*out, None, "", "  \n", "one Two", "ONE two", "A b c D", "a\x0bb c d"]))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, percent):
    rows = made_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, percent).collect()} == brute_components(rows, k, percent)


def test_jaccard_blocks(spark, monkeypatch):
    """Small lists and blocks, so that leaders and block pairs have to find all links."""
    monkeypatch.setattr(jaccard_join, "SHORT", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    monkeypatch.setattr(jaccard_join, "MERGED", 5)
    rows = made_texts(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 4, 85).collect()} == brute_components(rows, 4, 85)


def test_jaccard_edges(edge, none):
    got = rows_of(jaccard_join.jaccard_components(edge, 4, 85))
    assert len(got) == edge.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None}
    assert by[0] == (0, 0) and by[2] == (0, 2) and by[4] == by[3] == (1, 3) and by[6][1] == by[5][1] == 5
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {None, 0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_word_hashes_see_words():
    a, b = (set(shingles.one_set(t, 2).tolist()) for t in ("The CAT sat", "the cat sat"))
    assert a == b and len(a) == 2 and shingles.one_set("", 2).size == 0 and len(shingles.one_set("ab", 2)) == 1
    assert shingles.one_set("ab c", 3).tolist() != shingles.one_set("a bc", 3).tolist() != shingles.one_set("c ab", 3).tolist()


def test_prints_walk():
    """The vectorised walks against plain ones."""
    table, r = edit_prints.dwell(), random.Random(4)
    texts = ["".join(r.choice("abc é日") for _ in range(n)) for n in (1, 2, 5, 40, 300, 7, 0, 40)]
    for text, got in zip(texts, edit_prints.prints(texts), strict=True):
        ends, t = [], 0
        for c in text:
            kind = (ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> 26
            t += int(table[kind * edit_prints.PERIOD + t % edit_prints.PERIOD])
            ends.append(t)
        bits = 0
        for k in range(edit_prints.BITS):
            bits <<= 1
            if text:
                at = max(x for x in edit_prints.records()[k].tolist() if x < t)
                c = next(c for c, e in zip(text, ends, strict=True) if e > at)
                lane = (k * 0x9E3779B97F4A7C15) & (2**64 - 1)
                bits |= int(shingles.mix(np.array([ord(c) ^ lane], np.uint64))[0]) & 1
        assert int(got, 16) == bits


def test_prints_near_and_far(spark, docs):
    texts = [r.text for r in docs.collect() if len(r.text) > 1000][:20]
    r = random.Random(1)
    for a, b in zip(texts, texts[1:], strict=False):
        if a == b:
            continue
        t = list(a)
        for _ in range(3):
            t.insert(r.randrange(len(t)), "q")
        x, y, z = edit_prints.prints([a, "".join(t), b])
        assert edit_prints.likeness(x, y) > 0.6 > 0.4 > edit_prints.likeness(x, z)
    printed = edit_prints.fingerprints(spark.createDataFrame([(0, texts[0]), (1, texts[0][:-5]), (2, texts[1]), (3, texts[0])], "doc_id long, text string"))
    assert printed.where("doc_id in (0, 3)").select("fingerprint").distinct().count() == 1
    assert edit_prints.near(printed, 0.8).count() == 1


def test_near_groups(spark, edge, none, monkeypatch):
    """Buckets of any size against all pairs; with small bounds the leaders and blocks of large buckets are met."""
    monkeypatch.setattr(edit_prints, "SMALL", 3)
    monkeypatch.setattr(edit_prints, "BLOCK", 8)
    r = random.Random(7)
    base = [f"{r.getrandbits(edit_prints.BITS):0{edit_prints.BITS // 4}x}" for _ in range(4)]
    found = list(base)
    for k in range(120):
        # A chain away from the first one, so that leaders leave some open; and near copies of the others.
        x = int(found[-1] if k % 2 else base[1 + k % 3], 16)
        for _ in range(4):
            x ^= 1 << r.randrange(edit_prints.BITS)
        found.append(f"{x:0{edit_prints.BITS // 4}x}")
    root = {f: f for f in found}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(found):
        for b in found[:i]:
            if edit_prints.likeness(a, b) >= 0.9:
                root[top(a)] = top(b)
    links = edit_prints.near(spark.createDataFrame([(k, f) for k, f in enumerate(found)], "doc_id long, fingerprint string"), 0.9).collect()
    assert all(x.a < x.b and x.likeness == edit_prints.likeness(x.a, x.b) >= 0.9 for x in links)
    mine = {f: f for f in found}
    for x in links:
        old, new = mine[x.a], mine[x.b]
        mine = {f: new if v == old else v for f, v in mine.items()}
    for a in found:
        for b in found:
            assert (top(a) == top(b)) == (mine[a] == mine[b])
    got = edit_prints.near_groups(edge).collect()
    assert len(got) == edge.count() and edit_prints.near_groups(none).count() == 0
    assert {x.component_id for x in got if x.doc_id in (5, 6)} == {5} and {x.component_id for x in got if x.doc_id in (0, 1)} == {0, 1}


def test_long_texts_in_pieces(monkeypatch):
    """Pieces of one very long text give the same words and ids as the whole."""
    import public_tokenizers

    text = " ".join(f"Word{k % 97} l'eau, é{k}\tend" for k in range(300)) + " " + "z" * 500
    data = np.frombuffer(text.encode(), np.uint8)
    whole = shingles.one_set(text, 5), packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    offsets = np.array([0, len(data)])
    ids = next(whole[1].encode(data, offsets))
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 64)
    monkeypatch.setattr(packing, "CHUNK_BYTES", 64)
    for module in (shingles, packing):
        monkeypatch.setattr(module, "pieces", lambda d: pieces(d, 64))
    assert b"".join(p.tobytes() for p in pieces(data, 64)) == data.tobytes() and sum(1 for _ in pieces(data, 64)) > 50
    assert np.array_equal(shingles.one_set(text, 5), whole[0]) and np.array_equal(next(whole[1].encode(data, offsets)), ids)


def test_edited_prints(spark, edge, none):
    texts = {9: "abcdefghi", 7: "XY", 4: "", 2: "long text of many words here", 1: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in edit_prints.edited_prints(df).collect()}
    assert set(got) == set(texts)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        a, b, c = edit_prints.prints([own, edited, after])
        assert (got[i].n_chars, got[i].edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (a, b) and (got[i].near_edited, got[i].near_next) == (edit_prints.likeness(a, b), edit_prints.likeness(a, c))
    assert edit_prints.edited_prints(edge).count() == edge.count() and edit_prints.edited_prints(none).count() == 0
    one = edit_prints.edited_prints(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest()
