"""The filter audit, repeats of words and the trie of conversations against brute force, on small and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import conversation_trie, filter_audit, substring_dedup
from strandline.llm.entries import op13_conversation_trie

EXTRA = "score double, n long, path string, key string, copy boolean, salt int, firsts string, mask int, part string, state int, node string"
MORE = (0.5, 1, "p", "k", True, 3, "f", 7, "q", 2, "n")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, parts=3):
    """Documents (doc_id, text, lang), with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, *MORE) for r in rows], f"doc_id long, text string, lang string, {EXTRA}").repartition(parts)


# The filter audit.


def failures(rows):
    """By row the letters of the filters that it fails."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])
        out.append({c for c, failed in zip("ABCDE", tests, strict=True) if failed})
    return out


def plain_audit(rows, good, toxic):
    fails, out, shapley = failures(rows), {}, Counter()
    parts = {lang or "" for _, _, lang in rows}
    for part in parts:
        own = [(f, r[0]) for f, r in zip(fails, rows, strict=True) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                removed = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                failing = sum(c in f for f, _ in own)
                out[part, order, step] = [len(left), len(removed), failing - len(removed), sum(f == {c} for f, _ in own), sum(i in good for _, i in removed), sum(i in toxic for _, i in removed)]
                shapley[part, c] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    out = filter_audit.audit_texts(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}


def test_audit_by_hand(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["NASA", "ÄÖ", "a#b", "日本"]
    texts = [None, "", " \t\n", "AB\x0bAB\x1cAB", " ".join(f"v{k}" for k in range(120)), "x " * 200_000]
    texts += [" ".join(r.choices(words, k=r.choice((3, 99, 100, 101, 130)))) for _ in range(40)]
    rows = [(k, texts[k % len(texts)], r.choice(("en", "de", None, ""))) for k in range(120)]
    rows += [rows[7], rows[7], (None, texts[4], "en"), (None, None, None), (7, "another text of the same id", "en")]
    labels = [(k, r.choice((0, 1, None)), r.choice((0, 1, None))) for k in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    assert audited(spark, rows, labels) == plain_audit(rows, good, toxic)
    assert audited(spark, [], labels) == {} and len(audited(spark, rows[:1], [])) == 600


def test_paths_count_all_orders():
    for n in (1, 3, 5):
        edges = filter_audit.paths(n)
        assert len(edges) == n * 2 ** (n - 1)
        for size in range(n):
            assert sum(w for s, _, w in edges if bin(s).count("1") == size) == len(list(permutations(range(n))))


def test_audit_of_other_filters(spark):
    """Any conditions and marks, here of three filters over numbers."""
    rows = spark.range(60).select("id", (F.col("id") % 7 == 0).alias("rare"))
    out = filter_audit.audit(rows, {"x": F.col("id") % 2 == 0, "y": F.col("id") % 3 == 0, "z": F.lit(None).cast("boolean")}, F.lit("all"), ("rare",))
    got = {(r.filter_order, r.step): r for r in out.collect()}
    assert len(got) == 18 and (got["xyz", 1].removed, got["xyz", 2].removed, got["xyz", 2].redundant, got["yxz", 1].rare_lost) == (30, 10, 10, 3)
    assert got["xyz", 1].shapley == 3 * 30 + 3 * 20 and got["zxy", 1].shapley == 0


# Repeats.


def plain_repeats(rows, least):
    """(n_words, removed places, kept text) by row; rows without doc_id come last, those of one doc_id don't count as earlier."""
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    rank = [(i is None, i or 0) for i, *_ in rows]
    first = {}
    for w, k in zip(words, rank, strict=True):
        for s in range(len(w) - least + 1):
            key = tuple(w[s : s + least])
            first[key] = min(first.get(key, k), k)
    out = []
    for w, k in zip(words, rank, strict=True):
        gone, seen = set(), set()
        for s in range(len(w) - least + 1):
            key = tuple(w[s : s + least])
            if first[key] < k or key in seen:
                gone.update(range(s, s + least))
            seen.add(key)
        out.append((len(w), sorted(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def repeated(spark, rows, least, parts=3):
    out = substring_dedup.repeats(documents(spark, rows, parts), least)
    found = [(r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.stop)], r.kept, r.n) for r in out.select("*", substring_dedup.removed().alias("n")).collect()]
    assert all(len(p) == n for _, _, p, _, n in found)
    return sorted(((i, n, p, k) for i, n, p, k, _ in found), key=str)


def made_documents(seed, least):
    """Few different words, shared passages cut and joined in many ways, runs of one word, copies, white space of all kinds."""
    r = random.Random(seed)
    draw = lambda n, v: [f"{'Ww'[r.random() < 0.5]}{r.randrange(v)}" for _ in range(n)]
    shared = [draw(r.randrange(least // 2, 4 * least), 50) for _ in range(12)] + [["to"] * (3 * least), ["ab", "cd"] * (2 * least)]
    rows = []
    for k in range(90):
        parts = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(shared)
            a = r.randrange(len(p))
            parts += p[a : a + r.randrange(1, 3 * least)] if r.random() < 0.7 else draw(r.randrange(least), 4 if r.random() < 0.3 else 3000)
        rows.append((r.randrange(1000) if k % 9 else k, r.choice((" ", "\n", "\t ", "\x0b")).join(parts), None))
    return rows + [rows[3], (2000, rows[5][1], "en"), (rows[6][0], rows[8][1], "en"), (None, rows[9][1], "en"), (None, rows[9][1], "de"), (None, " ".join(draw(40, 9000) * 2), "de"), (2001, None, None), (2002, "", None), (2003, " \t", None), (2004, "a b é b", None)]


@pytest.mark.parametrize("least", [2, 5, 20])
def test_repeats_by_hand(spark, monkeypatch, least):
    rows = made_documents(least, least)
    wanted = sorted(((r[0], *x) for r, x in zip(rows, plain_repeats(rows, least), strict=True)), key=str)
    assert repeated(spark, rows, least) == wanted
    assert sum(len(x[2]) for x in wanted) > 30 * least


def test_repeats_in_slices(monkeypatch):
    """Runs that are cut where a slice ends, by the functions of one task alone."""
    monkeypatch.setattr(substring_dedup, "SLICE", 37)
    r = np.random.default_rng(3)
    words = r.integers(0, 6, 900).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = np.concatenate([w for _, w, *_ in substring_dedup.slices(words, 20, 8)])
    assert len(whole) == 881 and (whole == substring_dedup.spans_hash(words, 20)).all()
    monkeypatch.setattr(substring_dedup, "SLICE", 1 << 18)
    (_, _, runs, anchors, content) = next(iter(substring_dedup.slices(words, 20, 8)))
    assert len(anchors) == len(content) == runs[-1] + 1 and np.bincount(runs).max() <= 13


def test_repeats_edges(spark):
    assert repeated(spark, [], 20) == []
    long = " ".join(f"u{k}" for k in range(300_000))
    rows = [(5, long, "en"), (9, "tail " + long + " end", "en"), (1, "x" * 400_000, None)]
    out = {i: (n, len(p), k) for i, n, p, k in repeated(spark, rows, 20, 2)}
    assert out[5][:2] == (300_000, 0) and out[9] == (300_002, 300_000, "tail end") and out[1][:2] == (1, 0)


def test_repeats_of_a_hot_passage(spark):
    """Copies of one text, and one passage in many different ones: each first place stays, and nothing else."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage} own{k} more{k}" if k % 2 else passage, "en") for k in range(400)]
    out = {i: (n, len(p)) for i, n, p, _ in repeated(spark, rows, 20)}
    assert out[0] == (60, 0) and all(out[k] == ((62, 60) if k % 2 else (60, 60)) for k in range(1, 400))


# The trie.


def plain_trie(rows):
    """Nodes from (conv_id, turn, role, text), by a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    built = {c: own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[: h[c]] + own[c][h[c] :] for c in own}
    members, kids = defaultdict(list), defaultdict(set)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                kids[tuple(path[: d - 1])].add(tuple(path[:d]))
    out = []
    for node in sorted(members, key=len, reverse=True):
        under = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in members[node] if len(built[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), sum(not kids[x] for x in under), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def spark_trie(spark, rows):
    table = spark.createDataFrame([(*r, *MORE) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}").repartition(3)
    out = conversation_trie.trie(conversation_trie.paths(conversation_trie.borrowed(conversation_trie.turns(table))))
    return sorted((tuple(r)[:8] for r in out.collect()), key=str)


def made_conversations(seed, n=150):
    r = random.Random(seed)
    hello, rows = ("user", "hello"), []
    for c in range(-12, n):
        if c % 11 == 3:
            continue
        path = [hello] if r.random() < 0.6 else []
        path += [(r.choice(("user", "assistant", None)), r.choice(("a", "b", "ü", "", None, f"own {c}"))) for _ in range(r.randrange(1, 14))]
        if c % 6 == 0:
            path = [hello, ("assistant", "yes"), ("user", "bye")] * 4
        rows += [(c, turn if turn else None, *t) for turn, t in enumerate(path)]
    return rows + rows[5:9] + [(None, 0, "user", "nobody"), (10**12, None, None, None), (10**12, None, "user", "x"), (10**12, 3, "user", "x"), (10**12, 3, "assistant", "x")]


@pytest.mark.parametrize("turns", [100_000, 40, 3])
def test_trie_by_hand(spark, monkeypatch, turns):
    """Shards of all sizes: in small ones upper nodes reach down to whole conversations."""
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", turns)
    rows = made_conversations(turns)
    assert spark_trie(spark, rows) == plain_trie(rows)


def test_trie_edges(spark):
    assert spark_trie(spark, []) == [] and spark_trie(spark, [(None, 1, "user", "x")]) == []
    # Conversation 3 borrows from 0, which isn't there, more turns than it has: it is a member of the root alone.
    few = [c for c in range(1, 40) if zlib.crc32(str(c).encode()) % 9 > 1 and c % 5][:1]
    assert spark_trie(spark, [(few[0], 0, "user", "x")]) == [(few[0], 0, None, 1, 0, 1, 0, hashlib.sha256(str(few[0]).encode()).hexdigest())]


def test_members_over_many_chunks(spark):
    """The digest of many equal conversations is that of all their ids in order."""
    rows = [(c, 0, "user", "same") for c in range(0, 60_000, 5)]
    out = {r[1]: r for r in spark_trie(spark, rows)}
    ids = [c for c in range(0, 60_000, 5)]
    assert out[1][3] == len(ids) and out[1][7] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and out[1][6] == 4 * (len(ids) - 1)


def test_double_array_holds_its_rows():
    r = random.Random(8)
    for _ in range(30):
        rows = sorted({tuple(r.randrange(1, 60) for _ in range(r.randrange(0, 7))) for _ in range(r.randrange(1, 200))})
        base, check, made = conversation_trie.pack([np.array(x, np.int64) for x in rows])
        slots = [s for s, *_ in made]
        assert len(slots) == len(set(slots)) == len({x[:d] for x in rows for d in range(len(x) + 1)})
        for x in rows:
            assert len(conversation_trie.walk(base, check, np.array(x, np.int64))) == len(x) + 1
        prefixes = {x[:d] for x in rows for d in range(len(x) + 1)}
        for _ in range(50):
            x = tuple(r.randrange(1, 62) for _ in range(5))
            known = max(d for d in range(6) if x[:d] in prefixes)
            assert len(conversation_trie.walk(base, check, np.array(x, np.int64))) == known + 1


def test_trie_query(spark, sf):
    got = sorted((tuple(r) for r in op13_conversation_trie(spark, sf).collect()), key=str)
    assert got == plain_trie([(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()])
