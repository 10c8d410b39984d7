"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text and normalised by length.

The lexicon is learnt from labelled documents: words and word stems that far more toxic documents hold than clean
ones get the log of that ratio as weight. Texts and lexicon go through the same folding (compatibility forms,
struck and look-alike letters, digits and signs for letters), which keeps positions, so that matches are held
against the word boundaries of the unfolded text. Matches inside exception phrases don't count: a few are given,
others are learnt, as pairs of a matched word and its neighbour that toxic documents hold no more often than clean
ones. What is left is divided by the length in words and calibrated by a logistic curve.

The labelled rows to learn from are bounded (``rows``); nothing else is. Everything learnt from them is therefore
bounded too: entries need several toxic documents each.

Defined cases: null and empty texts, and texts without words, have density 0 and thus the score of a clean
text; labels that are null or without a document teach nothing; of several labels of one document the
largest holds; without any toxic label every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash63, lean, materialise, texts
from .shingles import batch_sets

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ї": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t",
    "в": "b", "н": "h", "г": "r", "п": "n", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "i", "ь": "b", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i",
    "κ": "k", "ν": "v", "τ": "t", "β": "b", "η": "n", "χ": "x", "γ": "y", "σ": "o", "ω": "w", "ϲ": "c", "ϳ": "j", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "հ": "h", "ա": "w",
}
DISGUISED = re.compile(r"LATIN (?:SMALL LETTER ([A-Z]) WITH (?:STROKE|MIDDLE TILDE|PALATAL HOOK|RETROFLEX HOOK)|LETTER SMALL CAPITAL ([A-Z]))")
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
#: Struck, hooked and small-capital Latin letters by their names in the Unicode tables; accents tell words apart and stay.
NAMES = {chr(i): (m[1] or m[2]).lower() for i in range(0x80, 0x3000) if (m := DISGUISED.fullmatch(unicodedata.name(chr(i), "")))}
FOLD = str.maketrans(NAMES | LOOK_ALIKES | STAND_INS)
HIDDEN = re.compile("[­​-‍⁠﻿]")
WORD = re.compile(r"\S+")
# Phrases in which a word of abuse is none.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "idiot proof", "stupid mistake")

#: Documented bound: labelled rows to learn from (in expectation). Lengths of stems.
FIT_ROWS = 20_000
STEMS = (4, 9)
#: What an entry needs: toxic documents that hold it, how much more frequent it is in toxic ones, log-likelihood ratio.
SUPPORT = 5
RATE = 6
EVIDENCE = 15
#: What a learnt exception phrase needs: clean documents that hold it, and a rate in toxic ones of at most that in clean ones.
CLEAN_SUPPORT = 3


def base(text: str) -> str:
    """Lower case, compatibility forms, without hidden characters, one space for any white space: what word boundaries
    and phrases are taken from."""
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return " ".join(text.lower().split())


def fold(plain: str) -> str:
    """As long as ``plain``, so that positions agree."""
    return plain.translate(FOLD)


def words(plain: str) -> list[str]:
    """The folded words, without signs around them."""
    return [w for w in (fold(x.strip(".,;:!?\"'()[]{}*#%&$@|<>-_/\\+=~^")) for x in plain.split()) if w]


@dataclass(frozen=True)
class Lexicon:
    """Entries (folded): weight and whether the entry is a stem; exception phrases; the curve's slope and offset."""

    entries: dict[str, tuple[float, bool]]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, (weight, stem) in self.entries.items():
            found.add_word(entry, (len(entry), weight, stem, False))
        for phrase in self.exceptions:
            found.add_word(key := fold(base(phrase)), (len(key), 0.0, False, True))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matches(plain: str, found: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of the matches that no exception phrase holds. After sorting, one sweep: of the phrases
    that begin at or before a match only the furthest end matters."""
    hits, spared = [], []
    for end, (size, weight, stem, phrase) in found.iter(fold(plain)) if found is not None else ():
        start, after = end - size + 1, end + 1
        if start and plain[start - 1].isalpha() or not stem and after < len(plain) and plain[after].isalpha():
            continue
        (spared if phrase else hits).append((start, end, weight))
    if not spared:
        return hits
    spared.sort()
    out, k, reach = [], 0, -1
    for hit in sorted(hits):
        while k < len(spared) and spared[k][0] <= hit[0]:
            reach = max(reach, spared[k][1])
            k += 1
        if hit[1] > reach:
            out.append(hit)
    return out


def density(text: str, found: ahocorasick.Automaton | None) -> tuple[float, int, int]:
    """Sum of the weights of the matches over the words (20 at least), matches, words."""
    plain = base(text)
    n = len(plain.split())
    hits = matches(plain, found) if n else []
    return sum(h[2] for h in hits) / max(n, 20), len(hits), n


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most about ``rows`` labelled documents outside the held-out fold, as a table.

    The sample is a slice of the hash of doc_id, and so the same for any layout of the tables. Its ids are
    broadcast if they are as few as that makes them. Of documents with one label and one least shingle of three
    words (copies, and most near copies) the first teaches for all: what a text repeats in a thousand copies is no
    more evidence than the text itself.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n = known.count()
    part = min(1.0, rows / max(n, 1))
    known = materialise(known.where(hash63(F.lit("toxicity"), F.col("doc_id").cast("string")) < F.lit(int(part * 2**60))), "labelled")
    small = known.count() <= 4 * rows
    found = docs.select("doc_id", "text").join(F.broadcast(known) if small else known, "doc_id")
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, toxic int, least long"
    found = materialise(found.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(lean(with_least), kinds), "train")
    first = found.groupBy("least", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return found.join(F.broadcast(first) if small else first, "doc_id", "left_semi").drop("least")


def with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle of three words."""
    for batch in batches:
        found = [int(s.view(np.int64).min()) if len(s) else 0 for _, s in batch_sets(batch, 3)]
        yield batch.append_column("least", pa.array(found, pa.int64()))


def counter(terms_of):
    """A mapInArrow function: how many toxic and clean documents of a task hold each of the terms of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = terms_of()
        counts: tuple[Counter, Counter] = Counter(), Counter()
        seen = [0, 0]
        for batch in batches:
            for text, label in zip(texts(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
                counts[label > 0].update(find(text))
                seen[label > 0] += 1
        keys = list(counts[0].keys() | counts[1].keys())
        # The empty term counts the documents themselves.
        yield pa.RecordBatch.from_pydict({"term": ["", *keys], "toxic": pa.array([seen[1], *[counts[1][k] for k in keys]], pa.int64()), "clean": pa.array([seen[0], *[counts[0][k] for k in keys]], pa.int64())})

    return run


def counted(train: DataFrame, terms_of) -> DataFrame:
    """(term, toxic, clean): documents by term."""
    found = train.select("text", "toxic").mapInArrow(lean(counter(terms_of)), "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def words_and_stems():
    """Of a text its distinct words, and their stems marked by a star."""

    def find(text: str) -> set[str]:
        own = set(words(base(text)))
        return own | {w[:n] + "*" for w in own for n in range(STEMS[0], min(STEMS[1], len(w) - 1) + 1)}

    return find


def pairs_with(lexicon: Lexicon):
    """Of a text the distinct pairs of a word that holds a match and the word before or after it."""

    def make():
        found = lexicon.automaton()

        def find(text: str) -> set[str]:
            plain = base(text)
            hits, out = {h[0] for h in matches(plain, found)}, set()
            if hits:
                spans = [(m.start(), m.end()) for m in WORD.finditer(plain)]
                starts = [a for a, _ in spans]
                for k in {bisect_right(starts, h) - 1 for h in hits}:
                    for a, b in ((k - 1, k), (k, k + 1)):
                        if 0 <= a and b < len(spans):
                            out.add(" ".join(words(plain[spans[a][0] : spans[b][1]])))
            return {p for p in out if " " in p}

        return find

    return make


def choose(rows: list, n_toxic: int, n_clean: int) -> dict[str, tuple[float, bool]]:
    """Entries in order of evidence; none begins with another, as the stem stands for its words."""
    entries: dict[str, tuple[float, bool]] = {}
    begins: set[str] = set()
    for r in sorted(rows, key=lambda r: (-r["evidence"], -len(r["term"]), r["term"])):
        term = r["term"].removesuffix("*")
        own = [term[:k] for k in range(1, len(term) + 1)]
        if term in begins or any(p in entries for p in own):
            continue
        weight = math.log(((r["toxic"] + 0.5) / (n_toxic + 1)) / ((r["clean"] + 0.5) / (n_clean + 1)))
        entries[term] = (weight, r["term"] != term)
        begins.update(own)
    return entries


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve of largest likelihood, a little drawn to 0, by Newton steps."""
    X, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        grad = X.T @ (p - y) + 1e-3 * w
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2), grad)
        w -= np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """The lexicon and its curve. Terms are counted where the texts are; those that tell reach the driver: as each of
    them needs ``SUPPORT`` toxic documents, they are bounded by the sample."""
    train = labelled(docs, labels, rows)
    counts = materialise(counted(train, words_and_stems), "terms")
    n = counts.where("term = ''").first()
    n_toxic, n_clean = (n["toxic"], n["clean"]) if n else (0, 0)
    if not n_toxic:
        return Lexicon({}, slope=0.0, offset=-30.0)
    # Log-likelihood ratio of the two rates: what tells a word of abuse from a word that is rare by chance.
    share, both = n_toxic / (n_toxic + n_clean), F.col("toxic") + F.col("clean")
    g = F.col("toxic") * F.log((F.col("toxic") + 1e-9) / (both * share)) + F.col("clean") * F.log((F.col("clean") + 1e-9) / (both * (1 - share)))
    rate = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / max(n_clean, 1))
    size = F.length(F.rtrim("term", F.lit("*")))
    found = counts.where((size >= 3) & (F.col("toxic") >= SUPPORT) & (rate >= RATE)).withColumn("evidence", g).where(F.col("evidence") >= EVIDENCE).collect()
    raw = Lexicon(choose(found, n_toxic, n_clean))
    mild = counted(train, pairs_with(raw)).where((F.col("term") != "") & (F.col("clean") >= CLEAN_SUPPORT) & (F.col("toxic") * n_clean <= F.col("clean") * n_toxic))
    raw = Lexicon(raw.entries, tuple(sorted({*EXCEPTIONS, *[r["term"] for r in mild.collect()]})))
    seen = train.mapInArrow(scorer(raw, keep=("toxic",)), "toxic int, score double, predicted int, density double, hits long, n_words long").select("toxic", "density").toPandas()
    slope, offset = logistic(seen["density"].to_numpy(), (seen["toxic"] > 0).to_numpy().astype(float))
    return Lexicon(raw.entries, raw.exceptions, slope, offset)


def scorer(lexicon: Lexicon, keep: tuple[str, ...]):
    """A mapInArrow function: the columns ``keep``, score, predicted, density, hits, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon.automaton()
        for batch in batches:
            x = [density(t, found) for t in texts(batch, "text")]
            d = np.array([v[0] for v in x], dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(lexicon.slope * d + lexicon.offset, -30, 30)))
            yield pa.RecordBatch.from_pydict(
                {k: batch.column(k) for k in keep}
                | {"score": p, "predicted": pa.array((p >= 0.5).astype(np.int32)), "density": d, "hits": pa.array([v[1] for v in x], pa.int64()), "n_words": pa.array([v[2] for v in x], pa.int64())}
            )

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from 0.5 on), density, hits, n_words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(scorer(lexicon, ("doc_id",))), f"doc_id {kind}, score double, predicted int, density double, hits long, n_words long")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``score`` by a lexicon learnt from ``labels`` outside the held-out fold, with that fold as ``held_out``."""
    out = score(docs, learn(docs, labels, rows))
    return out.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)))


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, in one pass and without a shuffle."""
    lexicon = learn(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon.automaton()
        for batch in batches:
            z = np.array([lexicon.slope * density(t, found)[0] + lexicon.offset for t in texts(batch, "text")])
            yield batch.filter(pa.array(z < 0))

    return docs.mapInArrow(lean(run), docs.schema)
