"""Language ID by rank-order profiles: out-of-place distance between n-gram rankings.

A profile is the ranking of the most frequent 1- to 3-grams of a language. A text's own ranking of its most
frequent n-grams is held against each profile: every n-gram adds the difference of its two ranks, or the
profile's length where the profile lacks it. The language with the smallest sum is the prediction.

N-grams are taken over lower-case letters; whatever lies between letters is one boundary. Ties in frequency
go to the smaller code, so a ranking is a function of the text alone; ties in distance go to the language that
sorts first.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; languages that are null teach
nothing; without any profile every text is ``und``. Any number of languages can be learnt; each has a profile of some
kB that goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, lean, texts

#: N-grams in a ranking; longest n-gram; sums by language and n-gram that a task holds before it gives them on.
RANKS = 400
LONGEST = 3
MOST_SUMS = 2_000_000
UNDETERMINED = "und"
#: For the least scores: quantiles of own scores and of shuffled texts, the score that is asked for in any case, and
#: the steps from 0 to 1 that scores are counted by, which bound the counts.
LOW = 0.01
HIGH = 0.95
LEAST = 0.02
STEPS = 1_000_000
#: Stands for what lies between letters; not 0, so that n-grams of different lengths have different codes.
BOUNDARY = 1
_BITS = 21  # a code point's bits; three make a code of 63


@cache
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray | None:
    """Codes of all n-grams of a text that hold a letter; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, BOUNDARY).astype(np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    points = np.concatenate(([BOUNDARY], points[keep]))
    if points[-1] != BOUNDARY:
        points = np.append(points, BOUNDARY)
    found, codes = [points[points != BOUNDARY]], points
    for _ in range(1, LONGEST):
        codes = (codes[:-1] << _BITS) | points[len(points) - len(codes) + 1 :]
        found.append(codes)
    return np.concatenate(found)


def ranking(text: str, ranks: int = RANKS) -> np.ndarray | None:
    """The codes of the most frequent n-grams, most frequent first."""
    codes = grams(text)
    if codes is None:
        return None
    codes, counts = np.unique(codes, return_counts=True)
    if len(codes) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")][:ranks]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by language and n-gram over what the task reads, in parts of a bounded number."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": codes, "n": counts.astype(np.int64)})
        sums.clear()

    for batch in slices(batches):
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(texts(batch, "text"), batch.column("lang").to_pylist(), strict=True):
            if (codes := grams(text)) is not None:
                by.setdefault(lang, []).append(codes)
        for lang, found in by.items():
            codes, counts = np.unique(np.concatenate(found), return_counts=True)
            if lang in sums:
                both = np.concatenate([sums[lang][0], codes])
                codes, where = np.unique(both, return_inverse=True)
                counts = np.bincount(where, np.concatenate([sums[lang][1], counts])).astype(np.int64)
            sums[lang] = codes, counts
        if sum(len(codes) for codes, _ in sums.values()) > MOST_SUMS:
            yield from given()
    yield from given()


def fold(docs: DataFrame) -> DataFrame:
    """All documents outside the held-out fold that have a text and a language."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(True)))


def learn(docs: DataFrame, ranks: int = RANKS) -> dict[str, np.ndarray]:
    """Profiles (``ranks`` codes each) from all documents outside the held-out fold."""
    counted = (
        fold(docs).select("text", "lang")
        .mapInArrow(lean(count_grams), "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= ranks)
    profiles: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(codes, np.int64) for lang, codes in sorted(profiles.items())}


class Ranked:
    """The profiles as one sorted table of codes with the languages that have them, for all distances at once."""

    def __init__(self, profiles: dict[str, np.ndarray], ranks: int = RANKS):
        self.langs, self.ranks = list(profiles), ranks
        codes = np.concatenate([np.zeros(0, np.int64), *profiles.values()])
        langs = np.repeat(np.arange(len(self.langs)), [len(p) for p in profiles.values()])
        places = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(p)) for p in profiles.values()]])
        order = np.argsort(codes, kind="stable")
        self.codes, begins = np.unique(codes[order], return_index=True)
        self.tops = np.append(begins, len(codes))
        self.entries, self.places = langs[order].astype(np.int32), places[order].astype(np.int32)

    def distances(self, own: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(self.langs), len(own) * self.ranks)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = np.flatnonzero(self.codes[at] == own)
        counts = self.tops[at[known] + 1] - self.tops[at[known]]
        rank = np.repeat(known, counts)
        entry = np.arange(len(rank)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.tops[at[known]], counts)
        # Every n-gram that a profile has adds its difference instead of the profile's length.
        less = self.ranks - np.abs(self.places[entry] - rank)
        return len(own) * self.ranks - np.bincount(self.entries[entry], less, len(self.langs)).astype(np.int64)

    def predict(self, text: str) -> tuple[str, float]:
        """A language and the share of the largest possible distance that the text stays below."""
        own = ranking(text, self.ranks) if self.langs else None
        if own is None:
            return UNDETERMINED, 0.0
        d = self.distances(own)
        best = int(np.argmin(d))
        return self.langs[best], float(1 - d[best] / (self.ranks * len(own)))


def predictor(profiles: dict[str, np.ndarray], keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Ranked(profiles)
        for batch in batches:
            found = [ranked.predict(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keep} | {"lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(predictor(profiles, ("doc_id",))), f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """``identify`` by profiles learnt outside the held-out fold, with that fold as ``held_out``."""
    out = identify(docs, learn(docs))
    return out.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in runs of a few rows, so that a worker holds few texts at a time; its free memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def junk_of(text: str) -> str:
    """The letters and signs of a text in another order: what has a language's letters, but isn't of it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.random.default_rng(len(text)).permutation(points).tobytes().decode("utf-32-le", "surrogatepass")


def least_scores(docs: DataFrame, profiles: dict[str, np.ndarray]) -> dict[str, float]:
    """By predicted language, the score that a text of it has to reach: a high quantile of what all documents outside
    the held-out fold score with their letters shuffled, but no more than a low quantile of their own scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Ranked(profiles)
        for batch in slices(batches):
            found = []
            for text in texts(batch, "text"):
                lang, score = ranked.predict(text)
                own = ranking(junk_of(text), ranked.ranks) if lang != UNDETERMINED else None
                if own is not None:
                    found.append((lang, score, float(1 - ranked.distances(own)[ranked.langs.index(lang)] / (ranked.ranks * len(own)))))
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "score", "junk"), x, strict=True)) for x in found], pa.schema([("lang", pa.string()), ("score", pa.float64()), ("junk", pa.float64())]))

    if not profiles:
        return {}
    scores = fold(docs).select("text").mapInArrow(lean(run), "lang string, score double, junk double")
    # Scores are counted by steps, so that a language's counts are bounded, however many documents it has.
    each = scores.select("lang", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.floor(F.col(c) * STEPS).alias("step")) for c in ("score", "junk")])).alias("x"))
    counts = each.groupBy("lang", "x.what", "x.step").agg(F.count("*").alias("n"))
    quantile = lambda what, q: (F.percentile(F.when(F.col("what") == what, F.col("step")), F.lit(q), F.col("n")) / STEPS).alias(what)
    rows_ = counts.groupBy("lang").agg(quantile("score", LOW), quantile("junk", HIGH)).collect()
    return {r["lang"]: max(LEAST, min(r["score"], r["junk"])) for r in rows_}


def keep_known(docs: DataFrame, profiles: dict[str, np.ndarray], least: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` in a language of the profiles; texts without letters, and those that score below what
    texts of the language predicted for them reach (``least_scores``), go."""
    bounds = least_scores(docs, profiles) if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Ranked(profiles)
        for batch in slices(batches):
            found = [ranked.predict(t) for t in texts(batch, "text")]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= bounds.get(lang, LEAST) for lang, score in found], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
