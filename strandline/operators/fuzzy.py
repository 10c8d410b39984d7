"""Linking names that are alike by edit distance, with positional q-grams as join keys.

Two names whose likeness, one less the edit distance over the longer length, reaches ``least`` differ by t edits at
most, t = (1 - least) * longer. Each edit changes two bigrams at most, so they share all but 2 * t of the longer one's. In any
common order of the bigrams the first 2 * t + 1 of one and of the other then have one in common, no further apart in
their names than t. With the rarest first, that is what names are joined by; the edit distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.session import stored

#: What stands before a name's first character.
EDGE = "\x02"


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b))


def edits(length: Column, least: float) -> Column:
    """Edits that a name of a length can be away from one that is alike, which may be the longer one."""
    return F.floor(length * ((1 - least) / least) + 1e-9)


def bigrams(names: DataFrame, name: str) -> DataFrame:
    """(name, gram, place): a name's bigrams from its edge on, those that come again being numbered."""
    both = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(F.concat(F.lit(EDGE), F.col(name)), i, F.lit(2)))
    numbered = F.transform(F.col("g"), lambda x, i: F.struct(F.concat(x, F.size(F.filter(F.slice(F.col("g"), F.lit(1), i), lambda y: y == x)).cast("string")).alias("gram"), i.alias("place")))
    return names.select(F.col(name), both.alias("g")).select(name, F.explode(numbered).alias("x")).select(name, "x.gram", "x.place")


def candidates(mentions: DataFrame, names: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (mention, name) that may be alike, of mentions(mention) and names(name)."""
    if not 0.5 < least <= 1:
        raise ValueError("bigrams tell names apart for a likeness above 0.5")
    sides = []
    for rows, column in ((mentions, "mention"), (names, "name")):
        sides.append(stored(bigrams(rows.select(column).where(F.length(column) > 0).distinct(), column), "bigrams"))
    counts = sides[0].select("gram").union(sides[1].select("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    firsts = []
    for rows, column in zip(sides, ("mention", "name"), strict=True):
        rank = F.row_number().over(Window.partitionBy(column).orderBy("n", "gram"))
        some = rows.join(counts, "gram").withColumn("r", rank).where(F.col("r") <= 2 * edits(F.length(column), least) + 1)
        firsts.append(some.select(column, "gram", F.col("place").alias(f"{column}_place")))
    a, b = F.length("mention"), F.length("name")
    longer = F.greatest(a, b)
    apart = F.floor(longer * (1 - least) + 1e-9)
    near = (F.abs(a - b) <= apart) & (F.abs(F.col("mention_place") - F.col("name_place")) <= apart)
    return firsts[0].join(firsts[1], "gram").where(near).select("mention", "name").distinct()


def link(mentions: DataFrame, names: DataFrame, least: float = 0.8) -> DataFrame:
    """(mention, name, score) of all pairs with a likeness of ``least`` or more. Empty names are like nothing."""
    score = likeness(F.col("mention"), F.col("name"))
    return candidates(mentions, names, least).select("mention", "name", score.alias("score")).where(F.col("score") >= least - 1e-12)
