"""Column expressions over text. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a query's subject, and those that say nothing about a concept.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "for", "of", "in", "to", "and", "or", "on", "at", "by", "with", "from", "that", "this", "how",
    "what", "which", "do", "does", "should", "must", "can", "could", "would", "not", "no", "its", "their", "they", "it", "as",
)
CONCEPT_STOP_WORDS = ("the", "and", "of", "for", "to", "in", "a", "an")


def tokens(text: Column, wide: bool = False) -> Column:
    """Lower-case words between white space, punctuation kept; ``wide``: also at no-break and other Unicode spaces."""
    return F.array_remove(F.split(F.lower(text), r"(?U)\s+" if wide else r"\s+"), "")


def without(words: Column, stop: tuple[str, ...]) -> Column:
    """Distinct words that aren't in ``stop``."""
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]))


def overlap(a: Column, b: Column) -> Column:
    """How many distinct words two arrays share."""
    return F.size(F.array_intersect(a, b))


def micro(value: Column) -> Column:
    """Millionths, halves up, as a whole number: the same in engines that round differently."""
    return F.floor(value * F.lit(1e6) + F.lit(0.5)).cast("long")


def rounded(value: Column, digits: int = 2) -> Column:
    """The decimal of so many places nearest to a double's exact value, of two equally near the even one, as a double.

    ``round`` goes by the shortest decimal that stands for the double, and takes halves up: 2.675, which is a little less
    than that, would become 2.68. Here the product with the power of ten is taken with its error. Values whose product
    is 2^52 or more stay as they are; null, infinite and undefined ones too.
    """
    scale = float(10**digits)
    product, spread = value * F.lit(scale), value * F.lit(float(2**27 + 1))
    high = spread - (spread - value)
    error = (high * F.lit(scale) - product) + (value - high) * F.lit(scale)
    low = F.floor(product).cast("double")
    past_half = product - low - F.lit(0.5)
    # The error is less than any difference from a half that isn't none.
    up = (past_half > 0) | ((past_half == 0) & ((error > 0) | ((error == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
    return F.when(F.abs(product) < F.lit(float(2**52)), (low + up.cast("double")) / F.lit(scale)).otherwise(value)


def occurrences(text: Column, part: Column) -> Column:
    """How often a part occurs in a text, without overlaps; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def long_words(query: Column, longer_than: int = 3) -> Column:
    """Distinct words of a query that are longer than that."""
    return F.filter(F.array_distinct(tokens(query)), lambda w: F.length(w) > longer_than)


def refs(text: Column, pattern: str, group: int = 1) -> Column:
    """Sorted distinct matches of a pattern's group."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(" \n\t\r\f\x0b"))


def first_match(text: Column, pattern: str, group: int = 1, default: str | None = None) -> Column:
    """The group of the first match, or a default (or null)."""
    found = F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))
    return found if default is None else F.coalesce(found, F.lit(default))


def doc_id_of(filename: Column) -> Column:
    return F.replace(F.replace(filename, F.lit(".pdf"), F.lit("")), F.lit(" "), F.lit("_"))


def display_name(kind: Column, section: Column, prefixes: dict[str, str]) -> Column:
    """A kind's prefix and the section; a kind without prefix leaves the blank before the section."""
    known = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    return F.concat(F.coalesce(known[kind], F.lit("")), F.lit(" "), section)


def chapter(section: Column) -> Column:
    return F.substring_index(section, ".", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def numbered(prefix: Column, number: Column, width: int) -> Column:
    return F.format_string(f"%s_%0{width}d", prefix, number)


def page_range(first: Column, last: Column) -> Column:
    return F.concat(F.coalesce(first.cast("string"), F.lit("?")), F.lit("-"), F.coalesce(last.cast("string"), F.lit("?")))


def weighted_section(title: Column, summary: Column, times: int = 3) -> Column:
    return F.concat_ws(" ", *[title] * times, F.coalesce(summary, F.lit("")))


def snippet(query: Column, title: Column, summary: Column, radius: int = 80) -> Column:
    """The title if it holds the query (or nothing does), else the summary around the query's first occurrence."""
    title, summary = F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))
    at = F.instr(F.lower(summary), F.lower(query))
    start = F.greatest(at - 1 - radius, F.lit(0))
    around = F.substring(summary, start + 1, at - 1 + F.length(query) + radius - start)
    return strip(F.when(F.contains(F.lower(title), F.lower(query)), title).when(at > 0, around).otherwise(title))


def slug(text: Column, words: int = 4) -> Column:
    return F.array_join(F.slice(tokens(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")), 1, words), "_")


def unfenced(reply: Column) -> Column:
    """A model's reply without the code fences around its JSON."""
    return strip(F.regexp_replace(reply, r"```(?:json)?", ""))


def ordered_case(cases: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first condition that holds."""
    return reduce(lambda rest, c: F.when(c[1], F.lit(c[0])).otherwise(rest), reversed(cases), F.lit(default))
