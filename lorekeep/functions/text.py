"""Text expressions: index tokens, query terms, age decay, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Operators of the query language (fixed values).
RESERVED = ["OR", "AND", "NOT", "NEAR"]
#: Words that say nothing about what is asked for (fixed values).
STOP_WORDS = (
    "the a an is are was were do does did how what when where why which who whom that this it its in on at to for of with by from as but if so than then "
    "be been being have has had will would could should may can just about also very my your we they he she me us them"
).split()


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters or digits; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)")), F.array().cast("array<string>"))


def query_terms(c: Column, stop_words: bool = False, most: int | None = None) -> Column:
    """Lower-cased ASCII terms of a question without reserved words, repeats kept; perhaps without stop words, and the first ``most`` only."""
    parts = F.split(F.regexp_replace(c, r"[^a-zA-Z0-9\s]", " "), r"\s+")
    drop = [w.lower() for w in RESERVED] + (STOP_WORDS if stop_words else [])
    terms = F.filter(F.transform(parts, F.lower), lambda t: (t != "") & ~t.isin(drop))
    terms = F.coalesce(terms, F.array().cast("array<string>"))
    return F.slice(terms, 1, most) if most else terms


def word_set(c: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters, digits and underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets given as arrays; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def evergreen(path: Column) -> Column:
    """Whether a file doesn't age: its name ends in MEMORY.md or does not begin with a date."""
    return basename(path).endswith("MEMORY.md") | ~basename(path).rlike(r"^\d{4}-\d{2}-\d{2}")


def decay(at: Column, now: int, half_life_days: float = 30.0) -> Column:
    """exp(-ln 2 / half life * age in days)."""
    return F.exp(F.lit(-0.6931471805599453 / half_life_days) * ((F.lit(now) - at) / F.lit(float(DAY_MS))))
