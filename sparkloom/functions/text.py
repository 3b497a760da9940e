"""Text expressions: stripping, lines, keyword tests, ordered choices. All native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """``c`` without ASCII white space at either end (blanks, tabs, line ends); null stays null."""
    return F.regexp_replace(c, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def filled(c: Column, default: Column | str) -> Column:
    """``default`` where ``c`` is null or strips to nothing, else ``c`` stripped."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lines(c: Column) -> Column:
    """The lines of a text, parted at line feeds; null gives null, '' one empty line."""
    return F.split(c, "\n", -1)


def any_of(text: Column, keywords: list[str]) -> Column:
    """Whether lower-cased ``text`` holds any keyword as a substring; the keywords are lower-cased too."""
    low = F.lower(text)
    test = F.lit(False)
    for k in keywords:
        test = test | F.contains(low, F.lit(k.lower()))
    return test


def hits(text: Column, keywords: list[str]) -> Column:
    """How many of ``keywords`` occur in ``text`` as substrings, case ignored."""
    low = F.lower(text)
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(low, F.lit(k.lower())).cast("int")
    return total


def first_match(cases: list[tuple[Column, str]], default: str | None) -> Column:
    """The label of the first test that holds."""
    (test, label), *rest = cases
    out = F.when(test, F.lit(label))
    for test, label in rest:
        out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def argmax(scores: list[tuple[str, Column]]) -> Column:
    """struct(score, label) of the highest score; of equal scores the one listed first."""
    best = F.array_max(F.array(*(F.struct(s.cast("double").alias("score"), F.lit(-k).alias("o"), F.lit(name).alias("label")) for k, (name, s) in enumerate(scores))))
    return F.struct(best["score"].alias("score"), best["label"].alias("label"))


def seeded_order(seed: int, *key: Column) -> Column:
    """A hexadecimal order from md5, reproducible in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)))


def seeded_uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the first eight digits of :func:`seeded_order`."""
    return F.conv(F.substring(seeded_order(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
