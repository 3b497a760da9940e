"""Exact deduplication and set operations; the first row in a given order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, strip


def record_key(*columns: str) -> Column:
    """SHA-1 over the stripped columns joined by line feeds; null counts as ''."""
    return F.sha1(F.concat_ws("\n", *(strip(or_empty(F.col(c))) for c in columns)))


def mark_duplicates(df: DataFrame, key: Column, order: list[Column], out: str = "duplicate") -> DataFrame:
    """``df`` with ``out``: whether an earlier row has the same key. A null key never repeats another.

    The first place of each key that repeats comes from a partial aggregate and is joined back, so that a
    key of very many rows is neither sorted nor held in one task. Rows that tie in ``order`` are equally
    first; give an order without ties.
    """
    place = F.struct(*(c.alias(f"_o{k}") for k, c in enumerate(order)))
    keyed = df.withColumn("_key", key).withColumn("_place", place)
    first = keyed.filter("_key is not null").groupBy(F.col("_key").alias("_k")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return keyed.join(first, F.col("_key") == F.col("_k"), "left").withColumn(out, F.coalesce(F.col("_place") > F.col("_first"), F.lit(False))).drop("_key", "_place", "_k", "_first", "_n")


def first_per_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key, by a partial aggregate, so that a hot key is reduced before the shuffle."""
    columns = df.columns
    rank = F.struct(*(c.alias(f"_o{k}") for k, c in enumerate(order)))
    best = df.withColumn("_key", key).withColumn("_rank", rank).groupBy("_key").agg(F.min_by(F.struct(*columns), "_rank").alias("_row"))
    return best.select(*(F.col(f"_row.`{c}`").alias(c) for c in columns))


def content_duplicates(df: DataFrame, content: str, order: list[Column]) -> DataFrame:
    """``df`` with ``md5`` of its content and whether an earlier row has the same; null and empty contents have none."""
    digest = F.when(or_empty(F.col(content)) != "", F.md5(content))
    return mark_duplicates(df.withColumn("md5", digest), F.col("md5"), order)


def gold(df: DataFrame, order: list[Column], fields: tuple[str, ...] = ("instruction", "input", "output")) -> DataFrame:
    """Rows with ``status``: missing (no instruction or output), duplicate of an earlier row, or kept."""
    missing = (strip(or_empty(F.col("instruction"))) == "") | (strip(or_empty(F.col("output"))) == "")
    marked = mark_duplicates(df.withColumn("_missing", missing), F.when(~missing, record_key(*fields)), order)
    return marked.withColumn("status", F.when(F.col("_missing"), "missing").when(F.col("duplicate"), "duplicate").otherwise("kept")).drop("_missing", "duplicate")


def combine_by_priority(first: DataFrame, second: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """All of ``first``, then of ``second`` the first row of each key that ``first`` does not have."""
    fresh = first_per_key(second, F.col(key), order).join(first.select(key).distinct(), key, "left_anti")
    return first.unionByName(fresh, allowMissingColumns=True)


def distinct_ignoring_case(values: Column) -> Column:
    """An array without values that repeat an earlier one but for case, in order."""
    return F.aggregate(
        values, F.expr("cast(array() as array<string>)"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x))
    )
