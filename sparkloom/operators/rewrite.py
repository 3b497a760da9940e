"""Symbols: scanning, merging by precedence, and rewriting listings with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines, strip
from ..runtime import broadcast_if_small



def scan_symbols(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, name, address) of lines ``NAME = $ADDRESS``, comments cut, addresses upper case."""
    rows = df.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    code = strip(F.substring_index("line", ";", 1))
    found = rows.withColumn("name", F.regexp_extract(code, r"^!?([A-Za-z_][A-Za-z0-9_]*)\s*:?=\s*\$([0-9A-Fa-f]+)$", 1)).withColumn("address", F.upper(F.regexp_extract(code, r"^!?([A-Za-z_][A-Za-z0-9_]*)\s*:?=\s*\$([0-9A-Fa-f]+)$", 2)))
    return found.filter("name <> ''").select(key, "line_no", "name", "address")


def markdown_symbols(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, address) of bold blocks of a page: every name in back quotes with every address, short forms of 7Exxxx added.

    A block names several symbols by slashes.
    """
    blocks = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\*\*([^\n]*?)\*\*"), 1)).alias("_b"))
    names = F.filter(F.split(F.array_join(F.regexp_extract_all("_b", F.lit(r"`([A-Z0-9_/]+)`"), 1), "/"), "[/ ]+"), lambda x: x != "")
    addresses = F.transform(F.regexp_extract_all("_b", F.lit(r"`\$([0-9A-Fa-f]+)`"), 1), F.upper)
    both = blocks.select(key, F.explode(names).alias("name"), addresses.alias("_a")).select(key, "name", F.explode("_a").alias("address"))
    short = both.filter(F.col("address").rlike("^7E[0-9A-F]{4}$")).withColumn("address", F.substring("address", 3, 4))
    return both.unionByName(short).distinct()


def merge_symbols(symbols: DataFrame) -> DataFrame:
    """(address, name) from (address, name, priority, line_no): the highest priority wins, in it the last line.

    A short form is added for addresses 7Exxxx unless it is taken.
    """
    best = symbols.groupBy("address").agg(F.max_by("name", F.struct("priority", "line_no")).alias("name"))
    short = best.filter(F.col("address").rlike("^7E[0-9A-F]{4}$")).select(F.substring("address", 3, 4).alias("address"), "name")
    return best.unionByName(short.join(best.select("address"), "address", "left_anti"))


def enrich(df: DataFrame, key: str, code: str, symbols: DataFrame, safe: bool = True) -> DataFrame:
    """``df`` rows whose listing names a known address, with ``enriched`` holding the names instead.

    Addresses are extracted, joined by equality and replaced longest first. With ``safe`` an address
    inside a longer one is left alone; otherwise it is plain text. Rows without any hit are left out.
    """
    found = df.select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.regexp_extract_all(F.upper(F.col(code)), F.lit(r"\$([0-9A-F]{2,6})"), 1))).alias("address"))
    named = found.join(broadcast_if_small(symbols), "address").groupBy("_key").agg(F.array_sort(F.collect_set(F.struct((-F.length("address")).alias("o"), "address", "name"))).alias("_map"))
    tail = "(?![0-9A-Fa-f])" if safe else ""
    swap = F.aggregate("_map", F.col(code), lambda acc, m: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\$"), m["address"], F.lit(tail)), m["name"]))
    return df.join(named, F.col(key) == F.col("_key")).withColumn("enriched", swap).filter(F.col("enriched") != F.col(code)).drop("_key", "_map")


def replace_labels(code: Column, labels: Column, base: int = 0x2000, long_base: int = 0x7E2000, step: int = 2) -> Column:
    """A listing with its missing labels replaced by addresses, given out in the order of the sorted labels.

    Only code before a comment is changed and only whole words. A line that uses long addressing gets the
    long form.
    """
    order = F.array_sort(F.array_distinct(labels))

    def line(x: Column) -> Column:
        head, comment = F.substring_index(x, ";", 1), F.when(F.contains(x, F.lit(";")), F.regexp_replace(x, "(?s)^[^;]*", "")).otherwise("")
        long = head.rlike(r"(?i)\b(JSL|JML)\b|\.l\b")
        numbered = F.transform(order, lambda label, i: F.struct(label.alias("label"), i.alias("i")))
        done = F.aggregate(
            numbered,
            head,
            lambda acc, m: F.regexp_replace(
                acc,
                F.concat(F.lit(r"(?<![A-Za-z0-9_])"), m["label"], F.lit(r"(?![A-Za-z0-9_])")),
                F.when(long, F.format_string(r"\$%06X", F.lit(long_base) + m["i"] * step)).otherwise(F.format_string(r"\$%04X", F.lit(base) + m["i"] * step)),
            ),
        )
        return F.concat(done, comment)

    return F.array_join(F.transform(lines(code), line), "\n")


def missing_labels(errors: Column) -> Column:
    """Labels named by messages of the form: Label 'x' wasn't found."""
    return F.array_distinct(F.regexp_extract_all(errors, F.lit(r"[Ll]abel '([A-Za-z_][A-Za-z0-9_.]*)' wasn't found"), 1))


def latest_index(df: DataFrame, group: str, name: str) -> DataFrame:
    """The name with the highest number before its extension, by group."""
    number = F.nullif(F.regexp_extract(F.col(name), r"(\d+)(?:\.[A-Za-z0-9]+)?$", 1), F.lit("")).cast("bigint")
    return df.withColumn("_n", number).filter("_n is not null").groupBy(group).agg(F.max_by(name, F.struct("_n", name)).alias("latest"), F.max("_n").alias("number"))


def running_flag(df: DataFrame, key: str, order: str, starts: Column, stops: Column, out: str = "inside") -> DataFrame:
    """``df`` with whether a row lies between a start marker and the first stop marker after it."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(starts, F.lit(True)).when(stops, F.lit(False)), ignorenulls=True).over(w)
    return df.withColumn(out, F.coalesce(last, F.lit(False)) & ~starts)
