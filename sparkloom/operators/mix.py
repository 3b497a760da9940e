"""Splits, mixes and seeded samples; every choice follows an md5 order, so it repeats on any layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import seeded_order, seeded_uniform
from ..runtime import exact_rank


def held_out(n: Column, fraction: float, least: int) -> Column:
    """How many of ``n`` rows to hold out: n x fraction rounded half-even, at least ``least``, at most n."""
    return F.least(F.greatest(F.bround(n * F.lit(fraction)), F.lit(float(least))), n.cast("double")).cast("bigint")


def stratified_split(df: DataFrame, stratum: str, key: str, fraction: float = 0.02, least: int = 1, seed: int = 42) -> DataFrame:
    """``df`` with ``split`` (train or eval): in each stratum the first rows of a seeded order are held out.

    Strata are counted first; ranks come from hash ranges, so a stratum of a third of the rows is spread
    over many tasks. The order is the leading 60 bits of md5, then the key. A null stratum is a stratum.
    """
    digest = seeded_order(seed, F.col(key))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    spread = (order - F.lit(1 << 59)) * F.lit(16)  # the whole signed 64-bit range
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = exact_rank(df.withColumn("_h", spread), [stratum], "_h", key, "_rank")
    joined = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    return joined.withColumn("split", F.when(F.col("_rank") <= held_out(F.col("_n"), fraction, least), "eval").otherwise("train")).drop("_h", "_rank", "_s", "_n")


def mix_report(split: DataFrame, dataset: str) -> DataFrame:
    """Rows in all, for training and evaluation, and the percentage of the training rows, by dataset and in all (null, ``is_total``)."""
    is_train = F.col("split") == "train"
    each = split.rollup(dataset).agg(F.count(F.lit(1)).alias("total"), F.count_if(is_train).alias("train"), F.count_if(F.col("split") == "eval").alias("eval"), F.grouping(dataset).cast("boolean").alias("is_total"))
    return each.withColumn("ratio_percent", F.col("train") * 100.0 / F.nullif(F.max(F.when(F.col("is_total"), F.col("train"))).over(W.partitionBy()), F.lit(0)))  # one row for each dataset


def value_at(df: DataFrame, order: str, rank: int, parts: int = 1024) -> object:
    """The value at a 1-based rank of a numeric column without nulls, by counts of ever narrower ranges.

    Each pass counts the rows of ``parts`` equal ranges and goes on with the one that holds the rank, so no
    task or driver holds more than ``parts`` counts, however many rows or different values there are.
    """
    value = F.col(order)
    low, high = df.agg(F.min(value), F.max(value)).first()
    before = 0
    while low < high:
        width = (high - low) / parts
        inside = df.filter(value.between(low, high))
        part = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(parts - 1)).cast("int")
        counts = inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).orderBy("p").collect()
        for row in counts:
            if before + row["n"] >= rank:
                low, high = row["lo"], row["hi"]
                break
            before += row["n"]
    return low


def ordered_split(df: DataFrame, order: str, fraction: float = 0.9) -> DataFrame:
    """``df`` with ``split``: the first ``fraction`` of the rows by a unique numeric ``order`` column train, the rest validates.

    The cut is the value at that position, found by counts of ranges of that one column; rows are
    neither sorted nor put into a single task.
    """
    n = df.count()
    cut = int(n * fraction)
    if cut == 0:
        return df.withColumn("split", F.lit("val"))
    return df.withColumn("split", F.when(F.col(order) <= F.lit(value_at(df, order, cut)), "train").otherwise("val"))


def shuffled_outputs(split: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A :func:`stratified_split` as the files of a mix: train, eval, and val that mirrors eval, each in a seeded order ``place``."""
    rows = split.withColumn("place", seeded_order(seed, F.col("split"), F.col(key)))
    return rows.unionByName(rows.filter("split = 'eval'").withColumn("split", F.lit("val")))


def random_split(df: DataFrame, key: str, fraction: float = 0.95, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: about ``fraction`` of the rows train, the others validate, by each row's key alone."""
    return df.withColumn("split", F.when(seeded_uniform(seed, F.col(key)) < fraction, "train").otherwise("val"))


def hash_sample(df: DataFrame, key: str, rate: float | Column, seed: int = 42) -> DataFrame:
    """Each row with chance ``rate``, decided by its key alone."""
    return df.filter(seeded_uniform(seed, F.col(key)) < rate)


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the first of a seeded order (a top-n of each task, then of all)."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)
