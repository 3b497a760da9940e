"""Mixtures of sources or categories to target weights (problem 2)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut_lineage, exact_rank, norm_label, seeded, with_total

#: Records of middle length, about, that the knapsack places after the proportional part.
LAST_RECORDS = 64
DIMENSIONS = ("source", "category")


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many records of each length to take, so that their sizes come as near to ``budget`` from below as can be.

    ``lengths`` ascend. A proportional part is taken first, by rounding the running number of records, so
    that it keeps the member's spread of lengths at every size of the budget. The rest, about
    ``LAST_RECORDS`` records of middle length, is filled by a bounded-knapsack dynamic program over the
    records not taken: counts are split in binary, and for each sum the item that first reached it is
    kept, from which the choice is read back. Work is items x rest, memory five bytes for each unit of the
    rest; there is no cap on either.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    running = np.cumsum(np.where(lengths <= budget, counts, 0))  # longer ones fit in no choice
    total = int((lengths * np.where(lengths <= budget, counts, 0)).sum())
    if budget >= total:
        return np.where(lengths <= budget, counts, 0)
    middle = int(lengths[np.searchsorted(running, (int(running[-1]) + 1) // 2)])
    most = budget - min(budget, LAST_RECORDS * max(middle, 1))
    # Integers only: shares of large counts would lose records in floating point.
    take = np.diff(np.array([int(c) * most // total for c in running.tolist()], dtype=np.int64), prepend=0)
    rest = budget - int((lengths * take).sum())
    for k in range(len(lengths) - 1, -1, -1):  # a longest record may have been one too many
        if rest >= 0:
            break
        fewer = min(int(take[k]), -(rest // int(lengths[k]))) if lengths[k] else 0
        take[k] -= fewer
        rest += fewer * int(lengths[k])
    left = counts - take
    usable = np.flatnonzero((left > 0) & (lengths > 0) & (lengths <= rest))[::-1].tolist()
    unit = math.gcd(*(int(lengths[k]) for k in usable)) if usable else 1
    rest //= unit
    via = np.full(rest + 1, -1, np.int32)
    via[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for k in usable:
        size, more, chunk = int(lengths[k]) // unit, min(int(left[k]), rest * unit // int(lengths[k])), 1
        while more > 0 and via[rest] < 0:
            n = min(chunk, more)
            step = n * size
            fresh = np.flatnonzero((via[: rest + 1 - step] >= 0) & (via[step:] < 0)) + step
            if len(fresh):
                via[fresh] = len(items)
                items.append((k, n))
            more -= n
            chunk *= 2
        if via[rest] >= 0:
            break
    at = int(np.flatnonzero(via >= 0)[-1])
    while at:
        k, n = items[via[at]]
        take[k] += n
        at -= n * int(lengths[k]) // unit
    return take


_PLAN = "mix_id {m}, dimension string, member string, key string, size bigint, have bigint, take bigint, repeats bigint, wanted double, weight double, max_repeats bigint, total bigint, exhausted boolean, unfilled bigint"


def plan(records: DataFrame, weights: DataFrame) -> DataFrame:
    """By mix, member and length: how often each record is used (``repeats``) and how many uses more there are (``take``).

    ``records`` has (id, source, category, size), one row for each record; ``weights`` (mix_id,
    dimension, mix_share, member, weight, max_repeats). A member's budget is weight x mix_share x total
    size. A member whose records, all used ``max_repeats`` times, do not reach it is ``exhausted`` and used
    fully; ``unfilled`` is what no choice of records could fill of any other's budget. Only counts by
    member and length are grouped, never records.
    """
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total"))
    by_length = None
    for dim in DIMENSIONS:
        one = records.groupBy(F.col(dim).alias("key"), "size").agg(F.count(F.lit(1)).alias("have")).withColumn("dimension", F.lit(dim))
        by_length = one if by_length is None else by_length.unionByName(one)
    asked = weights.select("mix_id", F.lower(F.trim("dimension")).alias("dimension"), "mix_share", "member", "weight", F.coalesce("max_repeats", F.lit(1)).cast("bigint").alias("max_repeats"))
    asked = asked.withColumn("key", norm_label(F.col("member")))
    joined = with_total(asked.join(by_length.filter(F.col("key").isNotNull()), ["dimension", "key"], "left"), total)
    wanted = F.coalesce(F.col("weight") * F.col("mix_share") * F.col("total"), F.lit(0.0))
    schema = _PLAN.format(m=weights.schema["mix_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    ready = joined.withColumn("wanted", wanted).withColumn("take", F.lit(0).cast("bigint")).withColumn("repeats", F.lit(0).cast("bigint"))
    ready = ready.withColumn("exhausted", F.lit(False)).withColumn("unfilled", F.lit(0).cast("bigint"))
    ready = ready.withColumn("size", F.coalesce("size", F.lit(0)).cast("bigint")).withColumn("have", F.coalesce("have", F.lit(0))).select(*names)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable").reset_index(drop=True)
        lengths, counts = rows["size"].to_numpy(np.int64), rows["have"].to_numpy(np.int64)
        member, most = int((lengths * counts).sum()), max(0, int(rows["max_repeats"].iloc[0]))
        wanted = float(rows["wanted"].iloc[0])
        # Every record used as often as it may be, and budget is left.
        exhausted = float(member) * most < wanted
        budget = member * most if exhausted else int(wanted)
        times = min(most, budget // member) if member else 0
        # The last full use of all records is left open as well, which gives the knapsack room.
        opened = 0 if times in (0, most) else 1
        times -= opened
        take = fill(lengths, counts * (1 + opened), budget - times * member) if times < most and member else np.zeros_like(counts)
        rows["repeats"], rows["take"], rows["exhausted"] = times, take, exhausted
        rows["unfilled"] = budget - times * member - int((lengths * take).sum())
        return rows[names]

    return ready.groupBy("mix_id", "dimension", "key").applyInPandas(fit, schema)


def mix_records(df: DataFrame, id_col: str = "rec_id", texts: tuple[str, ...] = ("instruction", "output"), size: Column | None = None) -> DataFrame:
    """(id, source, category, size) of each distinct id.

    ``size`` is the code points of ``texts``, null as 0, unless a column of whole numbers is given, such as
    a count of tokens.
    """
    if size is None:
        size = sum((F.coalesce(F.length(c), F.lit(0)).cast("bigint") for c in texts[1:]), F.coalesce(F.length(texts[0]), F.lit(0)).cast("bigint"))
    size = F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))
    flat = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), norm_label(F.col("source")).alias("source"), norm_label(F.col("category")).alias("category"), size.alias("size"))
    return flat.groupBy("id").agg(F.min(F.struct("size", "source", "category")).alias("r")).select("id", "r.source", "r.category", "r.size")


def report(planned: DataFrame) -> DataFrame:
    """(mix_id, member, wanted, available, actual, target_weight, actual_share, short, unfilled) of a :func:`plan`.

    ``short`` marks members that ran out, ``unfilled`` is what the knapsack left of the budget of others.
    """
    each = planned.groupBy("mix_id", "dimension", "member").agg(
        F.max("wanted").alias("wanted"),
        F.max("weight").alias("target_weight"),
        (F.sum(F.col("size") * F.col("have")) * F.max("max_repeats")).alias("available"),
        F.sum(F.col("size") * (F.col("have") * F.col("repeats") + F.col("take"))).alias("actual"),
        F.bool_or("exhausted").alias("short"),
        F.max("unfilled").alias("unfilled"),
    )
    whole = F.sum("actual").over(W.partitionBy("mix_id"))
    return each.withColumn("actual_share", F.col("actual") / F.nullif(whole, F.lit(0)))


def mix_to_weights(df: DataFrame, weights: DataFrame, id_col: str = "rec_id", texts: tuple[str, ...] = ("instruction", "output"), seed: int = 23, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report): the mixture has (mix_id, member, id, repeats), one row for each record used.

    Within a member and length the records used once more follow a seeded hash of their ids, ranked by
    hash ranges, so that a hot member is spread over many tasks. Repeated ids are one record, null ids
    are left out, null and unknown members only count in the total size. Empty tables give empty results.
    """
    records = mix_records(df, id_col, texts, size)
    planned = plan(records, weights)
    planned = cut_lineage(planned)  # counts by mix, member and length only; read twice
    used = broadcast_if_small(planned.filter((F.col("take") > 0) | (F.col("repeats") > 0)))
    parts = None
    for dim in DIMENSIONS:
        one = used.filter(F.col("dimension") == dim).select("mix_id", "member", F.col("key").alias("_key"), F.col("size").alias("_size"), "take", "repeats", "have")
        ranked = exact_rank(records.filter(F.col(dim).isNotNull()).select("id", F.col(dim).alias("key"), "size").withColumn("_h", seeded(seed, F.col("id"))), ["key", "size"], "_h", "id", "rank", slices=8)
        drawn = ranked.join(one, (F.col("key") == F.col("_key")) & (F.col("size") == F.col("_size")))
        more = F.when(F.col("rank") <= F.col("take"), F.expr("1 + (take - rank) div have")).otherwise(0)
        times = F.col("repeats") + more
        drawn = drawn.select("mix_id", "member", F.col("id").alias(id_col), times.alias("repeats")).filter(F.col("repeats") > 0)
        parts = drawn if parts is None else parts.unionByName(drawn)
    return parts, report(planned)
