"""Samples that match target shares of categories (problem 1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, exact_rank, norm_label, seeded, with_total


_SEATS = "request_id {rid}, category string, target_share double, min_rows bigint, pool_rows bigint, sample_share double, sample_rows bigint, available bigint, wanted double, seats bigint, floor_seats bigint, cut double, short boolean, actual_share double, below_target boolean"


def allot(targets: pd.DataFrame) -> pd.DataFrame:
    """Seats of one request by the divisor method, from counts alone.

    The record of rank r within its category has priority (r - 0.5) / target. Floors are seated first;
    the remaining seats go to the smallest priorities, ties to the category that comes first. A category
    that runs out has no further priorities, so its seats pass on. The threshold priority is found by
    bisection, then the last seats one by one.

    Without limits a category of share t has t x level records of a priority up to ``level``; at the level of
    the whole sample, unrounded, that is what it is ``wanted`` to give. A category is ``short`` if its records
    run out before that level, or before its floor. ``below_target`` marks those that got fewer
    seats than wanted, rounded down, also because the floors of others took them.
    """
    rows = targets.sort_values("category", kind="stable").reset_index(drop=True)
    size = int(rows["sample_rows"].iloc[0])
    have, share = rows["available"].astype("int64").tolist(), rows["target_share"].fillna(0.0).clip(lower=0.0).tolist()
    floor = [min(n, max(0, int(m))) for n, m in zip(have, rows["min_rows"].fillna(0))]
    room = max(size, sum(floor))

    def seats(level: float) -> list[int]:
        return [max(f, min(n, int(level * t + 0.5))) if t > 0 else f for n, t, f in zip(have, share, floor)]

    low, high = 0.0, 1.0
    while sum(seats(high)) < room and high < 1e15 and any(s < n and t > 0 for s, n, t in zip(seats(high), have, share)):
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if sum(seats(mid)) <= room else (low, mid)
    got = seats(low)
    while sum(got) < room:
        free = [((got[k] + 0.5) / share[k], k) for k in range(len(got)) if share[k] > 0 and got[k] < have[k]]
        if not free:
            break
        got[min(free)[1]] += 1
    rows["wanted"] = rows["target_share"].fillna(0.0) * rows["sample_share"].fillna(0.0) * rows["pool_rows"]
    rows["short"] = rows["available"] < np.maximum(rows["wanted"], rows["min_rows"].fillna(0).astype("float64"))
    rows["seats"], rows["floor_seats"] = got, floor
    rows["actual_share"] = rows["seats"] / max(sum(got), 1)
    rows["below_target"] = rows["seats"] < np.floor(rows["wanted"])
    rows["cut"] = max([(g - 0.5) / t for g, t, f in zip(got, share, floor) if t > 0 and g > f], default=0.0)
    return rows


def shares(pool: DataFrame, targets: DataFrame, id_col: str, category: str = "category") -> DataFrame:
    """What each request gets of each named category; one row for each row of ``targets``.

    ``targets`` has (request_id, sample_share, category, target_share, min_rows). ``available`` counts
    distinct ids of the pool whose category agrees after normalisation; ``pool_rows`` all distinct ids,
    those of null or unknown category included. ``short`` marks categories whose records run out before
    the larger of the unrounded wanted number and ``min_rows`` is reached; see :func:`allot`. Null shares and floors count as 0. The
    pool is reduced to one count for each category before anything is joined.
    """
    records = pool.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), norm_label(F.col(category)).alias("_c")).groupBy("_id").agg(F.min("_c").alias("_c"))
    counts = records.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("pool_rows"))
    asked = targets.select("request_id", "sample_share", "category", "target_share", F.col("min_rows").cast("bigint").alias("min_rows")).withColumn("_k", norm_label(F.col("category")))
    known = with_total(asked.join(counts, asked["_k"] == counts["_c"], "left"), total)
    known = known.withColumn("available", F.coalesce("_n", F.lit(0)))
    known = known.withColumn("sample_rows", F.coalesce(F.round(F.col("sample_share") * F.col("pool_rows")), F.lit(0)).cast("bigint"))
    schema = _SEATS.format(rid=targets.schema["request_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(c.split() for c in schema.split(", "))
    ready = known.select(*(F.col(c) if c in known.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names))
    return ready.groupBy("request_id").applyInPandas(lambda rows: allot(rows)[names], schema)


def sample_to_targets(pool: DataFrame, targets: DataFrame, id_col: str, category: str = "category", seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for all requests of ``targets`` at once.

    sample: (request_id, category, id, rank, priority), one row for each record drawn. report: see
    :func:`shares`, with ``drawn``'s number in ``seats``. A record's rank within its category follows a
    seeded hash of its id, so a sample is the same on every run and layout. Ranks are taken by hash
    ranges: a category that holds a third of the pool is spread over many tasks. Repeated ids are one
    record; null ids are left out; of an id with several categories the first in order counts. An empty
    pool gives an empty sample and a report of shortfalls; empty targets give empty results.
    """
    report = shares(pool, targets, id_col, category)
    records = pool.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), norm_label(F.col(category)).alias("_c"))
    records = records.groupBy("_id").agg(F.min("_c").alias("_c"))
    named = broadcast_if_small(targets.select(norm_label(F.col("category")).alias("_c")).distinct())
    ranked = exact_rank(records.join(named, "_c", "left_semi").withColumn("_h", seeded(seed, F.col("_id"))), ["_c"], "_h", "_id", "rank")
    seats = report.filter(F.col("seats") > 0).select("request_id", "category", norm_label(F.col("category")).alias("_c"), "target_share", "seats")
    drawn = ranked.join(broadcast_if_small(seats), "_c").filter(F.col("rank") <= F.col("seats"))
    priority = (F.col("rank") - F.lit(0.5)) / F.col("target_share")
    return drawn.select("request_id", "category", F.col("_id").alias(id_col), "rank", priority.alias("priority")), report
