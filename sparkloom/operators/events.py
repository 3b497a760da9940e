"""Sequence analytics and rollups over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small

# Severity levels in ascending order.
LEVELS = ["debug", "info", "warning", "error", "metric"]


def level_at_least(level: Column, least: str) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) >= LEVELS.index(least) + 1


def _parts(df: DataFrame, keys: list[str], slice_of: Column | None, **carried: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` with its slice as ``_s``, and one row for each key and slice with the aggregates ``carried``.

    ``slice_of`` does not fall as the order of a key's rows rises, such as the day. Windows then run within a
    slice and take what went before from the slices' rows, so that a key with a third of all rows is
    spread over its slices. Without it a key is one slice.
    """
    cut = df.withColumn("_s", slice_of if slice_of is not None else F.lit(0))
    return cut, cut.groupBy(*keys, "_s").agg(*(c.alias(name) for name, c in carried.items()))


def _carried(cut: DataFrame, parts: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """``cut`` with ``values``, which are window expressions over the slices of a key, of the row's own slice."""
    side = parts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_s").alias("_k_s"), *(c.alias(name) for name, c in values.items()))
    same = F.col("_s").eqNullSafe(F.col("_k_s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cut.join(broadcast_if_small(side), same).drop("_k_s", *(f"_k_{k}" for k in keys))


def _earlier(keys: list[str]):
    return W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)


def _within(keys: list[str], order: list[str]):
    return W.partitionBy(*keys, "_s").orderBy(*order)


def _last_values(df: DataFrame, keys: list[str], order: list[str], value: Column, n: int, slice_of: Column | None, out: str) -> DataFrame:
    """``df`` with the last ``n`` values up to each row, oldest first; of earlier slices only the last ``n`` - 1 are read."""
    cut = df.withColumn("_s", slice_of if slice_of is not None else F.lit(0)).withColumn("_v", F.struct(value.alias("v")))
    back = W.partitionBy(*keys, "_s").orderBy(*(F.col(o).desc() for o in order))
    ends = cut.withColumn("_k", F.row_number().over(back)).filter(F.col("_k") < n)
    tails = ends.groupBy(*keys, "_s").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v")), asc=False), lambda x: x["_v"]).alias("_tail"))
    before = F.flatten(F.collect_list("_tail").over(W.partitionBy(*keys).orderBy("_s").rowsBetween(1 - n, -1)))
    own = F.collect_list("_v").over(_within(keys, order).rowsBetween(1 - n, 0))
    both = F.concat("_before", "_own")
    seen = _carried(cut, tails, keys, _before=before).withColumn("_own", own)
    return seen.withColumn(out, F.transform(F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n), lambda x: x["v"])).drop("_s", "_v", "_before", "_own")


def sticky(df: DataFrame, value: Column, keys: list[str], order: list[str], out: str, slice_of: Column | None = None) -> DataFrame:
    """``df`` with the last non-empty value so far within ``keys``; null before the first. See :func:`_parts` for hot keys."""
    given = F.nullif(value, F.lit(""))
    cut, parts = _parts(df.withColumn("_g", given), keys, slice_of, _last=F.max_by(F.col("_g"), F.when(F.col("_g").isNotNull(), F.struct(*order))))
    seen = _carried(cut, parts, keys, _before=F.last("_last", ignorenulls=True).over(_earlier(keys)))
    own = F.last("_g", ignorenulls=True).over(_within(keys, order).rowsBetween(W.unboundedPreceding, 0))
    return seen.withColumn(out, F.coalesce(own, "_before")).drop("_s", "_g", "_before")


def seen_before(df: DataFrame, event: Column, keys: list[str], order: str, out: str = "seen_before") -> DataFrame:
    """``df`` with whether an ``event`` row of the same keys lies strictly earlier: one aggregate, no self-join of rows."""
    first = df.filter(event).groupBy(*keys).agg(F.min(order).alias("_first"))
    return df.join(first, keys, "left").withColumn(out, F.coalesce(F.col("_first") < F.col(order), F.lit(False))).drop("_first")


def progress(df: DataFrame, keys: list[str], order: list[str], tool: str, failed: Column, slice_of: Column | None = None) -> DataFrame:
    """``df`` with ``state``: spinning (last three calls: one tool, all failed), making_progress (two successes of two tools in the last five) or null."""
    with_calls = _last_values(df, keys, order, F.struct(F.col(tool).alias("t"), failed.alias("f")), 5, slice_of, "_c")
    last3 = F.slice(F.col("_c"), F.greatest(F.size("_c") - 2, F.lit(1)), 3)
    spinning = F.forall(last3, lambda x: x["f"]) & (F.size(F.array_distinct(F.transform(last3, lambda x: x["t"]))) == 1)
    good = F.filter(F.col("_c"), lambda x: ~x["f"])
    moving = (F.size(good) >= 2) & (F.size(F.array_distinct(F.transform(good, lambda x: x["t"]))) >= 2)
    return with_calls.withColumn("state", F.when(F.size("_c") < 3, None).when(spinning, "spinning").when(moving, "making_progress")).drop("_c")


def rolling_context(df: DataFrame, value: str, keys: list[str], order: list[str], n: int = 10, out: str = "context", slice_of: Column | None = None) -> DataFrame:
    """``df`` with the last ``n`` values joined by `` > ``."""
    return _last_values(df, keys, order, F.col(value), n, slice_of, "_c").withColumn(out, F.array_join("_c", " > ")).drop("_c")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by a partial aggregate."""
    columns = df.columns
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*(c.alias(f"_{k}") for k, c in enumerate(order)))).alias("_row"))
    return best.select(*(F.col(f"_row.`{c}`").alias(c) for c in columns))


def idle_gaps(df: DataFrame, keys: list[str], ts: str, minutes: int = 15, slice_of: Column | None = None) -> DataFrame:
    """Rows that follow a gap of more than ``minutes`` within ``keys``, with the gap in seconds."""
    cut, parts = _parts(df, keys, slice_of, _last=F.max(ts))
    seen = _carried(cut, parts, keys, _before=F.max("_last").over(_earlier(keys)))
    before = F.coalesce(F.lag(ts).over(_within(keys, [ts])), F.col("_before"))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return seen.withColumn("gap_seconds", gap / 1e6).filter(F.col("gap_seconds") > minutes * 60).drop("_s", "_before")


def tool_rollup(df: DataFrame, tool: str, failed: Column, duration: Column, order: Column, slice_of: Column | None = None) -> DataFrame:
    """Calls, failures, mean duration and the order-dependent running average by tool.

    The running average is that of a counter which skips calls without a positive duration but divides
    by the number of all calls so far. The n-th call with duration d > 0 maps an average a to
    a (n - 1) / n + d / n; such maps compose, so the value after the last call is the sum of d / n times
    the product of the later (n - 1) / n. ``slice_of`` is a column that does not fall as ``order`` rises,
    such as the day: calls are numbered and composed within (tool, slice) and the slices' results are
    composed again, so a tool with a third of the calls is spread over its slices.
    """
    part = slice_of if slice_of is not None else F.lit(0)
    keyed = df.withColumn("_d", duration).withColumn("_s", part)
    sizes = keyed.groupBy(tool, "_s").agg(F.count(F.lit(1)).alias("_c"))
    earlier = W.partitionBy(tool).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col(tool).alias("_t"), F.col("_s").alias("_u"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    inner = W.partitionBy(tool, "_s").orderBy(order)
    numbered = keyed.withColumn("_k", F.row_number().over(inner)).join(offsets, F.col(tool).eqNullSafe(F.col("_t")) & F.col("_s").eqNullSafe(F.col("_u")))
    n = (F.col("_k") + F.col("_before")).cast("double")
    shrunk = numbered.withColumn("_n", n).withColumn("_l", F.when((F.col("_d") > 0) & (F.col("_n") > 1), F.log1p(-1 / F.col("_n"))).otherwise(0.0))
    later = W.partitionBy(tool, "_s").orderBy(F.col("_n").desc()).rowsBetween(W.unboundedPreceding, -1)
    weight = F.exp(F.coalesce(F.sum("_l").over(later), F.lit(0.0)))
    slices = shrunk.withColumn("_w", F.when(F.col("_d") > 0, weight * F.col("_d") / F.col("_n"))).groupBy(tool, "_s").agg(F.sum("_w").alias("_p"), F.sum("_l").alias("_l"))
    after = W.partitionBy(tool).orderBy(F.col("_s").desc()).rowsBetween(W.unboundedPreceding, -1)
    averages = slices.withColumn("_p", F.col("_p") * F.exp(F.coalesce(F.sum("_l").over(after), F.lit(0.0)))).groupBy(F.col(tool).alias("_t")).agg(F.sum("_p").alias("running_avg"))
    totals = df.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("failures"), F.avg(F.when(duration > 0, duration)).alias("mean_positive"))
    return totals.join(averages, F.col(tool).eqNullSafe(F.col("_t")), "left").drop("_t").withColumn("running_avg", F.coalesce("running_avg", F.lit(0.0)))


def share_of_total(df: DataFrame, key: str, value: Column | None = None) -> DataFrame:
    """Rows (or the sum of ``value``) by key and their share of the whole."""
    each = df.groupBy(key).agg((F.sum(value) if value is not None else F.count(F.lit(1))).alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def error_types(df: DataFrame, error: str, key: str) -> DataFrame:
    """Errors by key and type, the text before the first colon, 30 code points at most."""
    kind = F.substring(F.substring_index(F.col(error), ":", 1), 1, 30)
    return df.filter(F.col(error).isNotNull() & (F.col(error) != "")).groupBy(key, kind.alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts each task's rows to ``n`` before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def pair_turns(df: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """User turns with the assistant turn that follows at once."""
    w = W.partitionBy(conversation).orderBy(order)
    nexts = df.withColumn("_r", F.lead(role).over(w)).withColumn("reply", F.lead(text).over(w))
    return nexts.filter((F.col(role) == "user") & (F.col("_r") == "assistant")).drop("_r")


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int, slice_of: Column | None = None) -> DataFrame:
    """Every ``n``-th row of each key."""
    cut, parts = _parts(df, keys, slice_of, _n=F.count(F.lit(1)))
    seen = _carried(cut, parts, keys, _before=F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)))
    return seen.withColumn("_k", F.row_number().over(_within(keys, order)) + F.col("_before")).filter(F.col("_k") % n == 0).drop("_s", "_k", "_before")


def capped(df: DataFrame, pool: str, order: list[Column], caps: dict[str, int], default: int) -> DataFrame:
    """The first rows of each pool, as many as its cap says."""
    most = F.coalesce(F.create_map(*(F.lit(x) for pair in caps.items() for x in pair))[F.col(pool)], F.lit(default)) if caps else F.lit(default)
    return top_per_group(df, pool, order, max([default, *caps.values()])).filter(F.col("rank") <= most)


def natural_key(name: Column) -> Column:
    """A text by which names sort naturally: runs of digits count as numbers, case is ignored."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")


def watcher_samples(df: DataFrame, keys: list[str], order: list[str], tool: str, failed: Column, entry: Column, n: int = 10, slice_of: Column | None = None) -> DataFrame:
    """(keys, order, instruction, input, output): a sample for each call after which a session spins or makes progress.

    The input is the last ``n`` entries of the session, the output the state and its reason as JSON.
    """
    seen = progress(df, keys, order, tool, failed, slice_of)
    seen = _last_values(seen, keys, order, F.struct(entry.alias("e"), F.when(~failed, F.col(tool)).alias("t")), n, slice_of, "_h")
    last5 = F.slice("_h", F.greatest(F.size("_h") - 4, F.lit(1)), 5)
    different = F.size(F.array_distinct(F.array_compact(F.transform(last5, lambda x: x["t"]))))
    reason = F.when(F.col("state") == "spinning", F.concat(F.lit("Repeated failures with "), tool, F.lit(" detected."))).otherwise(F.concat(F.lit("Successful execution of "), different.cast("string"), F.lit(" different tools.")))
    answer = F.to_json(F.struct(F.col("state").alias("progress_status"), reason.alias("reason")))
    ask = "Analyze the tool execution history and determine the agent's progress status (progress_status, reason)."
    told = F.array_join(F.transform("_h", lambda x: x["e"]), "\n---\n")
    return seen.filter("state is not null").select(*keys, *order, F.lit(ask).alias("instruction"), told.alias("input"), answer.alias("output"))


def steps(df: DataFrame, keys: list[str], order: list[str], success: Column, backtrack: Column | None = None, slice_of: Column | None = None) -> DataFrame:
    """``df`` with ``next_step`` (successes so far) and ``last_success`` (order value of the latest).

    Where a ``backtrack`` point was given so far, the next step is the one after the last such point.
    """
    flagged = df.withColumn("_ok", success).withColumn("_b", backtrack.cast("bigint") if backtrack is not None else F.lit(None).cast("bigint"))
    latest_of = lambda c: F.max(F.when(F.col("_ok"), F.col(c)))
    cut, parts = _parts(flagged, keys, slice_of, _n=F.sum(F.col("_ok").cast("bigint")), _at=latest_of(order[0]), _back=F.max_by("_b", F.when(F.col("_b").isNotNull(), F.struct(*order))))
    e = _earlier(keys)
    seen = _carried(cut, parts, keys, _n0=F.sum("_n").over(e), _at0=F.max("_at").over(e), _b0=F.last("_back", ignorenulls=True).over(e))
    w = _within(keys, order).rowsBetween(W.unboundedPreceding, 0)
    own = F.sum(F.col("_ok").cast("bigint")).over(w)
    done = F.when(own.isNotNull() | F.col("_n0").isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce("_n0", F.lit(0)))
    done = F.coalesce(F.coalesce(F.last("_b", ignorenulls=True).over(w), "_b0") + 1, done)
    return seen.withColumn("next_step", done).withColumn("last_success", F.greatest(latest_of(order[0]).over(w), "_at0")).drop("_s", "_ok", "_b", "_n0", "_at0", "_b0")
