"""Profiles and reports of record sets and of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import or_empty


def qa_profile(df: DataFrame, parse_error: Column | None = None) -> DataFrame:
    """One row: counts, missing fields, sums, means over all rows and maxima of lengths, code fences.

    Unparsed rows count in the total by which means are divided.
    """
    i, o = or_empty(F.col("instruction")), or_empty(F.col("output"))
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        F.count_if(parse_error if parse_error is not None else F.lit(False)).alias("parse_errors"),
        F.count_if(i == "").alias("missing_instruction"),
        F.count_if(o == "").alias("missing_output"),
        F.coalesce(F.sum(F.length(i)), F.lit(0)).alias("instruction_chars"),
        F.coalesce(F.sum(F.length(o)), F.lit(0)).alias("output_chars"),
        (F.sum(F.length(o)) / F.nullif(total, F.lit(0))).alias("mean_output"),
        F.max(F.length(o)).alias("max_output"),
        F.count_if(F.contains(o, F.lit("```"))).alias("fenced"),
    )


def histogram(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: Column, name: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return histogram(df, column, name).orderBy(F.desc("n"), name).limit(n)


def eval_report(df: DataFrame, score: Column, passed: Column, error: Column, latency: Column, keys: list[str] | None = None, tokens_per_second: Column | None = None) -> DataFrame:
    """Totals, passes, mean score (0 where the reply failed), means of positive latencies and, if given, token rates, in all or by ``keys``."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    total = F.count(F.lit(1))
    rate = [F.avg(F.when(tokens_per_second > 0, tokens_per_second)).alias("avg_tokens_per_second")] if tokens_per_second is not None else []
    return grouped.agg(
        total.alias("total"),
        F.count_if(passed).alias("passed"),
        (F.count_if(passed) / F.nullif(total, F.lit(0))).alias("pass_rate"),
        F.avg(F.when(error, 0.0).otherwise(score)).alias("avg_score"),
        F.avg(F.when(latency > 0, latency)).alias("avg_latency"),
        *rate,
    )


def histogram_text(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """(keys, out): how often each value occurs within ``keys``, as ``value:n`` in order of value, joined by ``;``. Null is no value."""
    each = df.filter(value.isNotNull()).groupBy(*keys, value.cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("_v", "_n"))), lambda x: F.concat(x["_v"], F.lit(":"), x["_n"].cast("string")))
    return each.groupBy(*keys).agg(F.array_join(entries, ";").alias(out))


def benchmark_rollup(df: DataFrame, benchmark: str, success: Column, iterations: Column, seconds: Column, expert: Column, thinking: Column) -> DataFrame:
    """Attempts, successes, mean iterations and duration, calls by expert and uses of thinking, by benchmark."""
    each = df.groupBy(benchmark).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(success).alias("successes"), F.avg(iterations).alias("avg_iterations"), F.avg(seconds).alias("avg_duration"), F.count_if(thinking).alias("thinking_uses")
    )
    return each.join(histogram_text(df, [benchmark], expert, "experts"), benchmark, "left")


def session_stats(df: DataFrame, session: str, kind: Column, name: Column, success: Column, backtrack: Column) -> DataFrame:
    """One row for each session: routing by expert, tool calls that succeeded and failed, rate, iterations, thinking uses, backtracks.

    ``kind`` is routing, tool, thinking, iteration or reflection; ``name`` the expert or tool.
    """
    is_tool, is_step = kind == "tool", kind == "iteration"
    each = df.groupBy(session).agg(
        F.count_if(is_tool & success).alias("tool_success"),
        F.count_if(is_tool & ~success).alias("tool_fail"),
        (F.count_if(is_tool & success) / F.nullif(F.count_if(is_tool), F.lit(0))).alias("tool_success_rate"),
        F.count_if(kind == "thinking").alias("thinking_uses"),
        F.count_if(is_step).alias("iterations"),
        F.count_if(is_step & success).alias("successes"),
        F.count_if((kind == "reflection") & backtrack).alias("backtracks"),
    )
    return each.join(histogram_text(df.filter(kind == "routing"), [session], name, "expert_calls"), session, "left")


def run_summary(df: DataFrame, success: Column, iterations: Column, seconds: Column) -> DataFrame:
    """One row: runs, successes, failures, success rate (0 without runs), mean iterations and duration."""
    total, good = F.count(F.lit(1)), F.count_if(success)
    return df.agg(
        total.alias("total"), good.alias("successes"), (total - good).alias("failures"), F.coalesce(good / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("success_rate"), F.avg(iterations).alias("avg_iterations"), F.avg(seconds).alias("avg_duration")
    )


def mean_scores(df: DataFrame, category: Column, score: Column) -> DataFrame:
    """Mean score by category, and over all rows (null, ``is_total``)."""
    return df.withColumn("category", category).rollup("category").agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"), F.grouping("category").cast("boolean").alias("is_total"))


def percentages(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Rows by value and their percentage of all."""
    return histogram(df, column, name).withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))  # one row for each value


def expert_analysis(rollup: DataFrame, expert: str) -> DataFrame:
    """An :func:`expert_rollup` as (expert, calls, share, mean_confidence, success_rate)."""
    return rollup.select(expert, "calls", "share", "mean_confidence", (F.col("completed") / F.col("calls")).alias("success_rate"))


def totals_by(df: DataFrame, key: str) -> DataFrame:
    """Rows by key and in all (null key, ``is_total``), by one grouping-sets aggregate."""
    return df.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.grouping(key).cast("boolean").alias("is_total"))


def validation_summary(df: DataFrame, attempted: Column, valid: Column, score: Column, family: Column, keys: list[str] | None = None) -> DataFrame:
    """Rows, attempts, passes, failures, skips, pass rate of the attempts, mean score of all and of valid ones, and how often each family failed (see :func:`histogram_text`)."""
    keys = keys or []
    tried = F.coalesce(attempted, F.lit(False))
    passed, n = tried & F.coalesce(valid, F.lit(False)), F.count_if(tried)
    each = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        n.alias("attempted"),
        F.count_if(passed).alias("passed"),
        (n - F.count_if(passed)).alias("failed"),
        (F.count(F.lit(1)) - n).alias("skipped"),
        (F.count_if(passed) / F.nullif(n, F.lit(0))).alias("pass_rate"),
        F.avg(F.when(tried, score)).alias("mean_score"),
        F.avg(F.when(passed, score)).alias("mean_score_valid"),
    )
    failed = histogram_text(df, keys, F.when(tried & ~F.coalesce(valid, F.lit(False)), family), "failure_families")
    return each.join(failed, keys, "left") if keys else each.crossJoin(F.broadcast(failed))


def expert_rollup(df: DataFrame, expert: str, reason: Column, confidence: Column, completed: Column) -> DataFrame:
    """Calls, share of all, completions, mean and low confidences (under 0.5) and reasons (50 code points, see :func:`histogram_text`) by expert."""
    reasons = histogram_text(df, [expert], F.substring(reason, 1, 50), "reasons")
    each = df.groupBy(expert).agg(F.count(F.lit(1)).alias("calls"), F.count_if(completed).alias("completed"), F.count_if(confidence < 0.5).alias("low_confidence"), F.avg(confidence).alias("mean_confidence"))
    shared = each.withColumn("share", F.col("calls") / F.sum("calls").over(W.partitionBy()))  # one row for each expert
    return shared.join(reasons, expert, "left")
