"""Lengths at which a source's texts are cut, by discrete hazards (problems 4 and 5)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut_lineage


def upper_tail(count: float, mean: float) -> float:
    """P(X >= count) of a Poisson variable, summed from the first term on."""
    if count <= mean:
        return 1.0
    term = math.exp(-mean + count * math.log(mean) - math.lgamma(count + 1)) if mean > 0 else 0.0
    total, k = 0.0, count
    while term > total * 1e-12 and k < count + 10_000:
        total += term
        k += 1
        term *= mean / k
    return min(1.0, total)


def _p_values(count: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series([upper_tail(c, m) for c, m in zip(count, mean)], dtype="float64")


def length_limits(lengths: DataFrame, source: str = "model", length: str = "n_chars", window: int = 40, rate: float = 0.001, least: int = 5) -> DataFrame:
    """Lengths at which suspiciously many texts of a source stop: (source, length, n, expected, p_value).

    The hazard of a length is the share of the texts at least that long which stop there. It is held
    against the hazard of the ``window`` lengths on either side; the upper Poisson tail gives a p-value,
    and Benjamini-Hochberg over all sources and lengths keeps the share of false ones to ``rate``. Returned
    are such lengths with ``least`` texts or more and twice the expected number. Rows of null source or
    length take no part. Only counts by source and length are shuffled and windowed, which the range of
    lengths bounds; the control counts p-values below a falling threshold and sorts nothing.
    """
    counts = lengths.filter(F.col(source).isNotNull() & F.col(length).isNotNull()).groupBy(source, length).agg(F.count(F.lit(1)).alias("n"))
    longer = W.partitionBy(source).orderBy(F.col(length).desc()).rowsBetween(W.unboundedPreceding, 0)
    near = W.partitionBy(source).orderBy(length).rangeBetween(-window, window)
    risk = counts.withColumn("at_risk", F.sum("n").over(longer))
    around = risk.withColumn("other_n", F.sum("n").over(near) - F.col("n")).withColumn("span", F.sum("at_risk").over(near) - F.col("at_risk"))
    # Lengths that no text has add to the exposure: the texts at risk there are those of the next length up.
    seen = F.count(F.lit(1)).over(near) - 1
    width = F.least(F.lit(2 * window), F.col(length) + F.lit(window)).cast("double")
    exposure = F.col("span") * width / F.greatest(seen, F.lit(1))
    expected = F.col("at_risk") * F.greatest(F.col("other_n"), F.lit(0.5)) / F.greatest(exposure, F.lit(1.0))
    tested = around.withColumn("expected", expected).withColumn("p_value", F.pandas_udf(_p_values, "double")(F.col("n").cast("double"), F.col("expected")))
    tested = cut_lineage(tested.select(source, length, "n", "expected", "p_value"))
    tests = tested.count()  # every length of every source is a test
    kept, last = tested.filter((F.col("n") >= least) & (F.col("n") >= 2 * F.col("expected"))), None
    threshold = rate
    while threshold != last:
        below = tested.filter(F.col("p_value") <= threshold).count()
        threshold, last = rate * below / max(tests, 1), threshold
    return kept.filter(F.col("p_value") <= threshold)
