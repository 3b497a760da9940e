"""Session settings that every operator shares: reading tables, cutting lineage, sizing shuffles."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, once for each context.

    The driver serves a zip of a few hundred kB; where workers already have the package on their path
    the code is the same.
    """
    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._sparkloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of the data folder, pruned to ``columns`` when any are given."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder is used on a single machine; a cluster is refused, as
    its executors share no such folder.
    """
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a scan gives fewer tasks than there are cores, before Python stages.

    A small file is one task; a table of many splits is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes up to which a side of a join is sent to every executor.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, measure: bool = False) -> DataFrame:
    """``df`` with a broadcast hint if it is known to take at most ``max_bytes``, else ``df``.

    What Spark knows of the plan decides without running anything. With ``measure``, for frames that are
    already written, their rows and the bytes of their texts are counted. Beyond the bound the join is
    left to Spark, which shuffles it or broadcasts what turns out small.
    """
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known > max_bytes and measure:
        wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
        text = sum(wide[1:], wide[0]) if wide else F.lit(0)
        known = df.agg((F.count(F.lit(1)) * (32 + 16 * len(df.columns)) + F.coalesce(F.sum(text.cast("bigint")), F.lit(0))).alias("b")).first()["b"]
    return F.broadcast(df) if known <= max_bytes else df


#: Bits of the filter of :func:`maybe_among`, 16 MB when every bit is set.
FILTER_BITS = 1 << 27
_PAGE = 1 << 15


def maybe_among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be one of ``wanted``, before they are shuffled to be joined with it.

    A bit map of hashes, built in the cluster and broadcast in pages; its size is bounded by
    ``FILTER_BITS`` however many keys there are, and none of them is lost. Null keys are dropped.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit(97), c), F.lit(FILTER_BITS))
    pages = wanted.select(place(F.col(key)).alias("_at")).groupBy(F.expr(f"int(_at div {_PAGE})").alias("_page")).agg(F.bitmap_construct_agg(F.expr(f"_at % {_PAGE}")).alias("_bits"))
    at = df.filter(F.col(key).isNotNull()).withColumn("_at", place(F.col(key)))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, int((_at % {_PAGE}) div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("(shiftright(_byte, int(_at % 8)) & 1) = 1")
    return at.join(F.broadcast(pages), F.expr(f"int(_at div {_PAGE})") == F.col("_page")).withColumn("_byte", byte).filter(hit).select(*df.columns)


def with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row, by a cross join with that broadcast row."""
    return df.crossJoin(F.broadcast(total.limit(1)))


def norm_label(column):
    """Dirty labels as compared everywhere: trimmed, lower case, hyphens and blanks as underscores.

    Null stays null; a label of nothing but white space becomes ''.
    """
    trimmed = F.regexp_replace(F.lower(column), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(trimmed, r"(?U)[-\s]", "_")


def seeded(seed: int, *columns):
    """A uniform 64-bit order that is the same on every run, row layout and cluster."""
    return F.xxhash64(F.lit(seed), *columns)


def exact_rank(df: DataFrame, keys: list[str], order: str, tie: str, out: str, slices: int = 64) -> DataFrame:
    """The exact row number of each row within ``keys`` by (``order``, ``tie``), hot keys split.

    ``order`` holds hashes spread over the whole signed 64-bit range. A key's rows are cut into
    ``slices`` equal ranges of the hash; one aggregate counts them, a running sum over at most
    ``slices`` rows a key gives each range its offset, and the row number is only taken within a
    range. So no task gets more than about 1/``slices`` of the hottest key. Null keys form a group.
    """
    from pyspark.sql import Window as W

    part = F.floor(F.col(order).cast("double") / F.lit(2.0**64 / slices)).cast("int")
    cut = df.withColumn("_slice", part)
    sizes = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_slice").alias("_k_slice"), "_before")
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = W.partitionBy(*keys, "_slice").orderBy(order, tie)
    ranked = cut.withColumn("_in", F.row_number().over(inner)).join(broadcast_if_small(offsets), same)
    return ranked.withColumn(out, F.col("_in") + F.col("_before")).drop(
        "_slice", "_in", "_before", "_k_slice", *(f"_k_{k}" for k in keys)
    )
