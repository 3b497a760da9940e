"""Structured Streaming jobs: ingest of datagrams, current state, windowed and session rollups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(raw: DataFrame, value: str = "value") -> DataFrame:
    """Datagrams (bytes or text) to rows: received_at, kind, body (VARIANT), raw and error (``invalid_json``) if it is none."""
    text = F.col(value).cast("string")
    body = F.try_parse_json(text)
    return raw.select(F.current_timestamp().alias("received_at"), F.try_variant_get(body, "$.kind", "string").alias("kind"), body.alias("body"), F.when(body.isNull(), text).alias("raw"), F.when(body.isNull(), "invalid_json").alias("error"))


def is_scan(kind: Column, body: Column) -> Column:
    """Whether a datagram is a scan: by its kind or by the keys it holds."""
    keys = [F.try_variant_get(body, f"$.{k}", "variant").isNotNull() for k in ("networks", "links", "stations")]
    return F.coalesce(kind.isin("scan", "wifi_scan", "network_scan"), F.lit(False)) | keys[0] | keys[1] | keys[2]


def windowed(events: DataFrame, ts: str, key: str, value: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and sum by tumbling window and key; event time is cast, as watermarks need TIMESTAMP."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    each = timed.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return each.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions by key that end after ``gap`` without an event."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    each = timed.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return each.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), key, "n")


def append(df: DataFrame, path: str, checkpoint: str, partition: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """An append-only Parquet log; with ``available_now`` it ends when what is there has been read."""
    w = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    w = w.partitionBy(*partition) if partition else w
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


#: Parts that a state is cut into by a hash of its keys; a batch rewrites only those it touches.
STATE_PARTS = 64


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each part that a state folder holds, in ascending order."""
    fs, root = _folder(spark, path)
    found: dict[int, list[int]] = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith("v="):
            for part in fs.listStatus(status.getPath()):
                if part.getPath().getName().startswith("part="):
                    found.setdefault(int(part.getPath().getName()[5:]), []).append(int(name[2:]))
    return {part: sorted(versions) for part, versions in found.items()}


def _folder(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def read_state(spark: SparkSession, path: str, schema, before: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
    """The latest version of each part of a state (or the latest ``before`` a batch), null if there is none."""
    chosen = []
    for part, versions in _versions(spark, path).items():
        usable = [v for v in versions if before is None or v < before]
        if usable and (parts is None or part in parts):
            chosen.append(f"{path}/v={usable[-1]}/part={part}")
    return spark.read.schema(schema).parquet(*chosen) if chosen else None


def current_state(df: DataFrame, keys: list[str], order: str, path: str, checkpoint: str) -> StreamingQuery:
    """The latest row by key, kept in ``path``/v=<batch>/part=<hash of the keys>; see :func:`read_state`.

    Each batch is merged with the versions before it of the parts that it touches and writes only these; of
    each part the last two versions stay. A batch that is run again after a failure writes the same
    version again. A folder that holds the state of another checkpoint is refused.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        columns, held = batch.columns, _versions(spark, path)
        if any(v > number for versions in held.values() for v in versions):
            raise ValueError(f"{path} holds the state of another checkpoint")
        part = F.pmod(F.xxhash64(*keys), F.lit(STATE_PARTS)).cast("int")
        best = lambda rows: rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*(F.col(f"r.`{c}`").alias(c) for c in columns))
        fresh = best(batch).withColumn("part", part).persist()
        touched = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most STATE_PARTS
        old = read_state(spark, path, batch.schema, number, touched)
        rows = fresh.drop("part")
        merged = rows if old is None else best(rows.unionByName(old))
        merged.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/v={number}")
        fresh.unpersist()
        fs, _ = _folder(spark, path)
        for p in touched:
            for v in [v for v in held.get(p, []) if v < number][:-1]:
                fs.delete(_folder(spark, f"{path}/v={v}/part={p}")[1], True)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Every batch to several sinks by name; each gets the rows and the batch's number, so that it can write once only."""

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, number)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Handlers:
    """Event handlers by kind: each turns the rows of its kind into metrics (key, metric, value).

    Counts, sums and rates that need no order are kept by streaming aggregates in update mode; those that
    depend on the order of calls are in :func:`sparkloom.operators.events.tool_rollup`.
    """

    def __init__(self) -> None:
        self.entries: list[tuple[str, str, Callable[[], Column], Callable[[], Column]]] = []

    def on(self, kind: str, metric: str, key: Callable[[], Column], value: Callable[[], Column] = lambda: F.lit(1.0)) -> None:
        self.entries.append((kind, metric, key, value))

    def metrics(self, events: DataFrame, kind: str) -> DataFrame:
        """(metric, key, n, total) over all events whose ``kind`` column has a handler; works on batches and streams alike."""
        hits = F.array_compact(F.array(*(F.when(F.col(kind) == k, F.struct(F.lit(m).alias("metric"), key().cast("string").alias("key"), value().cast("double").alias("value"))) for k, m, key, value in self.entries)))
        each = events.select(F.explode(hits).alias("_h")).select("_h.*")
        return each.groupBy("metric", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
