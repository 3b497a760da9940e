"""Files as tables: JSON lines with bad lines kept, texts, documents' bytes, logs; and the sinks."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines, strip

# Folders that are never searched.
EXCLUDED = ["node_modules", ".git", ".venv", "venv", "__pycache__", "build", "dist"]


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, drop_bad: bool = False) -> DataFrame:
    """JSON lines by ``schema`` with ``src_file`` and ``_corrupt_record``; blank lines are skipped.

    A line that is no JSON object is kept with its text in ``_corrupt_record``, or with ``drop_bad`` left
    out. Bytes that are no UTF-8 are replaced.
    """
    text = spark.read.text(path).filter(strip(F.col("value")) != "").select("value", F.input_file_name().alias("src_file"))
    parsed = F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = text.select(parsed.alias("_r"), "src_file").select("_r.*", "src_file")
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record") if drop_bad else df


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(src_file, src_pos, value): lines with their number in the file, blank ones left out.

    Files are read whole, which gives every line its place; files must fit an executor's memory.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("src_file"), F.posexplode(lines(F.col("value"))).alias("src_pos", "value"))
    return whole.filter(strip(F.col("value")) != "")


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each JSON file, which may span lines."""
    return spark.read.option("multiLine", True).json(path)


def index_files(spark: SparkSession, roots: list[str], pattern: str = "*", excluded: list[str] | None = None, max_bytes: int | None = None, content: bool = False, skip: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(path, name, extension, bytes, mtime[, content, md5]) below the roots, hidden and excluded folders left out, and paths that hold a text of ``skip``.

    With ``most`` only the first files in order of their path come out.
    """
    parts = F.split(F.lower("path"), "/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    df = reader.load(roots).filter(~F.arrays_overlap(parts, F.array(*(F.lit(x.lower()) for x in excluded or EXCLUDED)))).filter(~F.exists(F.slice(parts, 2, 1000), lambda p: p.startswith(".")))
    for word in skip or []:
        df = df.filter(~F.contains(F.lower("path"), F.lit(word.lower())))
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    out = df.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)).alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    out = out.withColumn("md5", F.md5("content")) if content else out
    return out.orderBy("path").limit(most) if most is not None else out


def pdf_info(content: Column) -> Column:
    """struct(is_pdf, title, author) from the information dictionary in the first 2 MB of a PDF's bytes."""
    text = F.decode(F.substring(content, 1, 2_000_000), "ISO-8859-1")
    entry = lambda name: F.nullif(strip(F.regexp_extract(text, rf"(?s)/{name}\s*\((.*?)\)", 1)), F.lit(""))
    return F.struct(text.startswith("%PDF-").alias("is_pdf"), entry("Title").alias("title"), entry("Author").alias("author"))


def marked_json(text: Column, start: str, end: str) -> Column:
    """JSON between two markers as VARIANT, null if absent or broken."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, f"(?s){start}(.*){end}", 1), F.lit("")))


def reply_json(text: Column, default: str | None = None) -> Column:
    """JSON of a reply, a code fence around it removed, as VARIANT; if broken, that of ``default``, or null."""
    bare = F.regexp_replace(strip(text), r"(?s)^```[a-z]*\s*|\s*```$", "")
    found = F.try_parse_json(F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")), bare))
    return F.coalesce(found, F.parse_json(F.lit(default))) if default is not None else found


_LOCATED = r"(?i)^(.+?):(\d+)(?::(\d+))?:[ \t]*error:[ \t]*(.+)$"
_LOOSE = r"(?i)error:[ \t]*(.+)$"


def compiler_errors(text: Column) -> Column:
    """array<struct(file, line, col, message)> of messages ``file:line[:col]: error: text``, then of other lines with ``error:``.

    The latter have file ``unknown`` and line 0; those whose text is part of a located message are left out.
    """
    part = lambda x, k: F.regexp_extract(x, _LOCATED, k)
    number = lambda x, k: F.nullif(part(x, k), F.lit("")).cast("int")
    each = lines(F.regexp_replace(text, "\r", ""))
    located = F.transform(
        F.filter(each, lambda x: x.rlike(_LOCATED)), lambda x: F.struct(part(x, 1).alias("file"), number(x, 2).alias("line"), number(x, 3).alias("col"), strip(part(x, 4)).alias("message"))
    )
    loose = F.filter(F.transform(F.filter(each, lambda x: x.rlike(_LOOSE)), lambda x: strip(F.regexp_extract(x, _LOOSE, 1))), lambda m: ~F.exists(located, lambda e: F.contains(e["message"], m)))
    return F.concat(located, F.transform(F.array_distinct(loose), lambda m: F.struct(F.lit("unknown").alias("file"), F.lit(0).alias("line"), F.lit(None).cast("int").alias("col"), m.alias("message"))))


def linker_symbols(text: Column) -> Column:
    """array<struct(address, name)> of lines ``bank:offset name``, the address as one number."""
    hits = F.filter(lines(text), lambda x: x.rlike(r"^[0-9A-Fa-f]{2}:[0-9A-Fa-f]{4} \S+"))
    return F.transform(hits, lambda x: F.struct(F.conv(F.concat(F.substring(x, 1, 2), F.substring(x, 4, 4)), 16, 10).cast("bigint").alias("address"), F.regexp_extract(x, r" (\S+)", 1).alias("name")))


def scan_log(text: Column) -> Column:
    """struct(networks, links, notes) of a wireless scan log, of the lines between ``#scanall`` and ``#stopscan``.

    Colour codes are removed. Networks have rssi, channel, bssid and essid, links a role and an address on
    either side; notes are lines on beacons and received configurations.
    """
    plain = F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")
    scan = F.regexp_extract(plain, r"(?sm)^[ \t]*#scanall[^\n]*\n(.*?)(?:^[ \t]*#stopscan|\z)", 1)
    each = F.filter(F.transform(lines(scan), strip), lambda x: x != "")
    network = r"^>?\s*RSSI:\s*(-?\d+)\s+Ch:\s*(\d+)\s+BSSID:\s*([0-9A-Fa-f:]{17})\s+ESSID:\s*(.*)$"
    link = r"^\d+:\s+(ap|sta):\s*([0-9A-Fa-f:]{17})\s+->\s+(ap|sta):\s*([0-9A-Fa-f:]{17})"
    part = F.regexp_extract
    return F.struct(
        F.transform(F.filter(each, lambda x: x.rlike(network)), lambda x: F.struct(part(x, network, 1).cast("int").alias("rssi"), part(x, network, 2).cast("int").alias("channel"), F.lower(part(x, network, 3)).alias("bssid"), strip(part(x, network, 4)).alias("essid"))).alias("networks"),
        F.transform(F.filter(each, lambda x: x.rlike(link)), lambda x: F.struct(part(x, link, 1).alias("left_role"), F.lower(part(x, link, 2)).alias("left_mac"), part(x, link, 3).alias("right_role"), F.lower(part(x, link, 4)).alias("right_mac"))).alias("links"),
        F.filter(each, lambda x: F.contains(x, F.lit("RXd WPS Configs")) | x.startswith("Beacon:")).alias("notes"),
    )


def read_messages(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(src_file, message_no, message): the entries of the list ``messages`` of each JSON file; a file that is no JSON gives none."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("src_file"), F.from_json("value", f"messages array<struct<{schema}>>").alias("_d"))
    return whole.select("src_file", F.posexplode("_d.messages").alias("message_no", "message"))


def missing_roots(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, error): a row for each root that does not exist."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = [(r, "missing") for r in roots if not fs.Path(r).getFileSystem(conf).exists(fs.Path(r))]
    return spark.createDataFrame(gone, "path string, error string")


def resolve_path(name: str, folders: list[str]) -> str | None:
    """The first of ``name`` itself and ``name`` in each folder that exists on the driver, null if none does."""
    return next((str(p) for p in [Path(name), *(Path(f) / name for f in folders)] if p.exists()), None)


def read_config(name: str, folders: list[str], defaults: dict | None = None) -> dict:
    """A TOML or JSON file found by :func:`resolve_path`, its tables laid over ``defaults``; the defaults alone if there is none."""
    found = resolve_path(name, folders)
    given = {}
    if found:
        given = tomllib.loads(Path(found).read_text()) if found.endswith(".toml") else json.loads(Path(found).read_text())
    out = dict(defaults or {})
    for key, value in given.items():
        out[key] = {**out[key], **value} if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows as JSON lines, columns in order, nulls left out; an existing folder is an error unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_normalized(annotated: DataFrame, path: str, overwrite: bool = False) -> dict[str, int]:
    """``path``/status=kept and status=rejected from one pass, and the counts by reason, which are also written to ``path``_report."""
    from ..operators.curate import reject_stats

    mode = "overwrite" if overwrite else "errorifexists"
    annotated.withColumn("status", F.when(F.col("reject_reason").isNull(), "kept").otherwise("rejected")).write.mode(mode).partitionBy("status").json(path)
    written = annotated.sparkSession.read.schema("reject_reason string, status string").json(path)
    counts = {r["reason"]: r["n"] for r in reject_stats(written).collect()}  # one row for each reason
    annotated.sparkSession.createDataFrame(list(counts.items()), "reason string, n bigint").coalesce(1).write.mode(mode).json(f"{path}_report")
    return counts


def write_index(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """An index or registry as JSON lines in order of its first column, ranges of it by file."""
    df.repartitionByRange(df.columns[0]).sortWithinPartitions(df.columns[0]).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def fixed_width(df: DataFrame, most: int = 200) -> str:
    """A small result as a console report; one of more than ``most`` rows is refused."""
    rows = [[("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    widths = [max(map(len, column)) for column in zip(df.columns, *rows)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in [df.columns, *rows])


def write_split(df: DataFrame, flag: str, path: str, overwrite: bool = False) -> None:
    """Rows as JSON lines in one folder for each value of ``flag``; an existing folder is an error unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(flag).json(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a markdown table; a report of more than ``most`` rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
