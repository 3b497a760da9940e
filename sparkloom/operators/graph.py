"""Knowledge-graph checks and priority joins, rewritten from theta joins to equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small
from .dedup import distinct_ignoring_case



def node_keys(nodes: DataFrame) -> DataFrame:
    """(lookup) of nodes (id, name): the id, the name and what follows the last colon of the id, lower case."""
    keys = F.array(F.lower("id"), F.lower("name"), F.lower(F.substring_index("id", ":", -1)))
    return nodes.select(F.explode(F.array_distinct(F.array_compact(keys))).alias("lookup")).distinct()


def coverage(mentions: DataFrame, key: str, entities: str, nodes: DataFrame, validated: str | None = None, least: float = 0.3) -> DataFrame:
    """(key, mentioned, found, missing, coverage, low, score) of an array of entities by record.

    coverage is found / mentioned, 1 if nothing is mentioned, and ``low`` below ``least``, which is a warning
    or a strict validator's error; score = min(1, coverage + 0.3), 0.1 more (1 at most) if the record is
    tagged as validated, less 0.05 for each missing entity but not below 0.3. Entities are compared without
    case; repeats count once; null arrays mention nothing.
    """
    tagged = F.coalesce(F.col(validated), F.lit(False)) if validated else F.lit(False)
    base = mentions.select(key, tagged.alias("_v"), F.array_distinct(F.transform(F.coalesce(F.col(entities), F.expr("cast(array() as array<string>)")), F.lower)).alias("_e"))
    each = base.select(key, F.explode("_e").alias("lookup"))
    found = each.join(broadcast_if_small(node_keys(nodes)), "lookup", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    n = F.size("_e")
    joined = base.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    cover = F.when(n == 0, 1.0).otherwise(F.col("found") / n)
    lifted = F.least(F.least(cover + 0.3, F.lit(1.0)) + F.when(F.col("_v") & (n > 0), 0.1).otherwise(0.0), F.lit(1.0))
    missing = n - F.col("found")
    score = F.when(missing > 0, F.greatest(lifted - missing * 0.05, F.lit(0.3))).otherwise(lifted)
    return joined.select(key, n.alias("mentioned"), "found", missing.alias("missing"), cover.alias("coverage"), ((n > 0) & (cover < least)).alias("low"), score.alias("score"))


def neighbours(edges: DataFrame, entity: str) -> DataFrame:
    """Edges (source, target, relation) that name an entity: outgoing by source, else incoming by target."""
    e = entity.lower()
    out, into = F.contains(F.lower("source"), F.lit(e)), F.contains(F.lower("target"), F.lit(e))
    return edges.withColumn("direction", F.when(out, "outgoing").when(into, "incoming")).filter("direction is not null")


def suggestions(nodes: DataFrame, text: str, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` nodes whose name holds a text."""
    return nodes.filter(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy(order).limit(n)


def override(catalog: DataFrame, overrides: DataFrame, keys: list[str], row_key: str, fields: list[str]) -> DataFrame:
    """``catalog`` with non-empty ``fields`` taken from the override found under the first of ``keys``.

    ``overrides`` has ``override_key`` and the fields. The keys are exploded with their rank and joined by
    equality, which spares the nested loop of an OR of four conditions.
    """
    tries = catalog.select(row_key, F.posexplode(F.array(*(F.col(k).cast("string") for k in keys))).alias("rank", "override_key")).filter("override_key is not null")
    hit = tries.join(broadcast_if_small(overrides), "override_key").groupBy(row_key).agg(F.min_by(F.struct(*fields), "rank").alias("_o"))
    joined = catalog.join(hit, row_key, "left")
    new = {f: F.coalesce(F.nullif(F.col(f"_o.{f}"), F.lit("")), F.col(f)) for f in fields}
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in catalog.columns))


def manifest_diff(expected: DataFrame, actual: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """(key, status): missing, extra, size_mismatch, corrupted or verified, by one full outer join."""
    a = actual.select(F.col(key).alias("_k"), F.col(size).alias("_s"), F.col(digest).alias("_d"))
    both = expected.join(a, F.col(key) == F.col("_k"), "full_outer")
    status = F.when(F.col("_k").isNull(), "missing").when(F.col(key).isNull(), "extra").when(~F.col(size).eqNullSafe(F.col("_s")), "size_mismatch").when(~F.col(digest).eqNullSafe(F.col("_d")), "corrupted").otherwise("verified")
    return both.select(F.coalesce(key, "_k").alias(key), status.alias("status"))


def registry(files: DataFrame, directory: str, name: str, size: str, mtime: str, required: list[str]) -> DataFrame:
    """Directories that hold one of ``required`` file names: files, size, latest change and which required files they hold.

    The list holds required names only, so that it does not grow with a directory.
    """
    known = F.when(F.col(name).isin(required), F.col(name))
    each = files.groupBy(directory).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.max(mtime).alias("latest"), F.array_sort(F.collect_set(known)).alias("found"))
    return each.filter(F.size("found") > 0)


def inventory(files: DataFrame, directory: str, name: str, size: str, flags: dict[str, str], checkpoint: str = r"^checkpoint-(\d+)$") -> DataFrame:
    """Model folders: total size, ``has_<flag>`` for each file pattern of ``flags``, and the numbers of their checkpoints."""
    number = F.nullif(F.regexp_extract(name, checkpoint, 1), F.lit("")).cast("bigint")
    return files.groupBy(directory).agg(
        F.sum(size).alias("bytes"), *(F.bool_or(F.col(name).rlike(p)).alias(f"has_{k}") for k, p in flags.items()), F.array_sort(F.collect_set(number)).alias("checkpoints")
    )


def manifest_totals(files: DataFrame, size: str) -> DataFrame:
    """One row: files and bytes of a manifest."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


# Patterns of entity names in any text, then in listings and in C++ code.
ENTITY_PATTERNS = [
    r"`([A-Z][a-zA-Z0-9_]+)`",
    r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b",
    r"\b(Link_[A-Za-z0-9_]+)\b",
    r"\b(Player_[A-Za-z0-9_]+)\b",
    r"\b(Sprite_[A-Za-z0-9_]+)\b",
    r"\b(Module_[A-Za-z0-9_]+)\b",
    r"\b([A-Z][A-Za-z0-9]+_[A-Z][A-Za-z0-9]+)\b",
]
ASM_ENTITIES = [r"\b([A-Z][a-z]+_[A-Z][a-z_0-9]+)\b", r"@([A-Za-z_][A-Za-z0-9_]+)"]
CPP_ENTITIES = [r"\bclass\s+([A-Z][a-zA-Z0-9_]+)\b", r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)::\w+"]
# How code names routines and symbols.
ROUTINE_REFERENCES = [r"(?i)\b(?:JSR|JSL|JMP|JML)\s+([A-Za-z_][A-Za-z0-9_]+)\b", r"(?i)\b(?:BRA|BRL|BEQ|BNE|BCC|BCS|BMI|BPL)\s+([A-Za-z_][A-Za-z0-9_]+)\b"]
SYMBOL_REFERENCES = [r"(?i)\b(?:LDA|LDX|LDY|STA|STX|STY)\s+([A-Za-z_][A-Za-z0-9_]+)\b"]


def _all(text: Column, patterns: list[str]) -> Column:
    return F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 1) for p in patterns)))


def entities(text: Column, domain: Column | None = None) -> Column:
    """Names in a text, in order of pattern and place, without repeats but for case; further ones by domain."""
    found = _all(text, ENTITY_PATTERNS)
    if domain is not None:
        none = F.expr("cast(array() as array<string>)")
        found = F.concat(found, F.when(domain.startswith("asm"), _all(text, ASM_ENTITIES)).when(domain == "cpp", _all(text, CPP_ENTITIES)).otherwise(none))
    return distinct_ignoring_case(found)


def routine_references(code: Column) -> Column:
    """Routines and labels that a listing jumps or branches to, each once, sorted."""
    return F.array_sort(F.array_distinct(_all(code, ROUTINE_REFERENCES)))


def symbol_references(code: Column) -> Column:
    """Symbols that a listing loads or stores, each once, sorted."""
    return F.array_sort(F.array_distinct(_all(code, SYMBOL_REFERENCES)))


def unknown_references(df: DataFrame, key: str, references: Column, known: DataFrame) -> DataFrame:
    """(key, reference) of references that ``known`` (lookup, lower case) does not hold."""
    each = df.select(key, F.explode(references).alias("reference"))
    return each.join(broadcast_if_small(known), F.lower("reference") == known["lookup"], "left_anti")


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default: Column | str | float) -> DataFrame:
    """``df`` with ``value`` from ``lookup`` by ``key``, ``default`` where it has none."""
    side = lookup.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    joined = df.join(broadcast_if_small(side), F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn(value, F.coalesce("_v", default if isinstance(default, Column) else F.lit(default))).drop("_k", "_v")


def listing_with_state(entries: DataFrame, log: DataFrame, key: str, order: str, state: str, gone: str) -> DataFrame:
    """``entries`` with the latest state of an append log; those whose state is ``gone`` are left out, unknown ones are ``untracked``."""
    last = log.groupBy(key).agg(F.max_by(state, order).alias(state))
    return entries.join(last, key, "left").withColumn(state, F.coalesce(state, F.lit("untracked"))).filter(F.col(state) != gone)


def active(expires_at: Column, now: Column | None = None) -> Column:
    """Whether something has not expired; no expiry means active."""
    return expires_at.isNull() | (expires_at > (now if now is not None else F.current_timestamp()))
