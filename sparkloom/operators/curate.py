"""Cleaning, normalising and gating of training records; one annotated frame instead of kept and rejected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import asm
from ..functions.text import filled, first_match, or_empty, strip

_KINDS = r"(LOCAL|LONG|JUMP\s*LOCATION|ALTERNATE\s*ENTRY\s*POINT|DATA|MAIN\s*ENTRY\s*POINT)?\.?"
# Markers of disassembly files, removed from instructions, in this order.
MARKERS = [r";\s*\*?\$[0-9A-Fa-f]+-\$[0-9A-Fa-f]+\s*" + _KINDS, r"\*\$[0-9A-Fa-f]+-\$[0-9A-Fa-f]+\s*" + _KINDS, r"={4,}", r"-{4,}", r";\s*TODO\s*$", r";\s*\$[0-9A-Fa-f]+\s*$"]
# The opening that generated instructions share, and what tells code from prose.
ROUTINE_PREFIX = "write a 65816 routine that"
CODE_SIGNS = ["$", "LDA", "STA", "JSR", "JSL", "RTS", "RTL", "#$", "db ", "dw "]
RELAXED_SIGNS = [*CODE_SIGNS, ";", "namespace"]
_ORG = r"(?i)\borg\s+\$[0-9A-Fa-f]+\b"


def clean_instruction(c: Column, profile: str = "dataset") -> Column:
    """An instruction without file markers, origin directives, runs of blanks and trailing ``,;:``.

    ``profile='augment'`` keeps origins and instead deletes all that follows the word TODO.
    """
    out = c
    for pattern in MARKERS[:5] if profile == "augment" else MARKERS:
        out = F.regexp_replace(out, "(?i)" + pattern, "")
    out = F.regexp_replace(out, r"(?is)\bTODO\b.*$", "") if profile == "augment" else F.regexp_replace(out, _ORG, "")
    return strip(F.regexp_replace(strip(F.regexp_replace(out, r"\s+", " ")), r"[\s,;:]+$", ""))


def strip_addresses(c: Column) -> Column:
    """An instruction without origins, addresses and the letters ``org`` wherever they stand."""
    out = F.regexp_replace(F.regexp_replace(c, _ORG, ""), r"\$[0-9A-Fa-f]{4,6}\b", "")
    return strip(F.regexp_replace(F.replace(out, F.lit("org"), F.lit("")), r"[\s,;:]+", " "))


def normalize_instruction(instruction: Column, output: Column) -> Column:
    """struct(instruction, cleaned, generated_kind): cleaned, or made from the output's first label; '' if neither."""
    cleaned = clean_instruction(instruction)
    rest = strip(F.substring(cleaned, len(ROUTINE_PREFIX) + 1, 1_000_000_000))
    worded = F.regexp_replace(strip_addresses(rest), r"^[ .;:-]+|[ .;:-]+$", "").rlike("[A-Za-z]")
    sentence = F.concat(F.lit("Write a 65816 routine that "), F.regexp_replace(rest, r"^[ .;:-]+|[ .;:-]+$", ""), F.lit("."))
    kept = F.when(~F.lower(cleaned).startswith(ROUTINE_PREFIX), cleaned).when(worded, sentence).otherwise("")
    label, kind = asm.first_label(output), asm.output_kind(output)
    made = F.when(label.isNull() | (label == ""), "").when(kind == "data", F.concat(F.lit("Define the ASM data table "), label, F.lit("."))).otherwise(F.concat(F.lit("Write a 65816 routine named "), label, F.lit(".")))
    return F.struct(
        F.when(kept != "", kept).otherwise(made).alias("instruction"),
        (cleaned != instruction).alias("cleaned"),
        F.when((kept == "") & (made != ""), kind).alias("generated_kind"),
    )


def infer_domain(instruction: Column) -> Column:
    low = F.lower(instruction)
    return first_match([(low.startswith("summarize") & F.contains(low, F.lit("asm change")), "asm-git"), (low.startswith("summarize"), "asm-comment"), (low.startswith("write a 65816 routine"), "asm-generate")], "asm")


def normalize_records(df: DataFrame, default_source: str = "unknown", drop_todo: bool = True, parse_error: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """``df`` with instruction, output, domain and source normalised, and ``reject_reason`` (null: kept).

    With ``metadata``, a map of texts, it comes out merged with what was done to the record; its own entries win.

    Reasons, the first that holds: parse_error, drop_missing_output, drop_empty_instruction,
    drop_todo_instruction. Null texts count as empty; a blank domain is inferred from the instruction.
    """
    output = strip(or_empty(F.col("output")))
    raw = strip(or_empty(F.col("instruction")))
    step = df.withColumn("_raw", raw).withColumn("output", output)
    step = step.withColumn("_n", normalize_instruction(F.col("_raw"), F.col("output")))
    text = F.col("_n.instruction")
    reason = F.when(parse_error if parse_error is not None else F.lit(False), "parse_error").when(F.col("output") == "", "drop_missing_output").when(text == "", "drop_empty_instruction")
    if drop_todo:
        reason = reason.when(F.contains(F.lower(text), F.lit("todo")), "drop_todo_instruction")
    done = []
    if metadata is not None:
        flags = F.map_filter(F.create_map(F.lit("instruction_cleaned"), F.when(F.col("_n.cleaned"), "true"), F.lit("generated_kind"), F.col("_n.generated_kind")), lambda _, v: v.isNotNull())
        done = [merge_metadata(flags, metadata).alias("metadata")]
    return step.select(
        *(c for c in df.columns if c not in ("instruction", "output", "domain", "source") and not (done and c == "metadata")), *done,
        text.alias("instruction"), "output", filled(F.col("domain"), infer_domain(text)).alias("domain"), filled(F.col("source"), default_source).alias("source"),
        F.col("_n.cleaned").alias("instruction_cleaned"), F.col("_n.generated_kind").alias("generated_kind"), reason.alias("reject_reason"),
    )


def merge_metadata(new: Column, legacy: Column) -> Column:
    """Two maps in one; entries of ``legacy`` win. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    keep = F.map_filter(F.coalesce(new, empty), lambda k, _: ~F.coalesce(F.map_contains_key(F.coalesce(legacy, empty), k), F.lit(False)))
    return F.map_concat(keep, F.coalesce(legacy, empty))


def reject_stats(annotated: DataFrame) -> DataFrame:
    """Rows by reject reason, ``kept`` for none."""
    return annotated.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def quality_gate(instruction: Column, output: Column, least_output: int = 50, least_instruction: int = 10, signs: list[str] | None = None) -> Column:
    """Whether a record is substantial and holds code: lengths first, as they are cheap. Null counts as ''."""
    body = or_empty(output)
    code = F.lit(False)
    for s in signs or CODE_SIGNS:
        code = code | F.contains(body, F.lit(s))
    return (F.length(body) >= least_output) & (F.length(or_empty(instruction)) >= least_instruction) & code


def at_least(score: Column, threshold: float) -> Column:
    """Score threshold; a missing score counts as 0."""
    return F.coalesce(score, F.lit(0.0)) >= threshold


def preview(c: Column, most: int, suffix: str = "...", keep: int | None = None) -> Column:
    """A text of more than ``most`` code points cut to ``keep`` with a suffix; others as they are."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, keep or most), F.lit(suffix))).otherwise(c)


def fenced_code(c: Column, languages: tuple[str, ...] = ("asm", "65816")) -> Column:
    """The first fenced block, languages in order of preference, then any block, then the text itself."""
    options = [F.nullif(F.regexp_extract(c, rf"(?s)```{name}[ \t]*\n(.*?)(?:```|$)", 1), F.lit("")) for name in languages]
    return strip(F.coalesce(*options, F.nullif(F.regexp_extract(c, r"(?s)```[^\n]*\n(.*?)(?:```|$)", 1), F.lit("")), c))


def diff_window(diff: Column, least: int = 5, most: int = 200) -> Column:
    """A diff of ``least`` lines or more cut to ``most`` lines; null for a shorter one."""
    ls = F.split(diff, "\n", -1)
    return F.when(F.size(ls) < least, F.lit(None)).otherwise(F.array_join(F.slice(ls, 1, most), "\n"))



def chars_at_least(text: Column, least: int) -> Column:
    """Whether a text has ``least`` code points; null has none."""
    return F.length(or_empty(text)) >= least


def selected(category: Column, difficulty: Column, tags: Column, wanted: str | None = None, level: str | None = None, any_tag: list[str] | None = None) -> Column:
    """Whether a case is of a category, of a difficulty and has any of some tags; what is not given is not asked for."""
    test = F.lit(True)
    if wanted is not None:
        test = test & F.coalesce(category == wanted, F.lit(False))
    if level is not None:
        test = test & F.coalesce(difficulty == level, F.lit(False))
    if any_tag:
        test = test & F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, any_tag))), F.lit(False))
    return test


def labelled(label: Column, tags: Column, word: str) -> Column:
    """Whether a label holds a word, case ignored, or a tag is that word."""
    return F.contains(F.lower(or_empty(label)), F.lit(word.lower())) | F.coalesce(F.array_contains(tags, word), F.lit(False))


def scan_status(chars: Column, error: Column, least: int = 200) -> Column:
    """The status of a scanned document in its manifest: failed, short (too little text) or ok."""
    return F.when(or_empty(error) != "", "failed").when(F.coalesce(chars, F.lit(0)) < least, "short").otherwise("ok")
