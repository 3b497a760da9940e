"""One text to many rows: sections, comment blocks, context windows, completion windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, seeded_order, seeded_uniform, strip


def sections(df: DataFrame, key: str, text: str, least: int = 120, most: int = 2000) -> DataFrame:
    """(key, section_no, title, body) of markdown texts: a section for each line that begins with ``#``.

    Text before the first heading is a section without title. Bodies are stripped, those under
    ``least`` code points left out and longer ones than ``most`` cut. A ``#`` inside fenced code begins
    a section too. Each text is split within its row: nothing is shuffled.
    """
    part = F.posexplode(F.split(F.col(text), r"(?md)^(?=#)")).alias("_p", "_c")
    cut = df.select(key, F.col(text).startswith("#").cast("int").alias("_first"), part).withColumn("section_no", (F.col("_p") + F.col("_first")).cast("bigint"))
    heading, rest = F.substring_index("_c", "\n", 1), F.when(F.contains("_c", F.lit("\n")), F.regexp_replace("_c", r"^[^\n]*\n", "")).otherwise("")
    titled = F.col("section_no") > 0
    each = cut.select(key, "section_no", F.when(titled, strip(F.regexp_replace(heading, "^#+", ""))).alias("title"), strip(F.when(titled, rest).otherwise(F.col("_c"))).alias("body"))
    return each.filter(F.length("body") >= least).withColumn("body", F.substring("body", 1, most))


def context(df: DataFrame, key: str, text: str, pattern: str, around: int = 2) -> DataFrame:
    """(key, line_no, line, before, after) of lines that match, with up to ``around`` lines on either side.

    Only the hits are exploded, each with its own few lines.
    """
    ls = df.filter(F.col(text).rlike(f"(?md){pattern}")).select(key, lines(F.col(text)).alias("_l"))
    at = F.array_compact(F.transform("_l", lambda x, i: F.when(x.rlike(pattern), i)))

    def hit(i: Column) -> Column:
        start = F.greatest(i - around, F.lit(0))
        before, after = F.slice(F.col("_l"), start + 1, i - start), F.slice(F.col("_l"), i + 2, F.lit(around))
        return F.struct(i.alias("line_no"), F.get("_l", i).alias("line"), F.array_join(before, "\n").alias("before"), F.array_join(after, "\n").alias("after"))

    return ls.select(key, F.explode(F.transform(at, hit)).alias("_h")).select(key, "_h.*")


_LABEL_LINE = r"(?md)^(?=[ \t\r\f]*[A-Za-z_][A-Za-z0-9_]*:[ \t\r\f]*$)"


def commented_blocks(df: DataFrame, key: str, text: str, most_lines: int = 40) -> DataFrame:
    """(key, block_no, label, comment, code): labels with the comment lines directly above and the code up to the next label.

    ``block_no`` counts the labels of a text. Code keeps its first ``most_lines`` lines that are neither
    blank nor a comment. Labels without a comment or without code are left out. Each text is split at
    its labels within its row: nothing is shuffled.
    """
    chunks = df.select(key, F.split(F.col(text), _LABEL_LINE).alias("_c")).filter(F.size("_c") > 0)
    # Text that begins with a label has nothing before it.
    chunks = chunks.withColumn("_c", F.when(F.element_at("_c", 1).rlike(r"^[ \t\r\f]*[A-Za-z_][A-Za-z0-9_]*:[ \t\r\f]*(\n|$)"), F.concat(F.array(F.lit("")), "_c")).otherwise(F.col("_c")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: F.struct(i.alias("block_no"), F.get("_c", i - 1).alias("above"), F.get("_c", i).alias("own")))
    rows = chunks.filter(F.size("_c") > 1).select(key, F.explode(pairs).alias("_p")).select(key, "_p.*")
    run = F.regexp_extract("above", r"(?:^|\n)((?:[ \t\r\f]*;[^\n]*\n)+)\z", 1)
    comment = F.array_join(F.transform(F.filter(lines(run), lambda x: x != ""), lambda x: strip(F.regexp_replace(strip(x), "^;+", ""))), " ")
    body = F.filter(F.slice(lines(F.col("own")), 2, 1_000_000_000), lambda x: (strip(x) != "") & ~strip(x).startswith(";"))
    found = rows.select(key, "block_no", F.regexp_extract("own", r"^[ \t\r\f]*([A-Za-z_][A-Za-z0-9_]*):", 1).alias("label"), run.alias("_run"), comment.alias("comment"), F.array_join(F.slice(body, 1, most_lines), "\n").alias("code"))
    return found.filter((F.col("_run") != "") & (F.col("code") != "")).drop("_run")


def completion_windows(df: DataFrame, key: str, text: str, per_text: int = 3, prefix: int = 400, completion: int = 80, suffix: int = 200, seed: int = 42) -> DataFrame:
    """(key, attempt, prefix, completion, suffix): windows at seeded places; the prefix keeps its tail, the others their head.

    Texts of fewer than ``prefix`` / 4 code points give none. The place depends on key, attempt and seed only.
    """
    tries = df.filter(F.length(text) >= prefix // 4).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(per_text - 1))))
    at = F.floor(seeded_uniform(seed, F.col(key), F.col("attempt")) * (F.length(text) - 1)).cast("int") + 1
    cut = tries.withColumn("_at", at)
    begin = F.greatest(F.col("_at") - prefix, F.lit(0))
    return cut.select(
        key, "attempt",
        F.substring(F.col(text), begin + 1, F.col("_at") - begin).alias("prefix"),
        F.substring(F.col(text), F.col("_at") + 1, F.lit(completion)).alias("completion"),
        F.substring(F.col(text), F.col("_at") + 1 + completion, F.lit(suffix)).alias("suffix"),
    )


def trim_tokens(prefix: Column, completion: Column, suffix: Column, most: int) -> Column:
    """struct of three token arrays of ``most`` tokens in all: first the head of the prefix goes, then the tail of the suffix, then of the completion."""
    over = F.greatest(F.size(prefix) + F.size(completion) + F.size(suffix) - most, F.lit(0))
    from_prefix = F.least(over, F.size(prefix))
    from_suffix = F.least(over - from_prefix, F.size(suffix))
    from_completion = over - from_prefix - from_suffix
    return F.struct(
        F.slice(prefix, from_prefix + 1, F.size(prefix) - from_prefix).alias("prefix"),
        F.slice(completion, F.lit(1), F.size(completion) - from_completion).alias("completion"),
        F.slice(suffix, F.lit(1), F.size(suffix) - from_suffix).alias("suffix"),
    )


def abstract(text: Column, most: int = 1200) -> Column:
    """What stands between the word Abstract and the introduction or keywords, white space collapsed, cut with ``...``."""
    body = F.regexp_extract(text, r"(?is)\babstract\b[\s:.\-]*(.*?)(?:\n\s*(?:\d+\.?\s*)?(?:introduction|keywords|index terms)\b|$)", 1)
    flat = strip(F.regexp_replace(body, r"\s+", " "))
    return F.nullif(F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat), F.lit(""))


def paraphrases(df: DataFrame, key: str, text: str, templates: list[tuple[str, str]], n: int = 3, seed: int = 42) -> DataFrame:
    """(key, style, variant): the text itself and ``n`` - 1 templates in a seeded order, one of each style first and then any.

    ``templates`` are (style, text with ``{}``). Variants that repeat an earlier one but for case are left out
    before they are counted. All is chosen within the row; null texts give none.
    """
    styles: dict[str, list[str]] = {}
    for style, template in templates:
        styles.setdefault(style, []).append(template)
    order = lambda style, t: seeded_order(seed, F.col(key), F.lit(style), F.lit(t))
    entry = lambda o, style, variant: F.struct(o.alias("o"), F.lit(style).alias("style"), variant.alias("variant"))
    tiered = [
        F.transform(F.array_sort(F.array(*(entry(order(style, t), style, F.replace(F.lit(t), F.lit("{}"), F.col(text))) for t in group))), lambda x, i: F.struct((i > 0).alias("more"), x["o"].alias("o"), x["style"].alias("style"), x["variant"].alias("variant")))
        for style, group in styles.items()
    ]
    base = F.array(F.struct(F.lit(False).alias("more"), F.lit("").alias("o"), F.lit("original").alias("style"), F.col(text).alias("variant")))
    rows = df.filter(F.col(text).isNotNull()).select(key, F.array_sort(F.concat(base, *tiered)).alias("_v"))
    rows = rows.withColumn("_w", F.transform("_v", lambda x: F.lower(x["variant"])))
    first = F.filter("_v", lambda x, i: F.array_position("_w", F.lower(x["variant"])) == i + 1)
    return rows.select(key, F.explode(F.slice(first, 1, n)).alias("_c")).select(key, F.col("_c.style").alias("style"), F.col("_c.variant").alias("variant"))


# The parts of an assistant's message that tell its state, in order.
STATE_PARTS = [r"### Current Status:.*?(?=###|\z)", r"### Details:.*?(?=###|\z)", r"### Errors:.*?(?=###|\z)", r"### Next Steps:.*?(?=###|\z)", r"Decision:.*?(?=\n\n|\z)"]


def state_sections(content: Column) -> Column:
    """The first part of each kind that tells a state, stripped and joined by blank lines; '' without any."""
    parts = [F.nullif(strip(F.regexp_extract(content, f"(?is)({p})", 1)), F.lit("")) for p in STATE_PARTS]
    return F.concat_ws("\n\n", *parts)
