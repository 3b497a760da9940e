"""Keyword classifiers and routers; rules are literals in the plan, never a joined table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, argmax, first_match, hits

# Keyword and pattern rules of the domain classifier, in order of precedence.
DOMAIN_RULES = {
    "farore_debug": (
        ["bug", "crash", "fix", "debug", "broken", "wrong value", "corrupt", "stack imbalance", "register mode", "mismatch", "why does", "doesn't work", "trace", "diagnose", "issue", "problem", "error"],
        [r"PHA.*without.*PL[AXY]", r"SEP.*REP", r"missing|forgot", r"crash|hang|freeze"],
        ["65816", "asm", "snes", "alttp", "zelda", "sprite", "routine"],
    ),
    "veran_hardware": (
        ["register", "dma", "hdma", "ppu", "vram", "oam", "cgram", "scanline", "mode 7", "palette", "tilemap", "vblank", "nmi", "$21", "$42", "$43", "vmain", "inidisp", "obsel", "bgmode"],
        [r"\$21[0-9A-F]{2}", r"\$42[0-9A-F]{2}", r"\$43[0-9A-F]{2}", r"DMA[0-7]", r"VRAM|OAM|CGRAM"],
        [],
    ),
    "din_optimize": (
        ["optimize", "optimization", "faster", "performance", "cycle", "cycles", "cycle count", "save cycles", "speed", "tighten", "micro-opt", "instruction count", "throughput", "latency"],
        [r"\boptimi[sz]e\b", r"\bperformance\b", r"\bcycle(?:s| count)?\b", r"\bfaster\b", r"\bspeed\b", r"\brefactor\b.*\b(speed|size)\b"],
        ["optimize", "optimization", "performance", "cycle", "cycles", "faster", "speed"],
    ),
    "nayru_codegen": (
        ["write", "create", "generate", "implement", "code for", "routine that", "function to", "how would i", "assembly for"],
        [r"^(Write|Create|Generate|Implement)"],
        [],
    ),
    "majora_oracle": (
        ["oracle", "oos", "time system", "mask system", "zsow", "zscream", "minecart", "ocarina", "lost woods", "ranch", "custom sprite"],
        [r"Oracle_", r"OOS_", r"ZS[OC]_", r"Mask_", r"Time_"],
        [],
    ),
    "agahnim_build": (
        ["asar", "hook", "namespace", "pushpc", "pullpc", "org", "incsrc", "bank", "include", "assert", "label"],
        [r"pushpc|pullpc", r"namespace\s+\w+", r"org\s+\$", r"incsrc"],
        [],
    ),
}
# Keyword pools of chat samples.
POOLS = {
    "oos": ["oracle", "secrets", "alttp", "zelda", "link", "overworld", "dungeon", "zsow", "zscream", "asar", "rom hack", "romhack", "sprite", "npc", "boss", "mask", "ocarina", "time system", "menu"],
    "asm": ["65816", "assembly", "asm", "sprite", "snes", "dma", "vram", "oam", "sta", "lda", "jsr", "jsl", "rts", "rtl", "rep", "sep", "branch", "register", "bank", "address", "opcode", "instruction"],
    "debug": ["fix", "bug", "debug", "crash", "issue", "error", "problem", "wrong", "broken", "regression", "stack", "corrupt", "overflow", "underflow"],
}
# First-match rules of the request router.
ROUTES = {
    "asm": ["asm", "65816", "snes", "bank", "org", "asar", "hook", "link.asm", "sprite"],
    "cpp": ["cpp", "c++", "cmake", "imgui", "ftxui", "yaze", "syshub", "pointer", "header"],
    "devops": ["vultr", "ssh", "deploy", "gpu", "a100", "instance", "root@", "scripts/"],
}
# Commit types by words of the subject.
COMMITS = {"bugfix": ["fix", "bug", "crash", "issue", "regression"], "feature": ["add", "implement", "feat", "new"], "refactor": ["refactor", "clean", "optimize"], "docs": ["doc", "update", "readme"]}
# File kinds by extension.
FILE_KINDS = {".asm": "asm", ".s": "asm", ".65s": "asm", ".65c": "asm", ".inc": "asm_include", ".md": "markdown", ".txt": "text", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".h": "header", ".cs": "csharp", ".pdf": "pdf"}
# Failure families of an assembler's messages, in order.
ERROR_FAMILIES = {
    "label": ["label", "symbol", "undefined", "redefined"],
    "macro": ["macro", "endmacro"],
    "directive": ["org", "base", "include", "incsrc", "incbin", "lorom", "hirom"],
    "addressing": ["addressing", "mode", "operand", "immediate", "direct"],
    "instruction": ["instruction", "opcode", "mnemonic", "unknown command"],
    "syntax": ["syntax", "parse", "expected", "unexpected"],
}
# Phrases that ask for an explanation.
_EXPLAIN = r"(?i)explain\s+(what|how|why)|what\s+(does|is)\s+(the\s+)?(address|memory|register)|describe\s+(the|how)|what\s+(is|are)\s+stored?\s+(in|at)|tell\s+me\s+about"


def domains(df: DataFrame, text: Column, rules: dict | None = None) -> DataFrame:
    """``df`` with ``domain`` and ``confidence`` of a text; see :func:`domain`.

    The text in lower case and each rule's score are columns of their own, so that they are made once a row.
    """
    rules = rules or DOMAIN_RULES
    low = df.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    scored = low.select(*df.columns, *(_score(F.col("_low"), *rule).alias(f"_s{k}") for k, rule in enumerate(rules.values())))
    best = argmax([(name, F.col(f"_s{k}")) for k, name in enumerate(rules)])
    return scored.withColumn("_b", best).select(*df.columns, F.col("_b.label").alias("domain"), F.least(F.col("_b.score") / 10, F.lit(1.0)).alias("confidence"))


def _score(low: Column, keywords: list[str], patterns: list[str], required: list[str]) -> Column:
    score = F.lit(0.0)
    for k in keywords:
        score = score + F.contains(low, F.lit(k.lower())).cast("double") * 2.0
    for p in patterns:  # case is ignored, so both sides are in lower case
        score = score + F.when(low.rlike(p.lower()), 3.0).otherwise(0.0)
    if not required:
        return score
    any_word = F.lit(False)
    for k in required:
        any_word = any_word | F.contains(low, F.lit(k.lower()))
    return F.when(any_word, score).otherwise(0.0)


def domain(text: Column, rules: dict | None = None) -> Column:
    """struct(domain, confidence) by arg-max: 2 for each keyword, 3 for each pattern, none without a required word.

    Equal scores go to the rule listed first, so a text without any hit gets the first rule at
    confidence 0; confidence is score / 10, at most 1. Null text counts as ''.
    """
    text = F.coalesce(text, F.lit(""))
    best = argmax([(name, _score(F.lower(text), *rule)) for name, rule in (rules or DOMAIN_RULES).items()])
    return F.struct(best["label"].alias("domain"), F.least(best["score"] / 10, F.lit(1.0)).alias("confidence"))


def pools(text: Column) -> Column:
    """Labels of a text: ``oos`` or else ``asm``, and independently ``debug``."""
    text = F.coalesce(text, F.lit(""))
    main = F.when(any_of(text, POOLS["oos"]), "oos").when(any_of(text, POOLS["asm"]), "asm")
    return F.array_compact(F.array(main, F.when(any_of(text, POOLS["debug"]), F.lit("debug"))))


def route(text: Column, rules: dict | None = None) -> Column:
    """The first rule with any keyword in the text, else general; null for texts under 10 code points."""
    return F.when(F.length(text) >= 10, first_match([(any_of(text, k), name) for name, k in (rules or ROUTES).items()], "general"))


def expert(text: Column, rules: dict, default: tuple[str, float]) -> Column:
    """struct(expert, share): the rule with the largest share of its keywords in the text, else ``default``."""
    best = argmax([(name, hits(F.coalesce(text, F.lit("")), k) / F.lit(float(len(k)))) for name, k in rules.items()])
    found = best["score"] > 0
    return F.struct(F.when(found, best["label"]).otherwise(default[0]).alias("expert"), F.when(found, best["score"]).otherwise(default[1]).alias("share"))


def chat_models(prompt: Column, rules: list[tuple[list[str], str]], strategy: Column, default: str | None) -> Column:
    """Models for a prompt: all for ``ensemble``, else that of the first rule with a keyword, the default or the first rule's.

    The prompt is lower-cased, the keywords are compared as they are written.
    """
    low = F.lower(F.coalesce(prompt, F.lit("")))
    out = F.when(strategy == "ensemble", F.array_distinct(F.array(*(F.lit(m) for _, m in rules))))
    for keywords, model in rules:
        test = F.lit(False)
        for k in keywords:
            test = test | F.contains(low, F.lit(k))
        out = out.when(test, F.array(F.lit(model)))
    return out.otherwise(F.array(F.lit(default or rules[0][1])) if default or rules else F.expr("cast(array() as array<string>)"))


def eval_category(prompt: Column) -> Column:
    return F.when(F.coalesce(prompt, F.lit("")).rlike(_EXPLAIN), "explanation").otherwise("code_generation")


def intent(instruction: Column) -> Column:
    """optimize, debug, hook or write, the first whose words occur."""
    t = F.coalesce(instruction, F.lit(""))
    return first_match(
        [
            (t.rlike(r"(?i)\b(optimize|improve|refactor|efficient)\b"), "optimize"),
            (t.rlike(r"(?i)\b(debug|fix|fail(ing)?|issue|error|bug)\b"), "debug"),
            (t.rlike(r"(?i)\b(hook|asar|patch)\b|\borg\s+\$[0-9A-Fa-f]{4,6}\b"), "hook"),
        ],
        "write",
    )


def commit_type(subject: Column) -> Column:
    return first_match([(any_of(F.coalesce(subject, F.lit("")), k), name) for name, k in COMMITS.items()], "other")


def error_family(message: Column) -> Column:
    return first_match([(any_of(F.coalesce(message, F.lit("")), k), name) for name, k in ERROR_FAMILIES.items()], "other")


def file_kind(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    return first_match([(extension == e, kind) for e, kind in FILE_KINDS.items()], "unknown")
