"""Scorers and validators as expressions; a verdict is struct(valid, score, errors, warnings)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import asm
from ..functions.text import lines, or_empty, strip


def verdict(valid: Column, score: Column, errors: Column | None = None, warnings: Column | None = None) -> Column:
    none = F.expr("cast(array() as array<string>)")
    return F.struct(valid.alias("valid"), score.cast("double").alias("score"), F.coalesce(errors, none).alias("errors") if errors is not None else none.alias("errors"), F.coalesce(warnings, none).alias("warnings") if warnings is not None else none.alias("warnings"))


def hint(word: Column) -> Column:
    """`` (did you mean X?)`` with the first instruction one edit away from an unknown one, else ''."""
    near = F.filter(F.array(*map(F.lit, asm.MNEMONICS)), lambda m: F.levenshtein(word, m, 1) >= 0)
    # Instructions have three letters, so longer and shorter words are not compared with all of them.
    return F.when(F.length(word).between(2, 4), F.coalesce(F.concat(F.lit(" (did you mean "), F.try_element_at(near, F.lit(1)), F.lit("?)")), F.lit(""))).otherwise("")


def listing(code: Column, strict: bool = False, heads: Column | None = None) -> Column:
    """Share of known instructions, 0.1 more (1 at most) if a hardware register is named; 0.5 if there is none.

    An unknown instruction is a warning, or with ``strict`` an error. ``heads`` is a column that holds
    :func:`..functions.asm.instruction_heads` of the listing, where it has been made before.
    """
    code = or_empty(code)
    heads = asm.instruction_heads(code) if heads is None else heads
    found, known = F.size(heads), F.size(F.filter(heads, asm.is_mnemonic))
    bonus = F.when(F.upper(code).rlike("|".join(asm.REGISTERS)), 0.1).otherwise(0.0)
    score = F.when(found == 0, 0.5).otherwise(F.least(known / found + bonus, F.lit(1.0)))
    unknown = F.transform(F.array_sort(F.array_distinct(F.filter(heads, lambda w: ~asm.is_mnemonic(w)))), lambda w: F.concat(F.lit("unknown instruction "), w, hint(w)))
    none = F.when(found == 0, F.array(F.lit("no instruction"))).otherwise(unknown)
    return verdict((F.size(unknown) == 0) if strict else F.lit(True), score, unknown if strict else None, None if strict else none)


_HEAD = "(?mdi)^[ \\t\\r\\f]*((?:%s):*(?:[ \\t\\r\\f\\x0B][^\\n]*)?)$"
_INSTRUCTION = _HEAD % "|".join(asm.MNEMONICS)
_RETURN = _HEAD % "RTS|RTL|RTI"


def semantic_scores(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, instructions, modes, registers, returns, orphans, comment_ratio, score) of listings; null counts as ''.

    0.05 for each addressing mode (0.3 at most), 0.04 for each hardware register (0.2 at most), 0.2 for a
    return, 0.1 for a share of comment lines from 0.1 to 0.5, 0.2 for any instruction, less 0.1 if a label is
    never used. Patterns run over whole texts; what several of them read is a column of its own.
    """
    text = df.select(key, or_empty(F.col(code)).alias("_t"))
    bare = text.select(key, F.regexp_replace("_t", ";[^\n]*", "").alias("_b"), F.regexp_count("_t", F.lit(r"(?md)^[ \t\r\f]*;")).alias("_comments"))
    found = bare.select(
        key, "_comments", "_b", F.regexp_count("_b", F.lit(r"(?md)^[ \t\r\f]*[^ \t\r\f\n]")).alias("_lines"), F.regexp_extract_all("_b", F.lit(_INSTRUCTION), 1).alias("_inst"),
        F.regexp_replace("_b", r"(?md)^[ \t\r\f]*\S+", "").alias("_rest"),
    )
    parts = found.select(
        key, "_comments", "_lines", F.size("_inst").alias("instructions"), F.lower(F.array_join("_inst", "\n")).alias("_named"), F.col("_b").rlike(_RETURN).alias("returns"),
        F.array_join(F.transform("_inst", asm.operand), "\n").alias("_ops"),
        F.regexp_extract_all("_b", F.lit(r"(?md)^[ \t\r\f]*([A-Za-z_][A-Za-z0-9_]*)[ \t]*:"), 1).alias("_defined"), F.split(F.regexp_replace("_rest", r"[#$(),\[\]]", ""), r"[ \t\n\r\f]+").alias("_used"),
    )
    modes, registers = F.lit(0), F.lit(0)
    for pattern in asm.MODES.values():
        modes = modes + F.col("_ops").rlike("(?m)" + pattern).cast("int")
    for r in asm.REGISTERS:
        registers = registers + F.contains("_named", F.lit(r.lower())).cast("int")
    total = F.col("_lines") + F.col("_comments")
    made = parts.select(
        key, "instructions", modes.alias("modes"), registers.alias("registers"), "returns", F.size(F.array_except("_defined", "_used")).alias("orphans"), F.when(total > 0, F.col("_comments") / total).otherwise(0.0).alias("comment_ratio")
    )
    score = F.least(F.col("modes") * 0.05, F.lit(0.3)) + F.least(F.col("registers") * 0.04, F.lit(0.2)) + F.when(F.col("returns"), 0.2).otherwise(0.0)
    score = score + F.when(F.col("comment_ratio").between(0.1, 0.5), 0.1).otherwise(0.0) + F.when(F.col("instructions") > 0, 0.2).otherwise(0.0)
    return made.withColumn("score", F.least(F.when(F.col("orphans") > 0, F.greatest(score - 0.1, F.lit(0.0))).otherwise(score), F.lit(1.0)))


def assembled_score(assembled: Column, semantic: Column) -> Column:
    """0.6 for assembling and 0.4 of the semantic score; ``assembled`` comes from outside, null if skipped."""
    return F.coalesce(assembled.cast("double"), F.lit(0.5)) * 0.6 + semantic * 0.4


def text_reply(text: Column) -> Column:
    """A prose reply by length, words and technical terms: struct(valid, score, words, terms)."""
    text = or_empty(text)
    n = F.length(strip(text))
    count = F.regexp_count(text, F.lit("[A-Za-z]+"))
    score = F.when(n < 20, 0.1).when(n < 50, 0.4).otherwise(0.7)
    score = F.when(count < 5, F.least(score, F.lit(0.2))).when(count >= 20, F.least(score + 0.2, F.lit(1.0))).otherwise(score)
    # Classes of technical terms.
    patterns = [r"\$[0-9A-Fa-f]{2,6}", r"(?i)\b(LDA|STA|JMP|JSR|RTS|RTL)\b", r"(?i)\blink\b", r"(?i)\b(rupee|heart|sword|shield|item)\b", r"(?i)\b(WRAM|SRAM|ROM|bank)\b"]
    terms = F.lit(0)
    for p in patterns:
        terms = terms + text.rlike(p).cast("int")
    return F.struct(((n >= 20) & (count >= 5)).alias("valid"), F.when(terms >= 2, F.least(score + 0.1, F.lit(1.0))).otherwise(score).alias("score"), count.alias("words"), terms.alias("terms"))


def keyword_coverage(text: Column, expected: Column, if_none: float = 1.0) -> Column:
    """Share of the expected keywords that the text holds, case ignored; ``if_none`` without any."""
    low = F.lower(or_empty(text))
    found = F.size(F.filter(expected, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, F.lit(if_none)).otherwise(found / F.size(expected))


def expert_test(text: Column, expected: Column, anti: Column) -> Column:
    """struct(score, passed, anti_found): coverage, halved by any anti keyword; passed at 0.6 without one."""
    low = F.lower(or_empty(text))
    hit = F.coalesce(F.exists(anti, lambda k: F.contains(low, F.lower(k))), F.lit(False))
    cover = keyword_coverage(text, expected)
    score = F.when(hit, cover * 0.5).otherwise(cover)
    return F.struct(score.alias("score"), ((score >= 0.6) & ~hit).alias("passed"), hit.alias("anti_found"))


_CLOSES = {")": "(", "]": "[", "}": "{"}


def unbalanced(text: str | None) -> int:
    """Brackets left open or closed in vain in C-like code, outside strings, characters and comments."""
    stack, bad, i, n, state = [], 0, 0, len(text or ""), ""
    while i < n:
        ch, two = text[i], text[i : i + 2]
        if state in ("'", '"'):
            i += ch == "\\"
            state = "" if ch in (state, "\n") else state
        elif state == "//":
            state = "" if ch == "\n" else state
        elif state == "/*":
            if two == "*/":
                state, i = "", i + 1
        elif two in ("//", "/*"):
            state, i = two, i + 1
        elif ch in "'\"":
            state = ch
        elif ch in "([{":
            stack.append(ch)
        elif ch in _CLOSES:
            if stack and stack[-1] == _CLOSES[ch]:
                stack.pop()
            else:
                bad += 1
        i += 1
    return bad + len(stack)


def bracket_balance(text: Column) -> Column:
    """Unbalanced brackets of each text, by an Arrow-batched state machine; null counts as ''."""
    return F.pandas_udf(lambda s: pd.Series([unbalanced(t) for t in s], dtype="int64"), "bigint")(text)


def missing_semicolons(code: Column) -> Column:
    """Lines of C-like code that read as statements but end without a semicolon."""
    ends = lambda x: x.rlike(r"[;{}:,(\\]$") | x.rlike(r"^(#|//|/\*|\*)") | x.rlike(r"^(if|else|for|while|switch|do|class|struct|namespace|template|public|private|protected)\b")
    return F.size(F.filter(F.transform(lines(or_empty(code)), strip), lambda x: (x != "") & ~ends(x) & x.rlike(r"^(return\b|[A-Za-z_][\w:<>*& ]*\s*=|[A-Za-z_][\w.:>-]*\()")))


def cpp(code: Column) -> Column:
    """C++ heuristics: -0.1 for each semicolon issue (floor 0), -0.3 if brackets are unbalanced, +0.05 each for keywords and standard types."""
    issues, open_brackets = missing_semicolons(code), bracket_balance(code)
    score = F.greatest(F.lit(1.0) - issues * 0.1, F.lit(0.0)) - F.when(open_brackets > 0, 0.3).otherwise(0.0)
    score = score + F.when(or_empty(code).rlike(r"\b(class|struct|template|namespace|virtual|const)\b"), 0.05).otherwise(0.0) + F.when(F.contains(or_empty(code), F.lit("std::")), 0.05).otherwise(0.0)
    return verdict(open_brackets == 0, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.when(open_brackets > 0, F.array(F.lit("unbalanced brackets"))))


class Registry:
    """Validators by name: which records they apply to and how they judge them."""

    def __init__(self) -> None:
        self.entries: dict[str, tuple[Callable[[], Column], Callable[[], Column]]] = {}

    def add(self, name: str, applies: Callable[[], Column], judge: Callable[[], Column]) -> None:
        self.entries[name] = (applies, judge)

    def composite(self, names: list[str] | None = None) -> Column:
        """One verdict: mean score, united errors; a record that no validator takes is valid with 1.0."""
        chosen = [self.entries[n] for n in names or self.entries]
        each = F.array_compact(F.array(*(F.when(applies(), judge()) for applies, judge in chosen)))
        n = F.size(each)
        total = F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v["score"])
        return F.when(n == 0, verdict(F.lit(True), F.lit(1.0))).otherwise(
            verdict(F.forall(each, lambda v: v["valid"]), total / n, F.flatten(F.transform(each, lambda v: v["errors"])), F.flatten(F.transform(each, lambda v: v["warnings"])))
        )


    def batch(self, name: str) -> Column:
        """The verdict of one validator on every record; one that it does not take is valid with 1.0 and a warning."""
        applies, judge = self.entries[name]
        return F.when(applies(), judge()).otherwise(verdict(F.lit(True), F.lit(1.0), None, F.array(F.lit(f"{name} skipped: domain mismatch"))))


def default_registry(code: str = "output", domain: str = "domain") -> Registry:
    r = Registry()
    r.add("listing", lambda: F.coalesce(F.col(domain).isin("asm", "hack_curated") | F.col(domain).startswith("asm"), F.lit(False)), lambda: listing(F.col(code)))
    r.add("cpp", lambda: F.coalesce(F.col(domain).isin("cpp", "c++"), F.lit(False)), lambda: cpp(F.col(code)))
    return r


def enhanced_registry(code: str = "output", domain: str = "domain", found: Column | None = None, ok: Column | None = None, semantic: Column | None = None) -> Registry:
    """The default validators and an outside assembler, 0.6 of whose score is assembling and 0.4 the semantic score.

    ``found`` tells whether there is an assembler and ``ok`` what it said; without it half of its part is given.
    """
    r = default_registry(code, domain)
    here = found if found is not None else F.lit(False)
    said = F.coalesce(ok, F.lit(False)) if ok is not None else F.lit(False)
    applies = r.entries["listing"][0]
    plain = lambda: assembled(here, said)
    r.add("assembler", applies, (lambda: verdict(plain()["valid"], assembled_score(F.when(here, said), semantic), None, plain()["warnings"])) if semantic is not None else plain)
    return r


# What marks an error in a log.
LOG_ERRORS = {"traceback": "(?i)Traceback", "cuda_oom": "(?i)CUDA out of memory", "runtime_error": "(?i)RuntimeError", "value_error": "(?i)ValueError", "assert_error": "(?i)AssertionError", "exception": "(?i)Exception", "error_line": "(?im)^error"}


def log_errors(tail: Column) -> Column:
    """Labels of the error patterns in a log's tail, in order; empty for null."""
    return F.array_compact(F.array(*(F.when(or_empty(tail).rlike(p), F.lit(k)) for k, p in LOG_ERRORS.items())))


def health_issues(r: dict[str, Column], idle_minutes: int = 15, idle_percent: float = 5.0, disk_percent: int = 85) -> Column:
    """array<struct(level, kind)> of what is wrong with an instance.

    ``r`` has instance, status, remote (whether there is any), training, log_path, log_age, gpu, disk and
    log_errors. Without an instance nothing else is looked at; without a remote status nothing after it.
    """
    issue = lambda test, level, kind: F.when(test, F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind")))
    here, reached = F.coalesce(r["instance"], F.lit(False)), F.coalesce(r["remote"], F.lit(False))
    seen = here & reached
    disk_level = F.when(r["disk"] >= min(99, disk_percent + 10), "critical").otherwise("warning")
    rules = [
        issue(~here, "critical", "instance_missing"),
        issue(here & (or_empty(r["status"]) != "") & (r["status"] != "running"), "critical", "instance_state"),
        issue(here & ~reached, "critical", "ssh_unavailable"),
        issue(seen & (r["training"] == "IDLE"), "warning", "training_idle"),
        issue(seen & r["log_path"].isNull(), "warning", "log_missing"),
        issue(seen & (r["log_age"] > idle_minutes * 60), "warning", "log_stale"),
        issue(seen & (r["training"] == "TRAINING") & (r["gpu"] < idle_percent), "warning", "gpu_idle"),
        F.when(seen & (r["disk"] >= disk_percent), F.struct(disk_level.alias("level"), F.lit("disk_warning").alias("kind"))),
    ]
    errors = F.when(seen, F.transform(r["log_errors"], lambda e: F.struct(F.lit("critical").alias("level"), F.lit("log_error").alias("kind"))))
    return F.concat(F.array_compact(F.array(*rules)), F.coalesce(errors, F.expr("cast(array() as array<struct<level: string, kind: string>>)")))


# The setting that switches the alert of an event off.
ALERTS = {
    "training-start": "alert_on_training_start", "training-complete": "alert_on_training_complete", "training-failed": "alert_on_training_failed", "eval-complete": "alert_on_eval_complete",
    "backup-complete": "alert_on_backup_complete", "export-complete": "alert_on_export_complete", "budget-warning": "alert_on_budget_warning", "idle-detected": "alert_on_idle_detection", "disk-warning": "alert_on_disk_warning",
}


def suppressed(event: Column, config: dict[str, bool]) -> Column:
    """Whether the alert of an event is switched off; unknown and null events are not."""
    off = [e for e, setting in ALERTS.items() if not config.get(setting, True)]
    return F.coalesce(event.isin(off), F.lit(False)) if off else F.lit(False)


def respond(text: Column, error: Column, category: Column, text_categories: list[str], judge: Column) -> Column:
    """struct(mode, valid, score) of a reply: an error gives 0, categories of prose the check of a text, all others ``judge``."""
    prose = text_reply(text)
    failed, reads = or_empty(error) != "", F.coalesce(category.isin(text_categories), F.lit(False))
    return F.struct(
        F.when(failed, "error").when(reads, "text").otherwise("asm").alias("mode"),
        F.when(failed, False).when(reads, prose["valid"]).otherwise(judge["valid"]).alias("valid"),
        F.when(failed, 0.0).when(reads, prose["score"]).otherwise(judge["score"]).alias("score"),
    )


def assembled(found: Column, ok: Column) -> Column:
    """The verdict of an outside assembler: 1 or 0, or valid at 0.5 with a warning where there is none."""
    return F.when(~found, verdict(F.lit(True), F.lit(0.5), None, F.array(F.lit("assembler not found")))).otherwise(verdict(ok, F.when(ok, 1.0).otherwise(0.0)))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds to wait before a retry: base x 2^attempt, at most ``most``, with a share ``jitter`` of it added."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return wait * (F.lit(1.0) + jitter) if jitter is not None else wait

