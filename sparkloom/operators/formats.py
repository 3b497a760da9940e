"""Records to chat messages, prompts and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import or_empty


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def full_prompt(instruction: Column, extra: Column) -> Column:
    """The instruction, and after a blank line the input if there is any."""
    return F.when(or_empty(extra) != "", F.concat(or_empty(instruction), F.lit("\n\n"), extra)).otherwise(or_empty(instruction))


def chatml(system: Column | str, instruction: Column, extra: Column, output: Column, thinking: Column | None = None) -> Column:
    """Messages of a record; thinking is wrapped before the answer. Null texts count as ''."""
    thought = F.when(or_empty(thinking) != "", F.concat(F.lit("<thinking>\n"), thinking, F.lit("\n</thinking>\n\n"))).otherwise("") if thinking is not None else F.lit("")
    system = F.lit(system) if isinstance(system, str) else system
    return F.array(message("system", system), message("user", full_prompt(instruction, extra)), message("assistant", F.concat(thought, or_empty(output))))


def chat_text(messages: Column) -> Column:
    """Messages as one text with role markers."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def response_prompt(instruction: Column, extra: Column) -> Column:
    """An instruction prompt with an input part only where there is one."""
    middle = F.when(or_empty(extra) != "", F.concat(F.lit("### Input:\n"), extra, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), or_empty(instruction), F.lit("\n\n"), middle, F.lit("### Response:\n"))


def sample_json(instruction: Column, output: Column, extra: Column, thinking: Column, meta: Column) -> Column:
    """A record as a JSON line: empty input and thinking are left out, the rest is nested in ``_metadata``."""
    return F.to_json(F.struct(instruction.alias("instruction"), output.alias("output"), F.nullif(extra, F.lit("")).alias("input"), F.nullif(thinking, F.lit("")).alias("thinking"), meta.alias("_metadata")))


# System texts by expert.
EXPERT_SYSTEMS = {
    "farore": "You are Farore, a 65816 assembly debugging expert. Analyze bugs, identify issues, and explain fixes.",
    "veran": "You are Veran, a 65816 assembly hardware expert. Explain SNES hardware, registers, and low-level operations.",
    "oracle_specialist": "You are an expert on the Oracle of Secrets ALTTP ROM hack. Explain code, systems, and implementations.",
}
DEFAULT_SYSTEM = "You are a helpful 65816 assembly expert."


def expert_system(expert: Column) -> Column:
    """The system text of an expert, a general one for others."""
    out = F.lit(None).cast("string")
    for name, text in EXPERT_SYSTEMS.items():
        out = F.when(expert == name, F.lit(text)).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_SYSTEM))


def expert_messages(expert: Column, user: Column, output: Column) -> Column:
    """Messages for an expert; empty user and assistant turns are left out, so that a count of two or more tells real samples."""
    turn = lambda role, c: F.when(or_empty(c) != "", message(role, c))
    return F.array_compact(F.array(message("system", expert_system(expert)), turn("user", user), turn("assistant", output)))


def pool_record(instruction: Column, output: Column, extra: Column, domain: Column, source: Column, expert: Column, quality: Column, teacher: Column) -> Column:
    """A chat sample as a record of an expert's pool, with where it came from in ``metadata``."""
    meta = F.struct(expert.alias("expert"), F.coalesce(quality, F.lit(0.0)).alias("original_quality"), F.coalesce(teacher, F.lit("unknown")).alias("teacher_model"), F.array(F.lit("distillation"), expert).alias("tags"))
    return F.struct(or_empty(instruction).alias("input"), or_empty(output).alias("output"), or_empty(extra).alias("context"), F.coalesce(domain, F.lit("unknown")).alias("domain"), F.concat(F.lit("chat_distillation_"), F.coalesce(source, F.lit("unknown"))).alias("source"), meta.alias("metadata"))
