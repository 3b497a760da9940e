"""Routines, comments, commits and task markers turned into training samples and benchmark cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, first_match, lines, or_empty, seeded_uniform, strip
from ..runtime import broadcast_if_small
from .classify import commit_type
from .curate import clean_instruction, diff_window
from .segment import context

# Technique tags of a listing, by what its upper-cased text holds (all of a tuple, any of a list, a pattern).
TECHNIQUES: list[tuple[str, tuple | list | str]] = [
    ("bank switching with data bank register preservation", ("PHB", "PLB")),
    ("X register preservation", ("PHX", "PLX")),
    ("Y register preservation", ("PHY", "PLY")),
    ("16-bit mode switching", ["REP #$30", "REP #$20"]),
    ("8-bit mode switching", ["SEP #$30", "SEP #$20"]),
    ("long subroutine calls", ["JSL"]),
    ("long return from subroutine", ["RTL"]),
    ("state machine using jump table", ["JUMPTABLELOCAL"]),
    ("loop with counter", r"(?s)\bLDX\b.*#\$0[0-9A-F]\b.*\bDEX\b.*\bBPL\b"),
    ("sprite state/position manipulation", ["$0DD0", "$0D10", "$0D00"]),
    ("random number generation", ["GETRANDOMNUMBER"]),
    ("OAM (sprite) manipulation", ["OAM"]),
    ("sound effect triggering", ["SFX"]),
]
# Names and line openings of data that explain nothing.
ROOM_DATA = r"^(RoomData_|OverworldMap32_|NULL_|LinkGraphics$|GFX_|UNREACHABLE_)"
DATA_LINE = r"^(incbin|db |dw |dl |dd |\.db|\.dw|\.dl|gfx_|null_)"
INTERESTING = ["sprite_behavior", "player_action", "damage_system", "spawn_entity"]
# Task types and commit systems by keywords.
TASKS = {
    "bug": ["bug", "crash", "broken", "wrong", "error", "fix", "issue"],
    "feature": ["add", "implement", "new", "feature", "support"],
    "documentation": ["document", "explain", "comment", "describe", "clarify"],
    "refactor": ["refactor", "cleanup", "reorganize", "simplify", "optimize"],
}
DIFFICULTY = {"bug": "hard", "feature": "expert", "documentation": "easy"}
SYSTEMS = {"Masks": ["mask"], "ZSOW_v3": ["zsow", "overworld"], "Menu": ["menu", "hud"]}
_MARKER = r"(?i);\s*(TODO|FIXME|HACK|XXX|BUG|NOTE)\s*:?\s*(.+)"


def techniques(code: Column) -> Column:
    """Names of the techniques a listing shows, in a fixed order; empty for null."""
    up = F.upper(or_empty(code))
    out = []
    for name, signs in TECHNIQUES:
        if isinstance(signs, str):
            test = up.rlike(signs)
        else:
            test, *tests = [F.contains(up, F.lit(s)) for s in signs]
            for t in tests:
                test = test & t if isinstance(signs, tuple) else test | t
        out.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*out))


def is_data_only(code: Column) -> Column:
    """Whether all lines but comments, labels and markers declare data."""
    bare = F.transform(lines(or_empty(code)), lambda x: strip(F.regexp_replace(x, r"#_[0-9A-Fa-f]+:\s*", "")))
    kept = F.filter(bare, lambda x: (x != "") & ~x.startswith(";") & ~x.endswith(":") & ~x.startswith("==="))
    return F.forall(kept, lambda x: F.lower(x).rlike(DATA_LINE))


# Routine categories by the beginning of a name, then by words within it, in order of precedence.
BY_PREFIX = {"Sprite_": "sprite_behavior", "SpritePrep_": "sprite_initialization", "Garnish": "visual_effect", "Link_": "player_action", "Ancilla_": "ancilla_effect", "DashDust_": "effect", "Fireball_": "effect"}
BY_WORD = {"Check": "check_condition", "Spawn": "spawn_entity", "Initialize": "initialization", "Init": "initialization", "Draw": "graphics", "Move": "movement", "Damage": "damage_system"}


def routine_info(name: Column) -> Column:
    """struct(category, entity, action) of a routine by its name; entity and action are null where the name shows none.

    The rest of a name after its prefix is the action, with blanks for underscores; a numbered sprite has
    an entity and the main behaviour; effects have the part before the last underscore as their entity. Any
    other name is its own action, its humps parted.
    """
    nothing, none = F.lit(None).cast("string"), lambda c: F.nullif(c, F.lit(""))
    rest = lambda prefix: none(F.replace(F.regexp_extract(name, rf"^{prefix}(\w+)", 1), F.lit("_"), F.lit(" ")))
    numbered = none(F.regexp_extract(name, r"^Sprite_[0-9A-F]+_(\w+)", 1))
    effect = name.startswith("DashDust_") | name.startswith("Fireball_")
    category = first_match([(name.startswith(p), c) for p, c in BY_PREFIX.items()] + [(F.contains(name, F.lit(w)), c) for w, c in BY_WORD.items()], "unknown")
    entity = F.when(name.startswith("Sprite_"), numbered).when(name.startswith("SpritePrep_"), nothing)
    entity = entity.when(name.startswith("Garnish"), none(F.regexp_extract(name, r"^Garnish(?:[0-9A-F]+)?_?(\w+)?", 1)))
    entity = entity.when(effect, none(F.regexp_extract(name, r"^(\w+)_\w+", 1)))
    action = F.when(name.startswith("Sprite_"), F.when(numbered.isNotNull(), F.lit("main behavior")).otherwise(rest("Sprite_")))
    action = action.when(name.startswith("SpritePrep_"), rest("SpritePrep_")).when(name.startswith("Garnish"), nothing)
    action = action.when(name.startswith("Link_"), rest("Link_")).when(name.startswith("Ancilla_"), rest("Ancilla_"))
    action = action.when(effect, none(F.replace(F.regexp_extract(name, r"^\w+_(\w+)", 1), F.lit("_"), F.lit(" "))))
    word = F.lit(False)
    for w in BY_WORD:
        word = word | F.contains(name, F.lit(w))
    humps = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    action = action.otherwise(F.replace(F.when(word, name).otherwise(humps), F.lit("_"), F.lit(" ")))
    return F.struct(category.alias("category"), entity.alias("entity"), action.alias("action"))


# Words that make a task one of code, and the tools that change it.
CODE_WORDS = ["fix", "implement", "write", "create", "modify", "patch", "todo", "bug", "refactor", "optimize", "code", "asm"]
CODE_TOOLS = ["apply_patch", "build_sandbox"]


def is_code_task(task: Column, tools: Column) -> Column:
    """Whether a task is about code, by its words or by the tools it needs; null tools are none."""
    return any_of(or_empty(task), CODE_WORDS) | F.coalesce(F.arrays_overlap(tools, F.array(*map(F.lit, CODE_TOOLS))), F.lit(False))


def is_room_data(name: Column) -> Column:
    return name.rlike(ROOM_DATA)


def routine_quality(code: Column, category: Column) -> Column:
    """0.15 for each technique (0.6 at most), up to 0.3 for the length, 0.2 for an interesting category, 1 at most."""
    n = F.size(F.filter(lines(or_empty(code)), lambda x: strip(x) != ""))
    length = F.when(n.between(8, 50), 0.3).when(n.between(5, 7), 0.15).when(n > 50, 0.2).otherwise(0.0)
    return F.least(F.least(F.size(techniques(code)) * 0.15, F.lit(0.6)) + length + F.when(category.isin(INTERESTING), 0.2).otherwise(0.0), F.lit(1.0))


def routine_samples(df: DataFrame, key: str, name: str, code: str, category: Column, seed: int = 42) -> DataFrame:
    """(key, kind, instruction, output): up to three samples for each routine that is more than data.

    An explanation for every routine, a generation sample with chance 0.6 x quality and a technique sample
    with chance quality where a technique shows; the chances depend on key and seed only.
    """
    q = df.filter(~is_data_only(F.col(code)) & ~is_room_data(F.col(name))).withColumn("_q", routine_quality(F.col(code), category)).withColumn("_t", techniques(F.col(code)))
    sample = lambda kind, ask, answer: F.struct(F.lit(kind).alias("kind"), ask.alias("instruction"), answer.alias("output"))
    made = F.array(
        sample("explain", F.concat(F.lit("Explain the routine "), F.col(name), F.lit(".")), F.col(code)),
        F.when(seeded_uniform(seed, F.col(key), F.lit("generate")) < F.col("_q") * 0.6, sample("generate", F.concat(F.lit("Write a 65816 routine named "), F.col(name), F.lit(".")), F.col(code))),
        F.when((F.size("_t") > 0) & (seeded_uniform(seed, F.col(key), F.lit("technique")) < F.col("_q")), sample("technique", F.concat(F.lit("Which techniques does "), F.col(name), F.lit(" show?")), F.array_join("_t", "; "))),
    )
    return q.select(key, F.explode(F.array_compact(made)).alias("_s")).select(key, "_s.*")


def description_to_instruction(description: Column) -> Column:
    """A description as a request to write a routine; '' for one of under eight code points or without a letter."""
    text = F.regexp_replace(clean_instruction(or_empty(description)), r"\.+$", "")
    return F.when((F.length(text) >= 8) & text.rlike("[A-Za-z]"), F.concat(F.lit("Write a 65816 routine that "), text, F.lit("."))).otherwise("")


def invert_prompt(instruction: Column) -> Column:
    """What follows the first colon at the end of a line: the code of a prompt; null without one."""
    return F.when(F.contains(instruction, F.lit(":\n")), F.regexp_replace(instruction, r"(?s)^.*?:\n", ""))


def inverted_prompts(df: DataFrame, key: str, instruction: str, known: DataFrame) -> DataFrame:
    """(key, instruction, output): requests to explain the code of other prompts.

    The answer comes from ``known`` (code, explanation), else from the instructions that the code holds.
    Prompts without code give nothing.
    """
    code = df.select(key, invert_prompt(F.col(instruction)).alias("_code")).filter("_code is not null")
    side = known.groupBy(F.col("code").alias("_k")).agg(F.min("explanation").alias("_e"))
    joined = code.join(broadcast_if_small(side), F.col("_code") == F.col("_k"), "left")
    return joined.select(key, F.concat(F.lit("Explain this 65816 code:\n"), "_code").alias("instruction"), F.coalesce("_e", explanation(F.col("_code"))).alias("output"))


def extract_address(instruction: Column) -> Column:
    """The first address token, banked ones before long, five-digit and short ones; null without any."""
    forms = [r"\$[0-9A-Fa-f]{2}:[0-9A-Fa-f]{4}", r"\$[0-9A-Fa-f]{6}", r"\$[0-9A-Fa-f]{5}", r"\$[0-9A-Fa-f]{4}"]
    return F.coalesce(*(F.nullif(F.regexp_extract(instruction, f"({p})", 1), F.lit("")) for p in forms))


def is_long_context(line: Column) -> Column:
    """Whether a line of code uses long addressing."""
    return F.upper(line).rlike(r"\.L|JSL|JML|>> ?16")


# What comes before the task of a prompt.
_ASKS = r"(?is)^\s*(?:please\s+)?(?:write|create|generate|implement|show|give)\s+(?:me\s+)?(?:a|an|the|some)?\s*(?:65816\s+)?(?:assembly\s+|asm\s+)?(?:routine|code|function|subroutine)?\s*(?:that|to|for|which)?\s+"


def extract_task(instruction: Column) -> Column:
    """The task of a prompt: what is asked for, without the asking and the stop at its end."""
    return F.regexp_replace(strip(F.regexp_replace(instruction, _ASKS, "")), r"[.!?]+$", "")


def task_type(text: Column) -> Column:
    return first_match([(any_of(or_empty(text), words), name) for name, words in TASKS.items()], "unknown")


def task_cases(df: DataFrame, key: str, text: str, around: int = 5) -> DataFrame:
    """(key, line_no, marker, task, task_type, category, difficulty, before, after) of comments that mark a task."""
    hits = context(df, key, text, _MARKER, around)
    marker, task = F.upper(F.regexp_extract("line", _MARKER, 1)), strip(F.regexp_extract("line", _MARKER, 2))
    kind = task_type(task)
    level = first_match([(kind == t, d) for t, d in DIFFICULTY.items()], "medium")
    category = F.when(marker.isin("BUG", "FIXME"), "bugs").otherwise("todos")
    return hits.select(key, "line_no", marker.alias("marker"), task.alias("task"), kind.alias("task_type"), category.alias("category"), level.alias("difficulty"), "before", "after")


def parse_commits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, commit_no, hash, date, subject, body, diff) of logs: a commit begins with a line ``commit <hash>``.

    The subject is the first indented line, the body the others, both without their indent; the diff begins
    at ``diff --git`` and may be missing. One split of each text, no shuffle.
    """
    part = F.posexplode(F.split(F.col(text), r"(?md)^(?=commit [0-9a-f]{7,40}[ \t\r]*$)")).alias("commit_no", "_c")
    rows = df.select(key, part).filter(F.col("_c").rlike(r"^commit [0-9a-f]{7,40}\s"))
    head = F.substring_index("_c", "\ndiff --git", 1)
    said = F.transform(F.regexp_extract_all(head, F.lit(r"(?md)^    ([^\n]*)$"), 1), strip)
    diff = F.when(F.contains("_c", F.lit("\ndiff --git")), strip(F.regexp_replace("_c", r"(?s)^.*?\n(?=diff --git)", "")))
    return rows.select(
        key, "commit_no", F.regexp_extract("_c", r"^commit ([0-9a-f]+)", 1).alias("hash"), F.nullif(strip(F.regexp_extract(head, r"(?md)^Date:([^\n]*)$", 1)), F.lit("")).alias("date"),
        F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("")).alias("subject"), strip(F.array_join(F.slice(said, 2, 1_000_000), "\n")).alias("body"), diff.alias("diff"),
    )


def commit_samples(commits: DataFrame, key: str, least: int = 5, most: int = 200) -> DataFrame:
    """(key, hash, kind, instruction, input, output): a change summary for each commit with a diff, and a bug fix or feature sample by its type.

    Diffs under ``least`` lines give no summary and longer ones than ``most`` are cut; commits without a
    message give nothing.
    """
    message = F.when(F.col("body") != "", F.concat_ws("\n\n", "subject", "body")).otherwise(F.col("subject"))
    window = diff_window(F.col("diff"), least, most)
    kind = commit_type(F.col("subject"))
    sample = lambda name, ask, given, answer: F.struct(F.lit(name).alias("kind"), F.lit(ask).alias("instruction"), given.alias("input"), answer.alias("output"))
    made = F.array(
        F.when(window.isNotNull(), sample("summary", "Summarize the intent of this ASM change.", F.concat(F.lit("```diff\n"), window, F.lit("\n```")), message)),
        F.when(kind == "bugfix", sample("bugfix", "What was wrong, and how was it fixed?", F.col("subject"), message)),
        F.when(kind == "feature", sample("feature", "Describe the feature that was added.", F.col("subject"), message)),
    )
    return commits.filter(F.col("subject") != "").select(key, "hash", F.explode(F.array_compact(made)).alias("_s")).select(key, "hash", "_s.*")


def commit_profile(subject: Column) -> Column:
    """struct(expert, system) of a commit by the words of its subject."""
    expert = F.when(any_of(or_empty(subject), ["fix", "bug", "crash", "issue", "regress"]), "farore").otherwise("oos_specialist")
    return F.struct(expert.alias("expert"), first_match([(any_of(or_empty(subject), w), s) for s, w in SYSTEMS.items()], "Core").alias("system"))


def explanation(code: Column) -> Column:
    """A plain sentence on what a listing does, from the instructions it holds."""
    up = F.upper(or_empty(code))
    says = [("LD[AXY]", "loads values"), ("ST[AXYZ]", "stores values"), ("JS[RL]", "calls subroutines"), ("B(CC|CS|EQ|MI|NE|PL|RA|VC|VS)", "branches"), ("(ADC|SBC)", "does arithmetic"), ("(AND|ORA|EOR|BIT)", "tests or masks bits"), ("(ASL|LSR|ROL|ROR)", "shifts bits"), ("(REP|SEP)", "switches register widths"), ("RT[SLI]", "returns")]
    parts = F.array_compact(F.array(*(F.when(up.rlike(rf"\b{p}\b"), F.lit(t)) for p, t in says)))
    return F.when(F.size(parts) == 0, F.lit("This code holds no known instruction.")).otherwise(F.concat(F.lit("This code "), F.array_join(parts, ", "), F.lit(".")))
