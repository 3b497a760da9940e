"""Queries over small literal tables that reach every branch of an operator, and rollups that need no table of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import asm
from ..functions.text import or_empty
from ..operators import classify, curate, dedup, events, formats, generate, graph, mix, profile, rewrite, routines, segment, validate
from ..runtime import norm_label, table
from ..sources import files
from . import queries as base
from .registry import Rows, query, registered_sql, sql_any, sql_norm, sql_strip

_LIBRARY, _RESULTS = base._LIBRARY, base._RESULTS
_DOCS = "(select * from documents where text is not null)"


def _docs(spark, d, *columns):
    return table(spark, d, "documents", "doc_id", *columns).filter("text is not null") if "text" in columns else table(spark, d, "documents", "doc_id", *columns)


# --- listings, symbols, logs ------------------------------------------------------------------------

_OPERANDS = Rows(
    "id bigint, op string",
    *enumerate(["#$1234", "#$12", "#Label", "#<$10+#$3", "$10,S", "($10,X)", "($10),Y", "($10)", "$2100,X", "$2100,Y", "$7E1234", "$2100", "$10", "$1", "A", "a", "Label", "", "[$10]", "($10, x)", "#$12345", None, " $2100 ", "label_2+1"]),
)


@query(f"select id, op, case {' '.join(f'when regexp_matches(o, {chr(39)}{p}{chr(39)}) then {chr(39)}{m}{chr(39)}' for p, m in asm.ADDRESSING)} end as mode from (select *, trim(op) as o from {_OPERANDS.sql})")
def addressing_modes(spark, d):
    return _OPERANDS.df(spark).select("id", "op", asm.addressing_mode(F.col("op")).alias("mode"))


_SOURCES = Rows("id bigint, source string", (1, "MODE = $7e0010 ; game mode\n!SUB := $11\n  Link_X=$0022\nnot = 12\n; C = $10\nD = $10 + 1"), (2, ""), (3, None), (4, "_u2 = $ABCDEF"))
_ASSIGNED = r"'^!?([A-Za-z_][A-Za-z0-9_]*)\s*:?=\s*\$([0-9A-Fa-f]+)$'"


@query(rf"""with l as (select id, unnest(string_split(source, chr(10))) as line, generate_subscripts(string_split(source, chr(10)), 1) - 1 as line_no from {_SOURCES.sql}), c as (select id, line_no, {sql_strip("split_part(line, ';', 1)")} as c from l)
select id, line_no::int as line_no, regexp_extract(c, {_ASSIGNED}, 1) as name, upper(regexp_extract(c, {_ASSIGNED}, 2)) as address from c where regexp_matches(c, {_ASSIGNED})""")
def symbol_scan(spark, d):
    return rewrite.scan_symbols(_SOURCES.df(spark), "id", "source")


_PAGES = Rows("id bigint, page string", (1, "**`MODE`** is bold, not an address\n**`TAG1/TAG2` (`$7E00AE`, `$7E00AF`):** two\n"), (2, "**`A_B` at `$2100`** and **`no name here $10`** and `X` `$30`"), (3, "plain"), (4, None), (5, "**`Lower` `$40`** **`OK` `$41`**"))


@query(rf"""with b as (select id, unnest(regexp_extract_all(page, '\*\*([^\n]*?)\*\*', 1)) as b from {_PAGES.sql}), n as (select id, b, unnest(list_filter(string_split(array_to_string(regexp_extract_all(b, '`([A-Z0-9_/]+)`', 1), '/'), '/'), lambda x: x <> '')) as name from b),
a as (select id, name, upper(unnest(regexp_extract_all(b, '`\$([0-9A-Fa-f]+)`', 1))) as address from n) select distinct id, name, address from (select * from a union all select id, name, substr(address, 3) from a where regexp_matches(address, '^7E[0-9A-F]{{4}}$'))""")
def markdown_symbols(spark, d):
    return rewrite.markdown_symbols(_PAGES.df(spark), "id", "page")


_BUILDS = Rows(
    "id bigint, log string",
    (1, "main.asm:12: error: unknown command\nmain.asm:14:7: ERROR: label 'Foo' wasn't found \nok"),
    (2, "error: loose failure\nmain.asm:3: error: loose failure in macro"),
    (3, "asar: error: no rom\nError: no rom\nfine"),
    (4, ""),
    (5, None),
    (6, "sub/x.asm:1:2: error: a\r\n"),
)
_LOCATED = r"'(?i)^(.+?):(\d+)(?::(\d+))?:[ \t]*error:[ \t]*(.+)$'"


@query(rf"""with l as (select id, unnest(string_split(replace(log, chr(13), ''), chr(10))) as x from {_BUILDS.sql}), f as (select id, regexp_extract(x, {_LOCATED}, 1) as file, regexp_extract(x, {_LOCATED}, 2)::int as line, nullif(regexp_extract(x, {_LOCATED}, 3), '')::int as col, {sql_strip(f"regexp_extract(x, {_LOCATED}, 4)")} as message from l where regexp_matches(x, {_LOCATED})),
o as (select distinct id, {sql_strip("regexp_extract(x, '(?i)error:[ \\t]*(.+)$', 1)")} as message from l where regexp_matches(x, '(?i)error:[ \t]*(.+)$'))
select * from f union all select id, 'unknown', 0, null, message from o where not exists (select 1 from f where f.id = o.id and contains(f.message, o.message))""")
def compiler_output(spark, d):
    return _BUILDS.df(spark).select("id", F.explode(files.compiler_errors(F.col("log"))).alias("e")).select("id", "e.*")


_LINKED = Rows("id bigint, line string", (1, "00:8000 Reset"), (2, "7E:0010 MODE"), (3, "[labels]"), (4, "80:FFFF End_Of_Bank"), (5, "0:12 no"))


@query(r"""select id, ('0x' || substr(line, 1, 2) || substr(line, 4, 4))::bigint as address, regexp_extract(line, ' (\S+)', 1) as name from """ + _LINKED.sql + r""" where regexp_matches(line, '^[0-9A-Fa-f]{2}:[0-9A-Fa-f]{4} \S+')""")
def linker_symbols(spark, d):
    return _LINKED.df(spark).select("id", F.explode(files.linker_symbols(F.col("line"))).alias("s")).select("id", "s.address", "s.name")


_SCANS = Rows(
    "id bigint, log string",
    (1, "RSSI: -10 Ch: 1 BSSID: AA:BB:CC:DD:EE:00 ESSID: before\n#scanall\n\x1b[32m> RSSI: -40 Ch: 6 BSSID: AA:BB:CC:DD:EE:FF ESSID: net one \x1b[0m\n3: ap: AA:BB:CC:DD:EE:FF -> sta: 00:11:22:33:44:55\nBeacon: seen\n#stopscan\nRSSI: -11 Ch: 2 BSSID: AA:BB:CC:DD:EE:01 ESSID: after"),
    (2, "#scanall\nnot a row\nRXd WPS Configs: x"),
    (3, "nothing"),
    (4, None),
)


@query(rf"""with s as (select id, string_split(regexp_extract(regexp_replace(log, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g'), '(?sm)^[ \t]*#scanall[^\n]*\n(.*?)(?:^[ \t]*#stopscan|\z)', 1), chr(10)) as ls from {_SCANS.sql}), l as (select id, {sql_strip("unnest(ls)")} as x from s)
select id, 'network' as kind, lower(regexp_extract(x, 'BSSID:\s*([0-9A-Fa-f:]{{17}})', 1)) as mac, regexp_extract(x, 'RSSI:\s*(-?\d+)', 1) || '/' || regexp_extract(x, 'Ch:\s*(\d+)', 1) || '/' || {sql_strip("regexp_extract(x, 'ESSID:(.*)$', 1)")} as what from l where regexp_matches(x, '^>?\s*RSSI:')
union all select id, 'link', lower(regexp_extract(x, '([0-9A-Fa-f:]{{17}})', 1)), regexp_extract(x, ':\s+(ap|sta)', 1) || '>' || regexp_extract(x, '->\s+(ap|sta)', 1) from l where regexp_matches(x, '^\d+:\s+(ap|sta):') union all select id, 'note', null, x from l where contains(x, 'RXd WPS Configs') or starts_with(x, 'Beacon:')""")
def scan_logs(spark, d):
    s = _SCANS.df(spark).select("id", files.scan_log(F.col("log")).alias("s"))
    n = s.select("id", F.explode("s.networks").alias("x")).select("id", F.lit("network").alias("kind"), F.col("x.bssid").alias("mac"), F.concat_ws("/", F.col("x.rssi").cast("string"), F.col("x.channel").cast("string"), "x.essid").alias("what"))
    k = s.select("id", F.explode("s.links").alias("x")).select("id", F.lit("link").alias("kind"), F.col("x.left_mac").alias("mac"), F.concat_ws(">", "x.left_role", "x.right_role").alias("what"))
    return n.union(k).union(s.select("id", F.lit("note"), F.lit(None).cast("string"), F.explode("s.notes")))


_VERSIONS = Rows("game string, name string", ("a", "rom_9.sfc"), ("a", "rom_10.sfc"), ("a", "rom.sfc"), ("b", "x2"), ("b", "x02.bin"), ("c", "none.txt"))


@query(r"""select game, arg_max(name, (n, name)) as latest, max(n) as number from (select *, nullif(regexp_extract(name, '(\d+)(?:\.[A-Za-z0-9]+)?$', 1), '')::bigint as n from """ + _VERSIONS.sql + ") where n is not null group by game")
def latest_version(spark, d):
    return rewrite.latest_index(_VERSIONS.df(spark), "game", "name")


_MARKED = Rows("id bigint, text string", (1, 'log <<<{"status": "ok", "n": 3}>>> end'), (2, "<<<{broken>>>"), (3, "none"), (4, None), (5, '```json\n{"status": "fenced"}\n```'), (6, 'so: {"status": "inline"} done'))


@query("""select id, case when id = 1 then 'ok' end as marked, case id when 1 then 'ok' when 5 then 'fenced' when 6 then 'inline' else 'default' end as reply from """ + _MARKED.sql)
def embedded_json(spark, d):
    get = lambda v: F.try_variant_get(v, "$.status", "string")
    text = F.col("text")
    return _MARKED.df(spark).select("id", get(files.marked_json(text, "<<<", ">>>")).alias("marked"), get(files.reply_json(text, '{"status": "default"}')).alias("reply"))


# --- predicates and cleaning --------------------------------------------------------------------------


@query(rf"""select rec_id, {sql_strip(r"regexp_replace(replace(regexp_replace(regexp_replace(instruction, '\borg\s+\$[0-9A-Fa-f]+\b', '', 'gi'), '\$[0-9A-Fa-f]{4,6}\b', '', 'g'), 'org', ''), '[\s,;:]+', ' ', 'g')")} as bare from {_LIBRARY}""")
def stripped_addresses(spark, d):
    return base._library(spark, d, "instruction").select("rec_id", curate.strip_addresses(F.col("instruction")).alias("bare"))


def _augment_sql(x: str) -> str:
    for p in curate.MARKERS[:5]:
        x = f"regexp_replace({x}, '{p}', '', 'gi')"
    x = rf"regexp_replace({x}, '(?is)\bTODO\b.*$', '', 'g')"
    return sql_strip(rf"regexp_replace({sql_strip(rf'''regexp_replace({x}, '\s+', ' ', 'g')''')}, '[\s,;:]+$', '')")


_NOISY = Rows(
    "id bigint, instruction string",
    *enumerate(["; $8000-$8FFF LOCAL. Load it", "*$1000-$1FFF DATA clear ====== it", "Store ----- org $8000 it,;:", "Do this TODO finish later", "todo only", "; TODO", "  a \n b  ", None, "", "Find ; $7E12"]),
)


@query(f"select id, {base._clean_sql('instruction')} as dataset, {_augment_sql('instruction')} as augment from {_NOISY.sql}")
def cleaned_profiles(spark, d):
    return _NOISY.df(spark).select("id", curate.clean_instruction(F.col("instruction")).alias("dataset"), curate.clean_instruction(F.col("instruction"), "augment").alias("augment"))


_META = Rows("id bigint, tool string, batch string", (1, "walker", "3"), (2, None, "4"), (3, "import", None), (4, None, None))


@query(f"select id, 'new' as origin, coalesce(tool, 'unset') as tool, coalesce(batch, '0') as batch from {_META.sql}")
def merged_metadata(spark, d):
    rows = _META.df(spark)
    legacy = F.map_filter(F.create_map(F.lit("tool"), "tool", F.lit("batch"), "batch"), lambda _, v: v.isNotNull())
    made = F.create_map(F.lit("origin"), F.lit("new"), F.lit("tool"), F.lit("unset"), F.lit("batch"), F.lit("0"))
    m = rows.select("id", curate.merge_metadata(made, legacy).alias("m"))
    return m.select("id", *(F.col("m")[k].alias(k) for k in ("origin", "tool", "batch")))


@query(f"select rec_id, coalesce(json_extract_string(metadata, '$.tool'), 'none') as tool, case when instruction <> {base._clean_sql('instruction')} then 'true' end as cleaned from {_LIBRARY} where instruction is not null")
def record_metadata(spark, d):
    """What normalising did to a record, merged into its metadata."""
    rows = base._library(spark, d, "instruction", "output", "domain", "source", "metadata").filter("instruction is not null")
    rows = rows.withColumn("instruction", F.concat("instruction", F.lit("")))
    out = curate.normalize_records(rows, metadata=F.from_json("metadata", "map<string,string>"))
    return out.select("rec_id", F.coalesce(F.col("metadata")["tool"], F.lit("none")).alias("tool"), F.when(F.col("metadata")["instruction_cleaned"] == "true", "true").alias("cleaned"))


@query(f"select result_id from {_RESULTS} where coalesce(score, 0) >= 0.7")
def score_threshold(spark, d):
    return base._results(spark, d, "score").filter(curate.at_least(F.col("score"), 0.7)).select("result_id")


_DIFFS = Rows("id bigint, diff string", (1, "\n".join(f"+{k}" for k in range(3))), (2, "\n".join(f"+{k}" for k in range(5))), (3, "\n".join(f"-{k}" for k in range(250))), (4, None))


@query(f"select id, case when len(l) >= 5 then array_to_string(l[:200], chr(10)) end as cut from (select id, string_split(diff, chr(10)) as l from {_DIFFS.sql})")
def diff_windows(spark, d):
    return _DIFFS.df(spark).select("id", curate.diff_window(F.col("diff")).alias("cut"))


_LOGGED = Rows("id bigint, level string", *enumerate(["debug", "info", "warning", "error", "metric", "other", None]))


@query(f"select id, coalesce(list_position(['debug', 'info', 'warning', 'error', 'metric'], level), 0) >= 3 as kept from {_LOGGED.sql} where level is not null")
def level_threshold(spark, d):
    return _LOGGED.df(spark).filter("level is not null").select("id", events.level_at_least(F.col("level"), "warning").alias("kept"))


@query("select doc_id, updated_at is null or updated_at + interval '90 days' > timestamp '2025-06-01' as active from documents")
def ttl_active(spark, d):
    expires = F.col("updated_at") + F.expr("interval 90 days")
    return _docs(spark, d, "updated_at").select("doc_id", graph.active(expires, F.lit("2025-06-01").cast("timestamp_ntz")).alias("active"))


_REPLIES = Rows("id bigint, text string", (1, "a ```asm\nLDA #1\n``` b"), (2, "```65816\nRTS\n```\n```asm\nNOP\n```"), (3, "```\nplain\n```"), (4, "no fence "), (5, "```py\nprint()\n"), (6, None), (7, "```asm\n\n```"))


@query(r"""select id, regexp_replace(coalesce(nullif(regexp_extract(text, '(?s)```asm[ \t]*\n(.*?)(?:```|\z)', 1), ''), nullif(regexp_extract(text, '(?s)```65816[ \t]*\n(.*?)(?:```|\z)', 1), ''), nullif(regexp_extract(text, '(?s)```[^\n]*\n(.*?)(?:```|\z)', 1), ''), text), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') as code from """ + _REPLIES.sql)
def fenced_code(spark, d):
    return _REPLIES.df(spark).select("id", curate.fenced_code(F.col("text")).alias("code"))


@query(f"select doc_id, length(text) as chars from {_DOCS} where length(text) >= 200")
def long_documents(spark, d):
    return _docs(spark, d, "text").filter(curate.chars_at_least(F.col("text"), 200)).select("doc_id", F.length("text").alias("chars"))


_TASKS = Rows(
    "id bigint, label string, category string, difficulty string, tags array<string>",
    (1, "Fix GPU", "bugs", "hard", ["gpu", "x"]), (2, "docs", "docs", "easy", ["doc"]), (3, "a gpu", "bugs", "easy", None), (4, None, None, None, ["gpu"]), (5, "other", "bugs", "hard", []),
)


@query("select id, coalesce(category = 'bugs', false) and coalesce(difficulty = 'hard', false) and coalesce(list_has_any(tags, ['gpu', 'doc']), false) as chosen, contains(lower(coalesce(label, '')), 'gpu') or coalesce(list_contains(tags, 'gpu'), false) as labelled, coalesce(category = 'docs', false) as docs from " + _TASKS.sql)
def case_filters(spark, d):
    c, l, t = F.col("category"), F.col("difficulty"), F.col("tags")
    return _TASKS.df(spark).select("id", curate.selected(c, l, t, "bugs", "hard", ["gpu", "doc"]).alias("chosen"), curate.labelled(F.col("label"), t, "gpu").alias("labelled"), curate.selected(c, l, t, "docs").alias("docs"))


_EVENTS = Rows("id bigint, event string", *enumerate([*validate.ALERTS, "unknown", None]))


@query(f"select id, coalesce(event in ('eval-complete', 'disk-warning'), false) as suppressed from {_EVENTS.sql}")
def alert_suppression(spark, d):
    return _EVENTS.df(spark).select("id", validate.suppressed(F.col("event"), {"alert_on_eval_complete": False, "alert_on_disk_warning": False, "alert_on_idle_detection": True}).alias("suppressed"))


_OCR = Rows("id bigint, chars bigint, error string", (1, 500, None), (2, 12, None), (3, None, None), (4, 900, "boom"), (5, 200, ""))


@query(f"select id, case when coalesce(error, '') <> '' then 'failed' when coalesce(chars, 0) < 200 then 'short' else 'ok' end as status from {_OCR.sql}")
def scan_statuses(spark, d):
    return _OCR.df(spark).select("id", curate.scan_status(F.col("chars"), F.col("error")).alias("status"))


# --- validators and classifiers ---------------------------------------------------------------------------

_INSTANCES = Rows(
    "id bigint, instance boolean, status string, remote boolean, training string, log_path string, log_age bigint, gpu double, disk double, log_errors array<string>",
    (1, None, None, None, None, None, None, None, None, None), (2, True, "stopped", None, None, None, None, None, None, None), (3, True, "running", True, "IDLE", None, 5000, 0.0, 85.0, ["cuda_oom", "exception"]),
    (4, True, "running", True, "TRAINING", "/x", 10, 2.0, 95.0, []), (5, True, "running", True, "TRAINING", "/x", 900, 50.0, 10.0, None), (6, True, None, True, "TRAINING", "/x", None, None, None, None),
)


@query(f"""with r as (select *, coalesce(instance, false) as here, coalesce(instance, false) and coalesce(remote, false) as seen from {_INSTANCES.sql})
select id, 'critical' as level, 'instance_missing' as kind from r where not here union all select id, 'critical', 'instance_state' from r where here and coalesce(status, '') <> '' and status <> 'running' union all select id, 'critical', 'ssh_unavailable' from r where here and not coalesce(remote, false)
union all select id, 'warning', 'training_idle' from r where seen and training = 'IDLE' union all select id, 'warning', 'log_missing' from r where seen and log_path is null union all select id, 'warning', 'log_stale' from r where seen and log_age > 900 union all select id, 'warning', 'gpu_idle' from r where seen and training = 'TRAINING' and gpu < 5
union all select id, case when disk >= 95 then 'critical' else 'warning' end, 'disk_warning' from r where seen and disk >= 85 union all select id, 'critical', 'log_error' from (select id, unnest(log_errors) from r where seen)""")
def health_checks(spark, d):
    rows = _INSTANCES.df(spark)
    return rows.select("id", F.explode(validate.health_issues({c: F.col(c) for c in rows.columns[1:]})).alias("i")).select("id", "i.level", "i.kind")


_TAILS = Rows("id bigint, log string", *enumerate(["Traceback (most recent call last):\nValueError: x", "CUDA out of memory.", "RuntimeError in step", "AssertionError", "some Exception", "line\nError: bad", "all well", None, "an error inside a line"]))


@query("""select id, array_to_string(list_filter(['traceback', 'cuda_oom', 'runtime_error', 'value_error', 'assert_error', 'exception', 'error_line'], lambda x: regexp_matches(coalesce(log, ''), case x when 'traceback' then '(?i)Traceback' when 'cuda_oom' then '(?i)CUDA out of memory' when 'runtime_error' then '(?i)RuntimeError' when 'value_error' then '(?i)ValueError'
when 'assert_error' then '(?i)AssertionError' when 'exception' then '(?i)Exception' else '(?im)^error' end)), ',') as errors from """ + _TAILS.sql)
def log_error_kinds(spark, d):
    return _TAILS.df(spark).select("id", F.array_join(validate.log_errors(F.col("log")), ",").alias("errors"))


_MESSAGES = Rows("id bigint, message string", *enumerate(["Label 'x' wasn't found", "macro not closed", "bad org", "Addressing mode", "unknown opcode", "parse failed", "nothing known", None, "undefined symbol in macro"]))


@query(f"select id, case {' '.join('when ' + sql_any('lower(coalesce(message, ' + chr(39) * 2 + '))', k) + f' then {chr(39)}{n}{chr(39)}' for n, k in classify.ERROR_FAMILIES.items())} else 'other' end as family from {_MESSAGES.sql}")
def error_family_cases(spark, d):
    return _MESSAGES.df(spark).select("id", classify.error_family(F.col("message")).alias("family"))


_PATHS = Rows("id bigint, path string", *enumerate(["a/b.asm", "x.S", "y.65s", "m.inc", "README.MD", "t.txt", "c.c", "d.cpp", "e.cc", "f.h", "g.cs", "p.pdf", "noext", None, "dir.asm/file", ".asm"]))


@query(f"select id, case {' '.join(f'when lower(regexp_extract(path, {chr(39)}([.][A-Za-z0-9]+)${chr(39)}, 1)) = {chr(39)}{e}{chr(39)} then {chr(39)}{k}{chr(39)}' for e, k in classify.FILE_KINDS.items())} else 'unknown' end as kind from {_PATHS.sql}")
def file_kind_cases(spark, d):
    return _PATHS.df(spark).select("id", classify.file_kind(F.col("path")).alias("kind"))


_NAMES = Rows(
    "id bigint, name string, category string, entity string, action string",
    *((k, *r) for k, r in enumerate([
        ("Sprite_0A_Soldier", "sprite_behavior", "Soldier", "main behavior"), ("Sprite_move_fast", "sprite_behavior", None, "move fast"), ("SpritePrep_Octorok", "sprite_initialization", None, "Octorok"), ("Garnish12_Spark", "visual_effect", "Spark", None), ("Garnish", "visual_effect", None, None),
        ("Link_Handle_Sword", "player_action", None, "Handle Sword"), ("Ancilla_Bomb", "ancilla_effect", None, "Bomb"), ("DashDust_Draw_It", "effect", "DashDust_Draw", "It"), ("Fireball_Init", "effect", "Fireball", "Init"), ("Tile_CheckWall", "check_condition", None, "Tile CheckWall"),
        ("BossSpawnMinion", "spawn_entity", None, "BossSpawnMinion"), ("Room_Initialize", "initialization", None, "Room Initialize"), ("InitVram", "initialization", None, "InitVram"), ("DrawHud", "graphics", None, "DrawHud"), ("MoveCamera", "movement", None, "MoveCamera"), ("TakeDamage", "damage_system", None, "TakeDamage"),
        ("ReadJoypad_Fast", "unknown", None, "Read Joypad Fast"),
    ])),
)


@query(f"select id, name, category, entity, action from {_NAMES.sql}")
def routine_categories(spark, d):
    return _NAMES.df(spark).select("id", "name", routines.routine_info(F.col("name")).alias("i")).select("id", "name", "i.category", "i.entity", "i.action")


@query(f"select test_id, {sql_any('lower(prompt)', routines.CODE_WORDS)} or list_has_any(expected_ops, ['apply_patch', 'build_sandbox']) as code from test_cases where prompt is not null and expected_ops is not null")
def code_tasks(spark, d):
    rows = table(spark, d, "test_cases", "test_id", "prompt", "expected_ops").filter("prompt is not null and expected_ops is not null")
    return rows.select("test_id", routines.is_code_task(F.col("prompt"), F.col("expected_ops")).alias("code"))


def _entities_sql(text: str, patterns: list[str]) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({text}, '{p}', 1)" for p in patterns) + "])"


_TEXTS = Rows(
    "id bigint, text string, domain string",
    (1, "Call `Foo_Bar` and LinkState from Link_Main, Player_X, Sprite_Prep, Module_07; HitBox_Row @local Abc_Def", "asm"), (2, "class Widget uses FooBar::run and fooBar", "cpp"), (3, "LINKSTATE LinkState linkstate Link_main Link_Main", "hardware"), (4, None, "asm"), (5, "nothing here", None),
)


@query(f"""with t as (select id, case when domain like 'asm%' then {_entities_sql("coalesce(text, '')", graph.ENTITY_PATTERNS + graph.ASM_ENTITIES)} when domain = 'cpp' then {_entities_sql("coalesce(text, '')", graph.ENTITY_PATTERNS + graph.CPP_ENTITIES)} else {_entities_sql("coalesce(text, '')", graph.ENTITY_PATTERNS)} end as e from {_TEXTS.sql})
select id, array_to_string(list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i), ',') as entities from t""")
def entity_cases(spark, d):
    return _TEXTS.df(spark).select("id", F.array_join(graph.entities(F.col("text"), F.col("domain")), ",").alias("entities"))


@query(f"""with t as (select rec_id, instruction || ' ' || coalesce(input, '') || ' ' || coalesce(output, '') as t, domain from {_LIBRARY}), e as (select rec_id, case when domain like 'asm%' then {_entities_sql("t", graph.ENTITY_PATTERNS + graph.ASM_ENTITIES)} else {_entities_sql("t", graph.ENTITY_PATTERNS)} end as e from t)
select rec_id, len(list_distinct(list_transform(e, lambda y: lower(y)))) as n, e[1] as first from e""")
def record_entities(spark, d):
    text = F.concat_ws(" ", "instruction", or_empty(F.col("input")), or_empty(F.col("output")))
    found = base._library(spark, d, "instruction", "input", "output", "domain").select("rec_id", graph.entities(text, F.coalesce("domain", F.lit(""))).alias("e"))
    return found.select("rec_id", F.size("e").cast("bigint").alias("n"), F.try_element_at("e", F.lit(1)).alias("first"))


_REFERENCES = "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(coalesce(output, ''), '{p}', 1)" for p in graph.ROUTINE_REFERENCES) + "]))"


@query(f"""with n as (select distinct lower(unnest(kg_entities)) as k from pattern_library), r as (select rec_id, unnest({_REFERENCES}) as reference from {_LIBRARY}) select rec_id, reference from r where lower(reference) not in (select k from n where k is not null)""")
def unknown_routines(spark, d):
    known = table(spark, d, "pattern_library", "kg_entities").select(F.explode("kg_entities").alias("e")).select(F.lower("e").alias("lookup")).distinct()
    return graph.unknown_references(base._library(spark, d, "output"), "rec_id", graph.routine_references(F.col("output")), known)


@query(f"select rec_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(output, ''), '{graph.SYMBOL_REFERENCES[0]}', 1))), ',') as symbols from {_LIBRARY}")
def symbol_uses(spark, d):
    return base._library(spark, d, "output").select("rec_id", F.array_join(graph.symbol_references(F.col("output")), ",").alias("symbols"))


_PROSE = ["fault_finding", "chip_facts"]


def _dispatch_sql() -> str:
    text, code = (registered_sql()[name] for name in ("text_reply_verdict", "asm_verdict"))
    return f"""with p as (select result_id, error, {sql_norm("category")} as category from {_RESULTS} r left join test_cases c on {sql_norm("r.test_name")} = {sql_norm("c.name")}), t as ({text}), a as ({code}), m as (select *, case when coalesce(error, '') <> '' then 'error' when coalesce(category in ('fault_finding', 'chip_facts'), false) then 'text' else 'asm' end as mode from p)
select result_id, mode, case mode when 'error' then false when 'text' then t.valid else a.valid end as valid, case mode when 'error' then 0.0 when 'text' then t.score else a.score end::double as score from m join t using (result_id) join a using (result_id)"""


@query(_dispatch_sql())
def response_dispatch(spark, d):
    rows = base._results(spark, d, "test_name", "response", "error").withColumn("_name", norm_label(F.col("test_name")))
    cases = table(spark, d, "test_cases", "name", "category").select(norm_label(F.col("name")).alias("_name"), norm_label(F.col("category")).alias("category"))
    joined = rows.join(cases, "_name", "left")
    return joined.select("result_id", validate.respond(F.col("response"), F.col("error"), F.col("category"), _PROSE, validate.listing(F.col("response"))).alias("v")).select("result_id", "v.*")


_CODES = Rows(
    "id bigint, domain string, code string, valid boolean, score double",
    (1, "asm", "LDA #$10\nSTA INIDISP\nRTS", True, 1.0), (2, "asm-x", "LDX #1\nFOO", True, 0.5), (3, "cpp", "int x = 1;\nreturn x;\n", True, 1.0), (4, "cpp", "int f( {\n return 1;\n", False, 0.7), (5, "text", "anything", True, 1.0), (6, None, None, True, 1.0), (7, "cpp", "int a = 1\nconst int b = 2;", True, 0.95), (8, "asm", "", True, 0.5),
)


@query(f"select id, valid, score from {_CODES.sql}")
def composite_verdicts(spark, d):
    verdict = validate.default_registry("code", "domain").composite()
    return _CODES.df(spark).select("id", verdict.alias("v")).select("id", "v.valid", F.round("v.score", 6).alias("score"))


@query(f"select id, case when domain like 'asm%' then case id when 1 then 1.0 else 0.5 end else 1.0 end::double as score, coalesce(domain not like 'asm%', true) as skipped, case when domain like 'asm%' then case id when 1 then 0.75 else 0.5 end when domain = 'cpp' then score else 1.0 end::double as enhanced from {_CODES.sql}")
def batch_verdicts(spark, d):
    """One validator over all records, and the enhanced registry without an assembler."""
    one, all_of = validate.default_registry("code", "domain").batch("listing"), validate.enhanced_registry("code", "domain").composite()
    rows = _CODES.df(spark).select("id", one.alias("v"), all_of.alias("w"))
    return rows.select("id", F.round("v.score", 6).alias("score"), F.exists("v.warnings", lambda x: F.contains(x, F.lit("domain mismatch"))).alias("skipped"), F.round("w.score", 6).alias("enhanced"))


_ASSEMBLED = Rows("id bigint, found boolean, ok boolean, semantic double", (1, True, True, 0.5), (2, True, False, 1.0), (3, False, None, 0.25))


@query(f"select id, case when not found then true else ok end as valid, case when not found then 0.5 when ok then 1.0 else 0.0 end::double as score, case when not found then 0.5 when ok then 1.0 else 0.0 end::double * 0.6::double + semantic * 0.4::double as combined from {_ASSEMBLED.sql}")
def assembler_scores(spark, d):
    v = validate.assembled(F.col("found"), F.col("ok"))
    return _ASSEMBLED.df(spark).select("id", v["valid"].alias("valid"), v["score"].alias("score"), validate.assembled_score(F.when(F.col("found"), F.col("ok")), F.col("semantic")).alias("combined"))


_CPP = Rows("id bigint, code string, missing bigint", (1, "int a = 1\nreturn b\nf(x)\nif (x)\n}", 3), (2, "class A {\n};\n// note\n#include <x>", 0), (3, None, 0), (4, "x = 1;\ny = 2", 1))


@query(f"select id, missing from {_CPP.sql}")
def semicolons(spark, d):
    return _CPP.df(spark).select("id", validate.missing_semicolons(F.col("code")).cast("bigint").alias("missing"))


_RULES = [(["optimize", "faster"], "din"), (["debug", "crash"], "farore"), (["write"], "nayru")]
_CHATS = Rows("id bigint, prompt string, strategy string, models string", (1, "Make it FASTER", "route", "din"), (2, "debug and optimize", "route", "din"), (3, "why a crash", "route", "farore"), (4, "hello", "route", "veran"), (5, "hello", "ensemble", "din,farore,nayru"), (6, None, "route", "veran"))


@query(f"select id, models from {_CHATS.sql}")
def chat_routes(spark, d):
    return _CHATS.df(spark).select("id", F.array_join(classify.chat_models(F.col("prompt"), _RULES, F.col("strategy"), "veran"), ",").alias("models"))


_LONG = Rows("id bigint, line string, long boolean", (1, "LDA.l $7E0000", True), (2, "jsl Foo", True), (3, "JML Bar", True), (4, "db Foo>>16", True), (5, "LDA $10", False), (6, None, None), (7, "lda.w x", False))


@query(f"select id, long from {_LONG.sql}")
def long_contexts(spark, d):
    return _LONG.df(spark).select("id", routines.is_long_context(F.col("line")).alias("long"))


_SAYS = Rows("id bigint, code string, says string", (1, "LDA #1\nSTA $10\nRTS", "This code loads values, stores values, returns."), (2, "nothing", "This code holds no known instruction."), (3, None, "This code holds no known instruction."), (4, "JSR X\nBEQ y\nADC #1\nAND #2\nASL A\nREP #$20", "This code calls subroutines, branches, does arithmetic, tests or masks bits, shifts bits, switches register widths."))


@query(f"select id, says from {_SAYS.sql}")
def explanations(spark, d):
    return _SAYS.df(spark).select("id", routines.explanation(F.col("code")).alias("says"))


_PROMPTS = Rows("id bigint, instruction string", (1, "Optimize this:\nLDA #1\nSTA $10"), (2, "Optimize this:\nRTS"), (3, "no code"), (4, None), (5, "Two:\nA:\nLDX #2"))
_KNOWN = Rows("code string, explanation string", ("RTS", "It returns."))


@query(f"""select id, 'Explain this 65816 code:' || chr(10) || substr(instruction, position(':' || chr(10) in instruction) + 2) as instruction, case id when 1 then 'This code loads values, stores values.' when 2 then 'It returns.' else 'This code loads values.' end as output from {_PROMPTS.sql} where contains(instruction, ':' || chr(10))""")
def inverted_prompts(spark, d):
    return routines.inverted_prompts(_PROMPTS.df(spark), "id", "instruction", _KNOWN.df(spark))


_ABSTRACTS = Rows("id bigint, text string, abstract string", (1, "Title\nAbstract\nWe  do\nthis.\n1 Introduction\nmore", "We do this."), (2, "ABSTRACT: short one\nKeywords: x", "short one"), (3, "no such part", None), (4, None, None), (5, "Abstract\n" + "word " * 400, "word " * 239 + "word ..."))


@query(f"select id, abstract from {_ABSTRACTS.sql}")
def abstracts(spark, d):
    return _ABSTRACTS.df(spark).select("id", segment.abstract(F.col("text")).alias("abstract"))


_STATES = Rows("id bigint, content string, state string", (1, "x\n### Current Status: fine\n### Errors: none\nDecision: go on\n\nrest", "### Current Status: fine\n\n### Errors: none\nDecision: go on\n\nrest\n\nDecision: go on"), (2, "nothing", ""), (3, "### details: a\n### next steps: b", "### details: a\n\n### next steps: b"))


@query(f"select id, state from {_STATES.sql}")
def state_parts(spark, d):
    return _STATES.df(spark).select("id", segment.state_sections(F.col("content")).alias("state"))


_MARKS = Rows("id bigint, listing string", (1, "LDA #1 ; TODO: fix the crash\nRTS\n; FIXME add a table"), (2, "; HACK: explain this\n; XXX cleanup it\n; BUG it is wrong\n; note: nothing"), (3, "no marks; here"), (4, None))


@query(rf"""with l as (select id, unnest(string_split(listing, chr(10))) as line, generate_subscripts(string_split(listing, chr(10)), 1) - 1 as line_no from {_MARKS.sql}), m as (select id, line_no, upper(regexp_extract(line, '(?i);\s*(TODO|FIXME|HACK|XXX|BUG|NOTE)\s*:?\s*(.+)', 1)) as marker, {sql_strip(r"regexp_extract(line, '(?i);\s*(TODO|FIXME|HACK|XXX|BUG|NOTE)\s*:?\s*(.+)', 2)")} as task from l where regexp_matches(line, '(?i);\s*(TODO|FIXME|HACK|XXX|BUG|NOTE)\s*:?\s*(.+)')),
t as (select *, case {' '.join('when ' + sql_any('lower(task)', w) + f' then {chr(39)}{t}{chr(39)}' for t, w in routines.TASKS.items())} else 'unknown' end as task_type from m)
select id, line_no::int as line_no, marker, task, task_type, case when marker in ('BUG', 'FIXME') then 'bugs' else 'todos' end as category, case task_type when 'bug' then 'hard' when 'feature' then 'expert' when 'documentation' then 'easy' else 'medium' end as difficulty from t""")
def task_marks(spark, d):
    return routines.task_cases(_MARKS.df(spark), "id", "listing").drop("before", "after")


_ASKED = Rows("id bigint, prompt string, task string", (1, "Write a routine that clears $7E0010.", "clears $7E0010"), (2, "Please create code to draw the HUD!", "draw the HUD"), (3, "Explain this", "Explain this"), (4, None, None), (5, "Generate a 65816 assembly function for sorting", "sorting"))


@query(f"select id, task from {_ASKED.sql}")
def prompt_tasks(spark, d):
    return _ASKED.df(spark).select("id", routines.extract_task(F.col("prompt")).alias("task"))


# --- joins, catalogs --------------------------------------------------------------------------------------

_EDGES = Rows("source string, target string, relation string", ("alttp:Link", "alttp:Sword", "uses"), ("alttp:Moblin", "alttp:Link", "hurts"), ("x", "y", "none"), ("link2", "LINK", "both"))


@query(f"select *, case when contains(lower(source), 'link') then 'outgoing' else 'incoming' end as direction from {_EDGES.sql} where contains(lower(source), 'link') or contains(lower(target), 'link')")
def related_entities(spark, d):
    return graph.neighbours(_EDGES.df(spark), "Link")


@query("select distinct e as name from (select unnest(kg_entities) as e from pattern_library) where contains(lower(e), 'beacon') order by name limit 10")
def node_suggestions(spark, d):
    nodes = table(spark, d, "pattern_library", "kg_entities").select(F.explode("kg_entities").alias("name")).distinct()
    return graph.suggestions(nodes, "Beacon", "name")


_LOG = Rows("name string, seq bigint, state string", ("a", 1, "created"), ("a", 2, "deleted"), ("b", 1, "deleted"), ("b", 3, "created"), ("d", 1, "paused"))
_TREES = Rows("name string", ("a",), ("b",), ("c",), ("d",))


@query(f"select name, coalesce(state, 'untracked') as state from {_TREES.sql} left join (select name, arg_max(state, seq) as state from {_LOG.sql} group by 1) using (name) where coalesce(state, 'untracked') <> 'deleted'")
def tracked_listing(spark, d):
    return graph.listing_with_state(_TREES.df(spark), _LOG.df(spark), "name", "seq", "state", "deleted")


_EXPECTED = Rows("name string, bytes bigint, digest string", ("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x"), ("d", 4, "x"))
_ACTUAL = Rows("name string, bytes bigint, digest string", ("a", 1, "x"), ("b", 9, "x"), ("c", 3, "y"), ("e", 5, "x"))


@query(f"select coalesce(e.name, a.name) as name, case when a.name is null then 'missing' when e.name is null then 'extra' when e.bytes <> a.bytes then 'size_mismatch' when e.digest <> a.digest then 'corrupted' else 'verified' end as status from {_EXPECTED.sql} e full join {_ACTUAL.sql} a on e.name = a.name")
def manifest_statuses(spark, d):
    return graph.manifest_diff(_EXPECTED.df(spark), _ACTUAL.df(spark), "name", "bytes", "digest")


@query("select count(*) as files, coalesce(sum(n_chars), 0) as bytes from documents")
def manifest_totals(spark, d):
    return graph.manifest_totals(_docs(spark, d, "n_chars"), "n_chars")


_MODELS = Rows("dir string, name string, bytes bigint", ("m1", "adapter_config.json", 10), ("m1", "model.safetensors", 1000), ("m1", "checkpoint-20", 5), ("m1", "checkpoint-100", 5), ("m2", "model.gguf", 70), ("m3", "notes.txt", 1))


@query(f"select dir, sum(bytes) as bytes, bool_or(regexp_matches(name, '^adapter_')) as has_adapter, bool_or(regexp_matches(name, '\\.safetensors$')) as has_weights, bool_or(regexp_matches(name, '\\.gguf$')) as has_gguf, coalesce(array_to_string(list_sort(list_distinct(list(nullif(regexp_extract(name, '^checkpoint-(\\d+)$', 1), '')::bigint))), ','), '') as checkpoints from {_MODELS.sql} group by dir")
def model_inventory(spark, d):
    found = graph.inventory(_MODELS.df(spark), "dir", "name", "bytes", {"adapter": "^adapter_", "weights": r"\.safetensors$", "gguf": r"\.gguf$"})
    return found.withColumn("checkpoints", F.array_join("checkpoints", ","))


@query("select doc_id, md5(text) as md5, row_number() over (partition by md5(text) order by doc_id) > 1 as duplicate from documents where text <> '' union all select doc_id, null, false from documents where coalesce(text, '') = ''")
def duplicate_documents(spark, d):
    return dedup.content_duplicates(_docs(spark, d).join(table(spark, d, "documents", "doc_id", "text"), "doc_id"), "text", [F.col("doc_id")]).select("doc_id", "md5", "duplicate")


_WORDS = Rows("id bigint, tags array<string>, kept string", (1, ["A", "b", "a", "B", "c"], "A,b,c"), (2, [], ""), (3, None, None), (4, ["x", "X", "x"], "x"))


@query(f"select id, kept from {_WORDS.sql}")
def distinct_tags(spark, d):
    return _WORDS.df(spark).select("id", F.array_join(dedup.distinct_ignoring_case(F.col("tags")), ",").alias("kept"))


# --- events, splits, samples -------------------------------------------------------------------------------

_TURNS = Rows("chat bigint, seq bigint, role string, text string", (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (1, 4, "user", "q3"), (1, 5, "assistant", "a3"), (2, 1, "assistant", "hi"), (2, 2, "user", "bye"))


@query(f"select chat, seq, text, reply from (select *, lead(role) over w as r, lead(text) over w as reply from {_TURNS.sql} window w as (partition by chat order by seq)) where role = 'user' and r = 'assistant'")
def turn_pairs(spark, d):
    return events.pair_turns(_TURNS.df(spark), "chat", "seq", "role", "text").drop("role")


_SERIAL = Rows("log_id bigint, seq bigint, line string, is_inner boolean", (1, 1, "noise", False), (1, 2, "BEGIN", False), (1, 3, "x", True), (1, 4, "END", False), (1, 5, "y", False), (1, 6, "BEGIN", False), (1, 7, "z", True), (2, 1, "q", False))


@query(f"select log_id, seq, is_inner from {_SERIAL.sql}")
def marked_rows(spark, d):
    flagged = rewrite.running_flag(_SERIAL.df(spark).drop("is_inner"), "log_id", "seq", F.col("line") == "BEGIN", F.col("line") == "END", "is_inner")
    return flagged.select("log_id", "seq", "is_inner")


_ATTEMPTS = Rows("run bigint, seq bigint, ok boolean, back bigint", (1, 1, True, None), (1, 2, True, None), (1, 3, False, 0), (1, 4, True, None), (2, 1, False, None), (2, 2, True, None))


@query(f"select run, seq, coalesce(last_value(back ignore nulls) over w + 1, sum(ok::int) over w)::bigint as next_step, max(case when ok then seq end) over w as last_success from {_ATTEMPTS.sql} window w as (partition by run order by seq rows between unbounded preceding and current row)")
def backtracked_steps(spark, d):
    return events.steps(_ATTEMPTS.df(spark), ["run"], ["seq"], F.col("ok"), F.col("back")).select("run", "seq", "next_step", "last_success")


@query(f"""with c as (select *, string_agg(event_type || ' ' || event_id::varchar, chr(10) || '---' || chr(10)) over (partition by user_id order by ts, event_id rows between 9 preceding and current row) as input from events), s as ({registered_sql()["spinning_detector"]})
select event_id, c.input, s.state from c join s using (event_id) where s.state is not null""")
def watcher_samples(spark, d):
    rows = base._events(spark, d)
    made = events.watcher_samples(rows, ["user_id"], ["ts", "event_id"], "event_type", F.coalesce(F.col("value") < 20, F.lit(False)), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")), slice_of=base._day())
    return made.select("event_id", "input", F.get_json_object("output", "$.progress_status").alias("state"))


@query("select kind, doc_id, rank from (select kind, doc_id, row_number() over (partition by kind order by doc_id) as rank from documents) where rank <= case kind when 'wiki_page' then 5 when 'qa_thread' then 2 else 3 end")
def capped_pools(spark, d):
    return events.capped(_docs(spark, d, "kind"), "kind", [F.col("doc_id")], {"wiki_page": 5, "qa_thread": 2}, 3)


@query(f"select result_id, array_to_string(missing_keywords[:3], ',') as shown from {_RESULTS} where missing_keywords is not null")
def capped_errors(spark, d):
    return base._results(spark, d, "missing_keywords").filter("missing_keywords is not null").select("result_id", F.array_join(F.slice("missing_keywords", 1, 3), ",").alias("shown"))


_LISTED = Rows("name string", ("b10",), ("b9",), ("B2x3",), ("a",), ("10",), ("9z",))


@query("select name, row_number() over (order by array_to_string(list_transform(regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)', 1), lambda x: case when regexp_matches(x, '^[0-9]') then lpad(x, 20, '0') else x end), '')) as place from " + _LISTED.sql)
def natural_order(spark, d):
    from pyspark.sql import Window as W

    return _LISTED.df(spark).select("name", F.row_number().over(W.orderBy(events.natural_key(F.col("name")))).alias("place"))


@query("select split, count(*) as n from (select case when ('0x' || substr(md5('42|' || o_orderkey::varchar), 1, 8))::bigint / 4294967296.0 < 0.95 then 'train' else 'val' end as split from orders) group by 1")
def random_split_95_5(spark, d):
    return mix.random_split(table(spark, d, "orders", "o_orderkey"), "o_orderkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"with s as ({base._SPLIT}), o as (select * from s union all select rec_id, source, 'val' from s where split = 'eval') select rec_id, split, row_number() over (partition by split order by md5('42|' || case split when 'val' then 'eval' else split end || '|' || rec_id::varchar)) as place from o")
def mix_outputs(spark, d):
    from pyspark.sql import Window as W

    out = mix.shuffled_outputs(base.stratified_split(spark, d), "rec_id")
    return out.select("rec_id", "split", F.row_number().over(W.partitionBy("split").orderBy("place")).alias("place"))


_SLOTS = {"what": ["a loop", "a table", "a timer"], "place": ["bank 7", "the menu"]}
_TEMPLATES = Rows("id bigint, instruction string, output string, thinking string", (1, "Write {what} for {place}.", "Here is {what} in {place}.", "It needs {what}."), (2, "Show {what}.", "{what}: done.", "First {what}."))


def _draw(slot: str, place: str) -> str:
    options = _SLOTS[slot]
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][1 + floor(('0x' || substr(md5('42|' || id::varchar || '|' || draw::varchar || '|{slot}|{place}'), 1, 8))::bigint / 4294967296.0 * {len(options)})::int]"


def _filled(column: str, place: str) -> str:
    for slot in _SLOTS:
        column = f"replace({column}, '{{{slot}}}', {_draw(slot, place)})"
    return column


@query(f"select id, draw::int as draw, {_filled('instruction', 'instruction')} as instruction, {_filled('output', 'output')} as output, {_filled('thinking', 'output')} as thinking from (select *, unnest(range(6)) as draw from {_TEMPLATES.sql})")
def template_samples(spark, d):
    return generate.expand(_TEMPLATES.df(spark), "id", 6, "instruction", "output", _SLOTS, "thinking")


# A few hardware registers with what they do.
_PARTS = Rows("address string, name string, purpose string, note string", ("$2100", "INIDISP", "sets the screen's brightness", "Bit 7 blanks the screen."), ("$4200", "NMITIMEN", "enables interrupts", None), ("$420B", "MDMAEN", "starts a transfer", ""))


@query(f"""select address, 'reference' as kind, 'What does register ' || name || ' (' || address || ') do?' as instruction, name || ' (' || address || ') ' || purpose || '.' as output from {_PARTS.sql} union all select address, 'lookup', 'Which register ' || purpose || '?', name || ' (' || address || ')' from {_PARTS.sql}
union all select address, 'warning', 'What must be kept in mind with ' || name || '?', note from {_PARTS.sql} where coalesce(note, '') <> ''""")
def register_samples(spark, d):
    return generate.register_samples(_PARTS.df(spark))


@query(f"""select address, 'conflict' as kind, 'Documentation: ' || name || ' is at ' || address || chr(10) || 'Code Change: STA ' || address || ' ; Store Link''s Health' as input from (select * from {_PARTS.sql} order by address limit 2) union all select address, 'no_conflict', 'Documentation: ' || name || ' is at ' || address || chr(10) || 'Code Change: LDA !' || name || ' ; Load the ' || name || ' state' from (select * from {_PARTS.sql} order by address limit 2)""")
def conflict_samples(spark, d):
    return generate.conflict_samples(_PARTS.df(spark).select("address", "name"), 2).select("address", "kind", "input")


_LOGS = Rows("log_id bigint, text string", (1, "commit 0123456789abcdef\nDate: today\n\n    Fix the crash\n\n    It was late.\n\ndiff --git a b\n+1\n+2\n+3\n+4\ncommit abcdef0123\n\n    Add a table\n"), (2, "commit 00000000\n\n    Update notes\n\ndiff --git a b\n" + "\n".join(f"+{k}" for k in range(300))), (3, "no log"), (4, None))
_MADE = Rows(
    "hash string, kind string, lines bigint, output string",
    ("0123456789abcdef", "summary", 7, "Fix the crash\n\nIt was late."), ("0123456789abcdef", "bugfix", 1, "Fix the crash\n\nIt was late."), ("abcdef0123", "feature", 1, "Add a table"), ("00000000", "summary", 202, "Update notes"),
)


@query(f"select * from {_MADE.sql}")
def commit_samples(spark, d):
    made = routines.commit_samples(routines.parse_commits(_LOGS.df(spark), "log_id", "text"), "log_id")
    return made.select("hash", "kind", F.size(F.split("input", "\n")).cast("bigint").alias("lines"), "output")


# --- formats ------------------------------------------------------------------------------------------------


@query(f"""select rec_id, case when coalesce(instruction, '') <> '' then 1 else 0 end + case when coalesce(output, '') <> '' then 1 else 0 end + 1 as turns, case {sql_norm("domain")} when 'debug' then 'You are Farore, a 65816 assembly debugging expert. Analyze bugs, identify issues, and explain fixes.' when 'hardware' then 'You are Veran, a 65816 assembly hardware expert. Explain SNES hardware, registers, and low-level operations.' else 'You are a helpful 65816 assembly expert.' end as system
from {_LIBRARY} where coalesce(instruction, '') <> '' or coalesce(output, '') <> ''""")
def expert_chats(spark, d):
    expert = F.when(norm_label(F.col("domain")) == "debug", "farore").when(norm_label(F.col("domain")) == "hardware", "veran")
    rows = base._library(spark, d, "instruction", "output", "domain").select("rec_id", formats.expert_messages(expert, F.col("instruction"), F.col("output")).alias("m"))
    return rows.filter(F.size("m") >= 2).select("rec_id", F.size("m").alias("turns"), F.col("m")[0]["content"].alias("system"))


@query(f"select rec_id, coalesce(instruction, '') as input, coalesce(output, '') as output, coalesce(input, '') as context, coalesce(domain, 'unknown') as domain, 'chat_distillation_' || coalesce(source, 'unknown') as source, 'distillation,farore' as tags from {_LIBRARY}")
def pool_records(spark, d):
    c = F.col
    rows = base._library(spark, d, "instruction", "input", "output", "domain", "source")
    made = rows.select("rec_id", formats.pool_record(c("instruction"), c("output"), c("input"), c("domain"), c("source"), F.lit("farore"), F.lit(None).cast("double"), F.lit(None).cast("string")).alias("p"))
    return made.select("rec_id", "p.input", "p.output", "p.context", "p.domain", "p.source", F.array_join("p.metadata.tags", ",").alias("tags"))


@query(f"select rec_id, instruction, output, nullif(input, '') as input, nullif(thinking, '') as thinking, domain from {_LIBRARY}")
def sample_lines(spark, d):
    """Records as JSON lines, read back."""
    c = F.col
    rows = base._library(spark, d, "instruction", "input", "output", "thinking", "domain")
    text = rows.select("rec_id", formats.sample_json(c("instruction"), c("output"), c("input"), c("thinking"), F.struct("domain")).alias("j"))
    get = lambda k: F.get_json_object("j", f"$.{k}").alias(k.split(".")[-1])
    return text.select("rec_id", *(get(k) for k in ("instruction", "output", "input", "thinking", "_metadata.domain")))


# --- rollups ---------------------------------------------------------------------------------------------------


@query(f"""with r as (select *, {sql_norm("test_name")} as benchmark from {_RESULTS} where test_name is not null), h as {base._texts("benchmark", "expert", "r")}
select r.benchmark, count(*) as attempts, count(*) filter (passed) as successes, avg(len(missing_keywords)) as avg_iterations, avg(round(latency_ms)::bigint) as avg_duration, count(*) filter (error is not null) as thinking_uses, any_value(h) as experts from r left join h using (benchmark) group by r.benchmark""")
def benchmark_rollup(spark, d):
    """Results as benchmark attempts: keywords missed as iterations, latency as duration, noted errors as uses of thinking."""
    rows = base._results(spark, d, "test_name", "passed", "missing_keywords", "latency_ms", "expert", "error").filter("test_name is not null").withColumn("benchmark", norm_label(F.col("test_name")))
    missed = F.when(F.col("missing_keywords").isNotNull(), F.size("missing_keywords"))
    return profile.benchmark_rollup(rows, "benchmark", F.col("passed"), missed, F.round("latency_ms").cast("bigint"), F.col("expert"), F.col("error").isNotNull())


_KINDS = "['routing', 'tool', 'thinking', 'iteration', 'reflection'][1 + event_id % 5]"


@query(f"""with e as (select *, {_KINDS} as kind, coalesce(value >= 20, false) as ok from events), h as {base._texts("user_id", "case when kind = 'routing' then event_type end", "e")}
select user_id, count(*) filter (kind = 'tool' and ok) as tool_success, count(*) filter (kind = 'tool' and not ok) as tool_fail, count(*) filter (kind = 'tool' and ok) / nullif(count(*) filter (kind = 'tool'), 0) as tool_success_rate, count(*) filter (kind = 'thinking') as thinking_uses, count(*) filter (kind = 'iteration') as iterations,
count(*) filter (kind = 'iteration' and ok) as successes, count(*) filter (kind = 'reflection' and value > 90) as backtracks, any_value(h) as expert_calls from e left join h using (user_id) group by user_id""")
def session_stats(spark, d):
    """Events as the log of sessions: the kind goes by the id, a value of 20 or more is a success."""
    kind = F.get(F.array(*map(F.lit, ["routing", "tool", "thinking", "iteration", "reflection"])), (F.col("event_id") % 5).cast("int"))
    return profile.session_stats(base._events(spark, d), "user_id", kind, F.col("event_type"), F.coalesce(F.col("value") >= 20, F.lit(False)), F.coalesce(F.col("value") > 90, F.lit(False)))


@query("""select count(*) as total, count(*) filter (finished_at is not null) as successes, count(*) - count(*) filter (finished_at is not null) as failures, count(*) filter (finished_at is not null) / count(*) as success_rate, avg(n_tests) as avg_iterations, avg((epoch_us(finished_at) - epoch_us(started_at)) / 1e6) as avg_duration from eval_runs""")
def run_summary(spark, d):
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return profile.run_summary(table(spark, d, "eval_runs", "started_at", "finished_at", "n_tests"), F.col("finished_at").isNotNull(), F.col("n_tests"), seconds)


@query(f"with s as (select {sql_norm('c.category')} as category, score from {_RESULTS} r join test_cases c on {sql_norm('r.test_name')} = {sql_norm('c.name')}) select category, avg(score) as mean_score, count(*) as n, grouping(category) = 1 as is_total from s group by rollup (category)")
def category_scores(spark, d):
    cases = table(spark, d, "test_cases", "name", "category").select(norm_label(F.col("name")).alias("_n"), norm_label(F.col("category")).alias("_c"))
    rows = base._results(spark, d, "test_name", "score").withColumn("_n", norm_label(F.col("test_name"))).join(cases, "_n")
    return profile.mean_scores(rows, F.col("_c"), F.col("score"))


@query("select kind, count(*) as n, count(*) * 100.0::double / sum(count(*)) over () as percent from documents group by kind")
def kind_percentages(spark, d):
    return profile.percentages(_docs(spark, d, "kind"), F.col("kind"), "kind")


@query("select kind, count(*) as n from documents group by kind")
def type_counters(spark, d):
    return profile.histogram(_docs(spark, d, "kind"), F.col("kind"), "kind")


@query("select source, kind, count(*) as n from documents group by all")
def index_by_root(spark, d):
    return _docs(spark, d, "source", "kind").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with i as ({registered_sql()["health_checks"]}) select id, level, kind, kind not in ('disk_warning') as sent from i""")
def health_alerts(spark, d):
    """Alerts of the health checks, those of a switched-off event not sent."""
    event = F.when(F.col("kind") == "disk_warning", "disk-warning")
    return health_checks(spark, d).withColumn("sent", ~validate.suppressed(event, {"alert_on_disk_warning": False}))


# Tools of an agent by category.
_TOOLS = Rows("name string, category string", ("read_file", "code"), ("apply_patch", "code"), ("build_sandbox", "build"), ("run_emulator", "emulator"), ("search_kg", "knowledge"), ("explain", "knowledge"))


@query(f"select name from {_TOOLS.sql} where category = 'knowledge'")
def tools_by_category(spark, d):
    none = F.lit(None).cast("array<string>")
    return _TOOLS.df(spark).filter(curate.selected(F.col("category"), F.lit(None).cast("string"), none, "knowledge")).select("name")


_WAITS = Rows("attempt bigint", *((k,) for k in range(8)))


@query(f"select attempt, least(pow(2.0, attempt), 60.0) as plain, least(pow(2.0, attempt), 60.0) * 1.5 as jittered from {_WAITS.sql}")
def backoff_seconds(spark, d):
    a = F.col("attempt")
    return _WAITS.df(spark).select("attempt", validate.backoff(a).alias("plain"), validate.backoff(a, jitter=F.lit(0.5)).alias("jittered"))
