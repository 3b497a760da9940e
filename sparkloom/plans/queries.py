"""Queries over the driver's tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import asm
from ..functions.text import lines, or_empty, slug, strip
from ..operators import classify, curate, dedup, events, formats, graph, mix, profile, rewrite, routines, segment, validate
from ..runtime import norm_label, table

from .registry import query
from .registry import sql_any as _any
from .registry import sql_hits as _hits
from .registry import sql_norm as _norm
from .registry import sql_strip as _strip
from .registry import sql_uniform as _uniform


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import cases, registry  # registers more

    return registry.registered() if cases else {}


def oracle_sql() -> dict[str, str]:
    from . import cases, registry

    return registry.registered_sql() if cases else {}


# --- deduplication and profiles --------------------------------------------------------------------

_LIBRARY = "(select * from (select *, row_number() over (partition by rec_id order by loaded_at) as rn from pattern_library) where rn = 1)"


def _library(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """pattern_library, each rec_id once."""
    return dedup.first_per_key(table(spark, d, "pattern_library", "rec_id", "loaded_at", *columns), F.col("rec_id"), [F.col("loaded_at")])


_KEY = f"sha1({_strip(chr(39) * 0 + 'coalesce(instruction, ' + chr(39) * 2 + ')')} || chr(10) || {_strip('coalesce(input, ' + chr(39) * 2 + ')')} || chr(10) || {_strip('coalesce(output, ' + chr(39) * 2 + ')')})"


@query(f"""select lang, source, count(*) as kept, sum(n_chars) as chars from (
  select *, row_number() over (partition by sha1({_strip("text")}) order by doc_id) as rn from documents where {_strip("coalesce(text, '')")} <> '') where rn = 1 group by lang, source""")
def gold_dedup(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source", "n_chars").filter(strip(or_empty(F.col("text"))) != "").withColumn("key", dedup.record_key("text")).drop("text")
    kept = dedup.first_per_key(docs, F.col("key"), [F.col("doc_id")])
    return kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_chars").alias("chars"))


@query(f"""with r as (select *, {_strip("coalesce(instruction, '')")} = '' or {_strip("coalesce(output, '')")} = '' as missing from pattern_library),
k as (select *, case when missing then 'missing' when row_number() over (partition by missing, {_KEY} order by loaded_at, rec_id) > 1 then 'duplicate' else 'kept' end as status from r)
select {_norm("source")} as source, status, count(*) as n from k group by all""")
def gold_report(spark, d):
    rows = table(spark, d, "pattern_library", "rec_id", "loaded_at", "instruction", "input", "output", "source")
    return dedup.gold(rows, [F.col("loaded_at"), F.col("rec_id")]).groupBy(norm_label(F.col("source")).alias("source"), "status").agg(F.count(F.lit(1)).alias("n"))


@query("""select kind, count(*) as files, count(distinct md5(text)) as distinct_files, count(*) - count(distinct md5(text)) as duplicates from documents where text <> '' group by kind""")
def content_dedup(spark, d):
    docs = table(spark, d, "documents", "kind", "text").filter("text <> ''").groupBy("kind", F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return docs.groupBy("kind").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("distinct_files"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query("""select rec_id, key from (select rec_id, substr(instruction, 1, 100) as key, row_number() over (partition by substr(instruction, 1, 100) order by rec_id, loaded_at) as rn from pattern_library where coalesce(instruction, '') <> '') where rn = 1""")
def prefix_key_dedup(spark, d):
    rows = table(spark, d, "pattern_library", "rec_id", "instruction", "loaded_at").withColumn("key", F.substring("instruction", 1, 100)).filter("key <> ''").drop("instruction")
    return dedup.first_per_key(rows, F.col("key"), [F.col("rec_id"), F.col("loaded_at")]).select("rec_id", "key")


@query(f"""with p as (select rec_id, instruction, {_norm("source")} as source from {_LIBRARY}), a as (select * from p where source = 'synthetic'),
b as (select * from (select *, row_number() over (partition by instruction order by rec_id) as rn from p where source = 'distilled') where rn = 1)
select rec_id, source from a union all select rec_id, source from b where not exists (select 1 from a where a.instruction = b.instruction)""")
def combine_priority_antijoin(spark, d):
    rows = _library(spark, d, "instruction", "source").withColumn("source", norm_label(F.col("source")))
    return dedup.combine_by_priority(rows.filter("source = 'synthetic'"), rows.filter("source = 'distilled'"), "instruction", [F.col("rec_id")]).select("rec_id", "source")


@query("""select count(*) as total, 0 as parse_errors, count(*) filter (coalesce(instruction, '') = '') as missing_instruction, count(*) filter (coalesce(output, '') = '') as missing_output,
sum(length(coalesce(instruction, ''))) as instruction_chars, sum(length(coalesce(output, ''))) as output_chars, sum(length(coalesce(output, ''))) / count(*) as mean_output, max(length(coalesce(output, ''))) as max_output,
count(*) filter (contains(coalesce(output, ''), '```')) as fenced from pattern_library""")
def qa_profile(spark, d):
    return profile.qa_profile(table(spark, d, "pattern_library", "instruction", "output"))


@query("select coalesce(nullif(domain, ''), 'unknown') as domain, count(*) as n from pattern_library group by all")
def qa_domain_histogram(spark, d):
    return profile.histogram(table(spark, d, "pattern_library", "domain"), F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown")), "domain")


@query(f"select coalesce({_norm('source')}, 'unknown') as source, count(*) as n from pattern_library group by all order by n desc, source limit 5")
def qa_source_top5(spark, d):
    return profile.top_values(table(spark, d, "pattern_library", "source"), F.coalesce(norm_label(F.col("source")), F.lit("unknown")), "source")


# --- cleaning and gates ----------------------------------------------------------------------------


def _clean_sql(x: str) -> str:
    for p in curate.MARKERS:
        x = f"regexp_replace({x}, '{p}', '', 'gi')"
    x = rf"regexp_replace({x}, '\borg\s+\$[0-9A-Fa-f]+\b', '', 'gi')"
    return _strip(rf"regexp_replace({_strip(rf'''regexp_replace({x}, '\s+', ' ', 'g')''')}, '[\s,;:]+$', '')")


@query(f"select rec_id, {_clean_sql('instruction')} as cleaned, {_clean_sql('instruction')} <> instruction as changed from {_LIBRARY}")
def clean_instructions(spark, d):
    cleaned = curate.clean_instruction(F.col("instruction"))
    return _library(spark, d, "instruction").select("rec_id", cleaned.alias("cleaned"), (cleaned != F.col("instruction")).alias("changed"))


_STRIPPED = r"'^[ .;:-]+|[ .;:-]+$', '', 'g'"
_NORMALIZED = rf"""with b as (select rec_id, {_strip("coalesce(instruction, '')")} as raw, {_strip("coalesce(output, '')")} as output, domain, source from {_LIBRARY}), c as (select *, {_clean_sql("raw")} as cleaned from b),
s as (select rec_id, {_strip("unnest(string_split(output, chr(10)))")} as line, generate_subscripts(string_split(output, chr(10)), 1) as k from b),
label as (select rec_id, arg_min(regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_.]*)', 1), k) as label from s where not starts_with(line, ';') and not starts_with(line, '#_') and regexp_matches(line, '^[A-Za-z_][A-Za-z0-9_.]*[ \t]*::?[ \t]*\{{?$') group by 1),
w as (select rec_id, upper(regexp_extract(regexp_replace(regexp_replace(line, '^#_[^:]*:\s*', ''), '^[A-Za-z0-9_]+:\s*', ''), '^(\S+)', 1)) as h from s where line <> '' and not starts_with(line, ';')),
kind as (select rec_id, case when bool_or(h in ({", ".join(repr(m) for m in asm.MNEMONICS)})) then 'code' when bool_or(lower(h) in ({", ".join(repr(m) for m in asm.DIRECTIVES)})) then 'data' else 'unknown' end as kind from w group by 1),
r as (select c.*, coalesce(label, '') as label, coalesce(kind, 'unknown') as kind, starts_with(lower(cleaned), 'write a 65816 routine that') as generic, {_strip("substr(cleaned, 27)")} as rest from c left join label using (rec_id) left join kind using (rec_id)),
t as (select *, regexp_matches(regexp_replace({_strip(r"regexp_replace(replace(regexp_replace(regexp_replace(rest, 'org\s+\$[0-9A-Fa-f]+', '', 'gi'), '\$[0-9A-Fa-f]{4,6}', '', 'g'), 'org', ''), '[\s,;:]+', ' ', 'g')")}, {_STRIPPED}), '[A-Za-z]') as worded from r),
n as (select *, case when not generic then cleaned when worded then 'Write a 65816 routine that ' || regexp_replace(rest, {_STRIPPED}) || '.' else '' end as kept, case when label = '' then '' when kind = 'data' then 'Define the ASM data table ' || label || '.' else 'Write a 65816 routine named ' || label || '.' end as made from t),
i as (select *, case when kept <> '' then kept else made end as instruction from n)
select rec_id, instruction, output, coalesce(nullif({_strip("domain")}, ''), case when starts_with(lower(instruction), 'summarize') and contains(lower(instruction), 'asm change') then 'asm-git' when starts_with(lower(instruction), 'summarize') then 'asm-comment' when starts_with(lower(instruction), 'write a 65816 routine') then 'asm-generate' else 'asm' end) as domain,
coalesce(nullif({_strip("source")}, ''), 'unknown') as source, cleaned <> raw as instruction_cleaned, case when kept = '' and made <> '' then kind end as generated_kind,
case when output = '' then 'drop_missing_output' when instruction = '' then 'drop_empty_instruction' when contains(lower(instruction), 'todo') then 'drop_todo_instruction' end as reject_reason from i"""


@query(_NORMALIZED)
def normalize_records(spark, d):
    return curate.normalize_records(_library(spark, d, "instruction", "output", "domain", "source")).drop("loaded_at")


@query(f"select coalesce(reject_reason, 'kept') as reason, count(*) as n from ({_NORMALIZED}) group by 1")
def normalize_reject_stats(spark, d):
    return curate.reject_stats(curate.normalize_records(_library(spark, d, "instruction", "output", "domain", "source")))


@query(rf"""with l as (select doc_id, {_strip("unnest(string_split(text, chr(10)))")} as line from documents),
w as (select doc_id, upper(regexp_extract(regexp_replace(regexp_replace(line, '^#_[^:]*:\s*', ''), '^[A-Za-z0-9_]+:\s*', ''), '^(\S+)', 1)) as h from l where line <> '' and not starts_with(line, ';'))
select doc_id, case when bool_or(h in ({", ".join(repr(m) for m in asm.MNEMONICS)})) then 'code' when bool_or(lower(h) in ({", ".join(repr(m) for m in asm.DIRECTIVES)})) then 'data' else 'unknown' end as kind from (select doc_id, h from w union all select doc_id, '' from documents where text is not null) group by doc_id""")
def output_kind(spark, d):
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", asm.output_kind(F.col("text")).alias("kind"))


def _gate_sql(least: int, signs: list[str]) -> str:
    return f"length(coalesce(output, '')) >= {least} and length(coalesce(instruction, '')) >= 10 and (" + " or ".join(f"contains(coalesce(output, ''), '{s}')" for s in signs) + ")"


@query(f"select rec_id, {_gate_sql(50, curate.CODE_SIGNS)} as strict, {_gate_sql(20, curate.RELAXED_SIGNS)} as relaxed from {_LIBRARY}")
def quality_gate(spark, d):
    i, o = F.col("instruction"), F.col("output")
    return _library(spark, d, "instruction", "output").select("rec_id", curate.quality_gate(i, o).alias("strict"), curate.quality_gate(i, o, 20, signs=curate.RELAXED_SIGNS).alias("relaxed"))


@query("select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview, case when length(text) > 500 then substr(text, 1, 450) || ' [more]' else text end as reply from documents where text is not null")
def previews(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", curate.preview(t, 200).alias("preview"), curate.preview(t, 500, " [more]", 450).alias("reply"))


@query("""with w as (select p_partkey, list_distinct(string_split(lower(p_name), ' ')) as tags from part) select p_partkey from w where list_has_any(tags, ['green', 'small', 'red', 'steel'])""")
def tag_overlap_filter(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").filter(F.arrays_overlap(F.split(F.lower("p_name"), " "), F.array(*map(F.lit, ["green", "small", "red", "steel"])))).select("p_partkey")


# --- classifiers -----------------------------------------------------------------------------------


def _domain_sql() -> str:
    parts = []
    for k, (name, (keywords, patterns, required)) in enumerate(classify.DOMAIN_RULES.items()):
        score = f"2.0 * {_hits('low', keywords)}" + "".join(f" + 3.0 * regexp_matches(t, '(?i){p}')::int" for p in patterns)
        parts.append(f"select rec_id, {k} as o, '{name}' as domain, " + (f"case when {_any('low', required)} then {score} else 0.0 end" if required else score) + " as score from x")
    return f"""with x as (select rec_id, instruction || ' ' || coalesce(output, '') as t, lower(instruction || ' ' || coalesce(output, '')) as low from {_LIBRARY}), s as ({" union all ".join(parts)})
select rec_id, domain, least(score::double / 10, 1.0) as confidence from (select *, row_number() over (partition by rec_id order by score desc, o) as rn from s) where rn = 1 and least(score::double / 10, 1.0) >= 0.3"""


@query(_domain_sql())
def classify_argmax(spark, d):
    text = F.concat(F.col("instruction"), F.lit(" "), or_empty(F.col("output")))
    return classify.domains(_library(spark, d, "instruction", "output"), text).select("rec_id", "domain", "confidence").filter("confidence >= 0.3")


@query(f"""with x as (select doc_id, lower(text) as low from documents where text is not null), m as (select doc_id, case when {_any("low", classify.POOLS["oos"])} then 'oos' when {_any("low", classify.POOLS["asm"])} then 'asm' end as pool from x
union all select doc_id, 'debug' from x where {_any("low", classify.POOLS["debug"])}) select pool, count(*) as n from m where pool is not null group by pool""")
def multi_label_pools(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    return docs.select(F.explode(classify.pools(F.col("text"))).alias("pool")).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with x as (select test_id, prompt, lower(prompt) as low from test_cases) select test_id, case when length(prompt) >= 10 then case {" ".join(f"when {_any('low', k)} then '{n}'" for n, k in classify.ROUTES.items())} else 'general' end end as route from x""")
def router_first_match(spark, d):
    return table(spark, d, "test_cases", "test_id", "prompt").select("test_id", classify.route(F.col("prompt")).alias("route"))


_EXPERTS = {"timing": ["cycles", "frames", "latency", "scanline"], "layout": ["table", "entries", "bytes"], "build": ["build", "steps", "place"], "fault": ["fault", "stale", "flickers", "wrong"]}


@query(f"""with x as (select test_id, lower(prompt) as low from test_cases), s as ({" union all ".join(f"select test_id, {k} as o, '{n}' as expert, {_hits('low', w)} / {len(w)}.0 as share from x" for k, (n, w) in enumerate(_EXPERTS.items()))})
select test_id, case when share > 0 then expert else 'timing' end as expert, case when share > 0 then share::double else 0.3 end as share from (select *, row_number() over (partition by test_id order by share desc, o) as rn from s) where rn = 1""")
def router_normalised(spark, d):
    return table(spark, d, "test_cases", "test_id", "prompt").select("test_id", classify.expert(F.col("prompt"), _EXPERTS, ("timing", 0.3)).alias("e")).select("test_id", "e.expert", "e.share")


@query(rf"""select test_id, case when regexp_matches(prompt, '(?i)explain\s+(what|how|why)|what\s+(does|is)\s+(the\s+)?(address|memory|register)|describe\s+(the|how)|what\s+(is|are)\s+stored?\s+(in|at)|tell\s+me\s+about') then 'explanation' else 'code_generation' end as category,
case when regexp_matches(prompt, '(?i)\b(optimize|improve|refactor|efficient)\b') then 'optimize' when regexp_matches(prompt, '(?i)\b(debug|fix|fail(ing)?|issue|error|bug)\b') then 'debug' when regexp_matches(prompt, '(?i)\b(hook|asar|patch)\b|\borg\s+\$[0-9A-Fa-f]{{4,6}}\b') then 'hook' else 'write' end as intent from test_cases""")
def intent_category(spark, d):
    p = F.col("prompt")
    return table(spark, d, "test_cases", "test_id", "prompt").select("test_id", classify.eval_category(p).alias("category"), classify.intent(p).alias("intent"))


_COMMITS = rf"""(with d as (select doc_id, unnest(list_filter(string_split(chr(10) || text, chr(10) || 'commit '), lambda x: regexp_matches(x, '^[0-9a-f]{{7,40}}[ \t\r]*(\n|$)'))) as c from documents),
h as (select doc_id, regexp_extract(c, '^([0-9a-f]+)', 1) as hash, list_transform(list_filter(string_split(split_part(c, chr(10) || 'diff --git', 1), chr(10)), lambda x: starts_with(x, '    ')), lambda x: {_strip("substr(x, 5)")}) as said from d)
select doc_id, hash, coalesce(said[1], '') as subject, {_strip("coalesce(array_to_string(said[2:], chr(10)), '')")} as body from h)"""


@query(f"select doc_id, hash, subject, body from {_COMMITS}")
def commits(spark, d):
    """The commits of every log among the documents."""
    return routines.parse_commits(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "hash", "subject", "body")


@query(f"""with s as (select lower(subject) as low from {_COMMITS}) select case {" ".join(f"when {_any('low', k)} then '{n}'" for n, k in classify.COMMITS.items())} else 'other' end as commit_type, count(*) as n from s group by 1""")
def commit_types(spark, d):
    return commits(spark, d).groupBy(classify.commit_type(F.col("subject")).alias("commit_type")).agg(F.count(F.lit(1)).alias("n"))


# --- formats ---------------------------------------------------------------------------------------


@query(f"""select rec_id, '<|im_start|>system' || chr(10) || 'Help.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || instruction || case when coalesce(input, '') <> '' then chr(10) || chr(10) || input else '' end || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
|| case when coalesce(thinking, '') <> '' then '<thinking>' || chr(10) || thinking || chr(10) || '</thinking>' || chr(10) || chr(10) else '' end || coalesce(output, '') || '<|im_end|>' || chr(10) as chat from {_LIBRARY}""")
def chatml_text(spark, d):
    rows = _library(spark, d, "instruction", "input", "output", "thinking")
    return rows.select("rec_id", formats.chat_text(formats.chatml("Help.", F.col("instruction"), F.col("input"), F.col("output"), F.col("thinking"))).alias("chat"))


@query("""select item_id, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || case when coalesce(input, '') <> '' then '### Input:' || chr(10) || input || chr(10) || chr(10) else '' end || '### Response:' || chr(10) as prompt from eval_prompts""")
def response_prompts(spark, d):
    return table(spark, d, "eval_prompts", "item_id", "instruction", "input").select("item_id", formats.response_prompt(F.col("instruction"), F.col("input")).alias("prompt"))


# --- splits and samples ----------------------------------------------------------------------------

_SPLIT = f"""select rec_id, s as source, case when row_number() over (partition by s order by substr(md5('42|' || rec_id::varchar), 1, 15), rec_id) <= least(greatest(round_even(count(*) over (partition by s) * 0.02, 0), 1), count(*) over (partition by s)) then 'eval' else 'train' end as split
from (select rec_id, coalesce({_norm("source")}, 'unknown') as s from {_LIBRARY})"""


@query(_SPLIT)
def stratified_split(spark, d):
    rows = _library(spark, d, "source").select("rec_id", F.coalesce(norm_label(F.col("source")), F.lit("unknown")).alias("source"))
    return mix.stratified_split(rows, "source", "rec_id")


@query(f"""select source, count(*) as total, count(*) filter (split = 'train') as train, count(*) filter (split = 'eval') as eval, grouping(source) = 1 as is_total, count(*) filter (split = 'train') * 100.0::double / (select count(*) from ({_SPLIT}) where split = 'train') as ratio_percent from ({_SPLIT}) group by rollup (source)""")
def mix_ratio(spark, d):
    return mix.mix_report(stratified_split(spark, d), "source")


@query("select split, count(*) as n, min(o_orderkey) as lo, max(o_orderkey) as hi from (select o_orderkey, case when row_number() over (order by o_orderkey) <= floor((select count(*) from orders) * 0.9) then 'train' else 'val' end as split from orders) group by split")
def ordered_split_90_10(spark, d):
    return mix.ordered_split(table(spark, d, "orders", "o_orderkey"), "o_orderkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query(f"select doc_id from documents where {_uniform(42, 'doc_id::varchar')} < 0.1")
def hash_sample(spark, d):
    return mix.hash_sample(table(spark, d, "documents", "doc_id"), "doc_id", 0.1)


@query("select doc_id from documents order by md5('42|' || doc_id::varchar), doc_id limit 50")
def fixed_sample(spark, d):
    return mix.fixed_sample(table(spark, d, "documents", "doc_id"), "doc_id", 50)


@query(f"select result_id from test_results where {_uniform(7, 'result_id::varchar')} < 0.6 * coalesce(score, 0)")
def quality_weighted_select(spark, d):
    return mix.hash_sample(table(spark, d, "test_results", "result_id", "score"), "result_id", F.coalesce("score", F.lit(0.0)) * 0.6, 7).select("result_id")


# --- events ----------------------------------------------------------------------------------------


def _day():
    """What parts a user's events, so that one user with very many is spread over days."""
    return F.date_trunc("day", F.col("ts").cast("timestamp"))


def _events(spark, d):
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")


@query("select event_id, last_value(case when event_type = 'purchase' then event_type || user_id::varchar end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events")
def sticky_forward_fill(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.concat("event_type", F.col("user_id").cast("string")))
    return events.sticky(_events(spark, d), value, ["user_id"], ["ts", "event_id"], "last_purchase", _day()).select("event_id", "last_purchase")


@query("select e.event_id, coalesce(f.t < e.ts, false) as seen_before from events e left join (select user_id, min(ts) as t from events where event_type = 'click' group by 1) f using (user_id)")
def seen_before_join(spark, d):
    return events.seen_before(_events(spark, d), F.col("event_type") == "click", ["user_id"], "ts").select("event_id", "seen_before")


_LAGS = ", ".join(f"lag(event_type, {k}) over w as t{k}, lag(value < 20, {k}) over w as f{k}" for k in range(1, 5))


@query(f"""with x as (select event_id, event_type as t0, coalesce(value < 20, false) as f0, {_LAGS} from events window w as (partition by user_id order by ts, event_id)),
y as (select *, list_distinct(list_filter([case when not f0 then t0 end, case when not f1 then t1 end, case when not f2 then t2 end, case when not f3 then t3 end, case when not f4 then t4 end], lambda v: v is not null)) as good from x)
select event_id, case when t2 is null then null when f0 and f1 and f2 and t0 = t1 and t1 = t2 then 'spinning' when len(good) >= 2 then 'making_progress' end as state from y""")
def spinning_detector(spark, d):
    return events.progress(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", F.coalesce(F.col("value") < 20, F.lit(False)), _day()).select("event_id", "state")


@query("select event_id, string_agg(event_type, ' > ') over (partition by user_id order by ts, event_id rows between 9 preceding and current row) as context from events")
def rolling_context(spark, d):
    return events.rolling_context(_events(spark, d), "event_type", ["user_id"], ["ts", "event_id"], slice_of=_day()).select("event_id", "context")


@query("""with n as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) as n from events),
w as (select *, coalesce(sum(case when value > 0 and n > 1 then ln(1 - 1.0::double / n) else 0.0 end) over (partition by event_type order by n desc rows between unbounded preceding and 1 preceding), 0.0) as l from n)
select event_type, count(*) as calls, count(*) filter (value < 20) as failures, avg(case when value > 0 then value end) as mean_positive, coalesce(sum(case when value > 0 then exp(l) * value / n end), 0.0) as running_avg from w group by event_type""")
def tool_rollup_running_avg(spark, d):
    return events.tool_rollup(_events(spark, d), "event_type", F.col("value") < 20, F.col("value"), F.struct("ts", "event_id"), _day())


@query("select event_type, count(*) as n, count(*) / sum(count(*)) over () as share from events group by event_type")
def event_share_of_total(spark, d):
    return events.share_of_total(_events(spark, d), "event_type")


@query("select model, substr(split_part(error, ':', 1), 1, 30) as error_type, count(*) as n from test_results where coalesce(error, '') <> '' group by all")
def error_type_histogram(spark, d):
    return events.error_types(table(spark, d, "test_results", "model", "error"), "error", "model")


@query(f"""with t as (select {_norm("test_name")} as test_name, model, count(*) as attempts, count(*) filter (passed) as passes from test_results where test_name is not null group by all)
select model, test_name, attempts, passes, rank from (select *, row_number() over (partition by model order by passes::double / attempts desc, attempts desc, test_name) as rank from t) where rank <= 5""")
def top_tests_per_model(spark, d):
    rows = table(spark, d, "test_results", "test_name", "model", "passed").filter("test_name is not null")
    each = rows.groupBy(norm_label(F.col("test_name")).alias("test_name"), "model").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("passed").alias("passes"))
    return events.top_per_group(each, "model", [(F.col("passes") / F.col("attempts")).desc(), F.col("attempts").desc(), F.col("test_name")])


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by user_id")
def latest_state(spark, d):
    return events.latest(_events(spark, d), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "ts")


@query("select user_id, count(*) as gaps, max(g) as longest from (select user_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) as u, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 1e6 as g from events) where u > 15 * 60 * 1000000 group by user_id")
def idle_gaps(spark, d):
    return events.idle_gaps(_events(spark, d), ["user_id"], "ts", slice_of=_day()).groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"), F.max("gap_seconds").alias("longest"))


@query("select time_bucket(interval '5 minutes', ts) as window_start, event_type, count(*) as n from events group by all")
def event_window_counts(spark, d):
    start = F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"].cast("timestamp_ntz")
    return _events(spark, d).groupBy(start.alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id from (select event_id, row_number() over (partition by user_id order by ts, event_id) as k from events) where k % 5 = 0")
def reflect_every_fifth(spark, d):
    return events.every_nth(_events(spark, d), ["user_id"], ["ts", "event_id"], 5, _day()).select("event_id")


@query("select event_id, sum((value >= 20)::int) over w as next_step, max(case when value >= 20 then ts end) over w as last_success from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)")
def success_steps(spark, d):
    return events.steps(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("value") >= 20, slice_of=_day()).select("event_id", "next_step", "last_success")


@query("select event_type, count(*) as n, sum((props::json->>'$.k')::bigint) as k from events group by event_type")
def json_props_projection(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


# --- segmentation and rewriting --------------------------------------------------------------------


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents where text is not null),
s as (select *, sum(starts_with(line, '#')::int) over (partition by doc_id order by k) as section_no from l),
b as (select doc_id, section_no, max(case when starts_with(line, '#') then {_strip("regexp_replace(line, '^#+', '')")} end) as title, {_strip("coalesce(string_agg(line, chr(10) order by k) filter (not starts_with(line, '#')), '')")} as body from s group by all)
select doc_id, section_no, title, substr(body, 1, 2000) as body from b where length(body) >= 120""")
def doc_sections(spark, d):
    return segment.sections(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query("""with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), e as (select doc_id, ls, unnest(ls) as line, generate_subscripts(ls, 1) as k from l)
select doc_id, k - 1 as line_no, line, array_to_string(ls[greatest(k - 2, 1):k - 1], chr(10)) as before, array_to_string(ls[k + 1:k + 2], chr(10)) as after from e where regexp_matches(line, '(JSL|JSR) [A-Z]')""")
def context_lines(spark, d):
    return segment.context(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", "(JSL|JSR) [A-Z]")


@query(rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents where text is not null), s as (select *, {_strip("line")} as s from l),
t as (select *, case when starts_with(s, ';') then 'comment' when regexp_matches(s, '^[A-Za-z_][A-Za-z0-9_]*:$') then 'label' else 'code' end as kind from s),
o as (select *, sum((kind = 'label')::int) over (partition by doc_id order by k) as block_no, k - row_number() over (partition by doc_id, kind order by k) as island from t),
c as (select doc_id, max(k) as last, string_agg({_strip("regexp_replace(s, '^;+', '')")}, ' ' order by k) as comment from o where kind = 'comment' group by doc_id, island),
n as (select *, row_number() over (partition by doc_id, block_no order by k) as place from o where kind = 'code' and s <> ''), b as (select doc_id, block_no, string_agg(line, chr(10) order by k) as code from n where place <= 40 group by all)
select o.doc_id, o.block_no::int as block_no, regexp_replace(s, ':$', '') as label, comment, code from o join c on c.doc_id = o.doc_id and c.last = o.k - 1 join b on b.doc_id = o.doc_id and b.block_no = o.block_no where kind = 'label'""")
def commented_blocks(spark, d):
    return segment.commented_blocks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query("""with t as (select doc_id, text, unnest(range(3)) as attempt from documents where length(text) >= 100), a as (select *, floor(('0x' || substr(md5('42|' || doc_id::varchar || '|' || attempt::varchar), 1, 8))::bigint / 4294967296.0 * (length(text) - 1))::int + 1 as place from t)
select doc_id, attempt::int as attempt, substr(text, greatest(place - 400, 0) + 1, place - greatest(place - 400, 0)) as prefix, substr(text, place + 1, 80) as completion, substr(text, place + 81, 200) as suffix from a""")
def completion_windows(spark, d):
    return segment.completion_windows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(rf"""with t as (select rec_id, regexp_split_to_array(instruction, '\s+') as p, regexp_split_to_array(coalesce(output, ''), '\s+') as c, regexp_split_to_array(coalesce(thinking, ''), '\s+') as x from {_LIBRARY}),
o as (select *, greatest(len(p) + len(c) + len(x) - 60, 0) as over from t), f as (select *, least(over, len(p)) as fp from o), g as (select *, least(over - fp, len(x)) as fx from f)
select rec_id, array_to_string(p[fp + 1:], ' ') as prefix, array_to_string(c[:len(c) - (over - fp - fx)], ' ') as completion, array_to_string(x[:len(x) - fx], ' ') as suffix from g""")
def token_trim(spark, d):
    words = lambda c: F.split(or_empty(F.col(c)), r"\s+", -1)
    cut = segment.trim_tokens(words("instruction"), words("output"), words("thinking"), 60)
    return _library(spark, d, "instruction", "output", "thinking").select("rec_id", *(F.array_join(cut[k], " ").alias(k) for k in ("prefix", "completion", "suffix")))


_STYLES = [("polite", "Please {}"), ("polite", "Kindly {}"), ("terse", "Task: {}"), ("team", "For the team: {}"), ("team", "All of you: {}"), ("team", "Folks, {}")]


@query(f"""with v as ({" union all ".join(f"select item_id, instruction, md5('42|' || item_id::varchar || '|{s}|{t}') as o, '{s}' as style, replace('{t}', '{{}}', instruction) as variant from eval_prompts" for s, t in _STYLES)}),
r as (select *, row_number() over (partition by item_id, style order by o) > 1 as more from v), k as (select *, row_number() over (partition by item_id order by more, o) as k from r)
select item_id, style, variant from k where k <= 4 union all select item_id, 'original', instruction from eval_prompts where instruction is not null""")
def paraphrase_expand(spark, d):
    return segment.paraphrases(table(spark, d, "eval_prompts", "item_id", "instruction"), "item_id", "instruction", _STYLES, 5)


@query(rf"""with l as (select doc_id, {_strip("unnest(string_split(text, chr(10)))")} as line from documents where text is not null) select upper(regexp_extract(line, '\$([0-9A-Fa-f]{{4,6}})', 1)) as address, count(*) as n, count(distinct doc_id) as documents from l where regexp_matches(line, '\$[0-9A-Fa-f]{{4,6}}') group by 1""")
def address_usage(spark, d):
    line = F.explode(lines(F.col("text")))
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", line.alias("line")).filter(F.col("line").rlike(r"\$[0-9A-Fa-f]{4,6}"))
    return rows.groupBy(F.upper(F.regexp_extract("line", r"\$([0-9A-Fa-f]{4,6})", 1)).alias("address")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


# A few hardware registers and their addresses, and a name of lower precedence.
_SYMBOLS = [("2100", "INIDISP", 2, 0), ("2115", "VMAIN", 2, 1), ("2116", "VMADDL", 2, 2), ("4200", "NMITIMEN", 2, 3), ("420B", "MDMAEN", 2, 4), ("420C", "HDMAEN", 2, 5), ("4212", "HVBJOY", 2, 6), ("2100", "screen", 1, 0)]


def _enriched_sql(x: str) -> str:
    for _ in range(2):  # what ends an address is consumed, so neighbours need a second pass
        for address, name, priority, _ in _SYMBOLS:
            x = rf"regexp_replace({x}, '\${address}([^0-9A-Fa-f]|$)', '{name}\1', 'gi')" if priority == 2 else x
    return x


@query(f"select rec_id, {_enriched_sql('output')} as enriched from {_LIBRARY} where {_enriched_sql('output')} <> output")
def symbol_enrich(spark, d):
    """Listings with hardware addresses named; symbols of two sources merged by precedence."""
    symbols = rewrite.merge_symbols(spark.createDataFrame(_SYMBOLS, "address string, name string, priority int, line_no int"))
    return rewrite.enrich(_library(spark, d, "output"), "rec_id", "output", symbols).select("rec_id", "enriched")


@query()
def label_rewrite(spark, d):
    labels = F.regexp_extract_all("text", F.lit(r"JSL ([A-Za-z_][A-Za-z0-9_]*)"), 1)
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", rewrite.replace_labels(F.col("text"), labels).alias("rewritten"))


# --- validators ------------------------------------------------------------------------------------


_IN = ", ".join(f"'{m}'" for m in asm.MNEMONICS)


@query(rf"""with r as (select result_id, any_value(response) as t from test_results group by 1), l as (select result_id, {_strip("split_part(unnest(string_split(t, chr(10))), ';', 1)")} as c from r),
h as (select result_id, upper(regexp_extract({_strip("split_part(c, ':', -1)")}, '^(\S+)', 1)) as w from l where c <> ''),
k as (select result_id, count(*) as found, count(*) filter (w in ({_IN})) as known from h where w in ({_IN}) or regexp_matches(w, '^[A-Z]{{2,4}}') group by 1)
select result_id, true as valid, coalesce(found - known, 0) > 0 as unknown, case when found is null then 0.5 else least(known / found + case when regexp_matches(upper(t), '{"|".join(asm.REGISTERS)}') then 0.1 else 0.0 end, 1.0) end as score from r left join k using (result_id)""")
def asm_verdict(spark, d):
    rows = dedup.first_per_key(table(spark, d, "test_results", "result_id", "response", "loaded_at"), F.col("result_id"), [F.col("loaded_at")])
    rows = rows.select("result_id", "response", asm.instruction_heads(or_empty(F.col("response"))).alias("heads"))
    return rows.select("result_id", validate.listing(F.col("response"), heads=F.col("heads")).alias("v")).select("result_id", "v.valid", F.exists("v.warnings", lambda x: x.startswith("unknown")).alias("unknown"), "v.score")


@query(rf"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents), c as (select *, {_strip("split_part(line, ';', 1)")} as c from l),
h as (select *, regexp_replace(upper(regexp_extract(c, '^(\S+)', 1)), ':+$', '') as h, {_strip(r"regexp_replace(c, '^\S+', '')")} as op, regexp_extract(c, '^([A-Za-z_][A-Za-z0-9_]*)[ \t]*:', 1) as label from c),
g as (select doc_id, count(*) filter (c <> '') as kept, count(*) filter (c = '' and contains(line, ';')) as comments, count(*) filter (h in ({_IN})) as instructions, coalesce(string_agg(op, chr(10) order by k) filter (h in ({_IN})), '') as ops, coalesce(lower(string_agg(c, chr(10) order by k) filter (h in ({_IN}))), '') as named, coalesce(bool_or(h in ('RTS', 'RTL', 'RTI')), false) as returns from h group by 1),
u as (select distinct doc_id, regexp_replace(unnest(regexp_split_to_array(op, '[ \t]+')), '[#$(),\[\]]', '', 'g') as w from h where c <> ''), f as (select distinct doc_id, label as w from h where label <> ''), o as (select doc_id, count(*) as orphans from f anti join u using (doc_id, w) group by 1),
m as (select g.*, coalesce(orphans, 0) as orphans, {" + ".join(f"regexp_matches(ops, '(?m){p}')::int" for p in asm.MODES.values())} as modes, {_hits("named", asm.REGISTERS)} as registers, case when kept + comments > 0 then comments / (kept + comments) else 0.0 end::double as comment_ratio from g left join o using (doc_id)),
t as (select *, least(modes * 0.05::double, 0.3) + least(registers * 0.04::double, 0.2) + case when returns then 0.2 else 0.0 end::double + case when comment_ratio between 0.1 and 0.5 then 0.1 else 0.0 end::double + case when instructions > 0 then 0.2 else 0.0 end::double as s from m)
select doc_id, instructions, modes, registers, returns, orphans, comment_ratio, least(case when orphans > 0 then greatest(s - 0.1::double, 0.0) else s end, 1.0) as score from t""")
def semantic_score(spark, d):
    return validate.semantic_scores(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query()
def bracket_balance(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", validate.bracket_balance(F.col("text")).alias("unbalanced"))


@query(rf"""with r as (select result_id, any_value(response) as t from test_results group by 1), x as (select result_id, t, length({_strip("t")}) as n, len(regexp_extract_all(t, '[A-Za-z]+')) as words,
regexp_matches(t, '\$[0-9A-Fa-f]{{2,6}}')::int + regexp_matches(t, '(?i)\b(LDA|STA|JMP|JSR|RTS|RTL)\b')::int + regexp_matches(t, '(?i)\blink\b')::int + regexp_matches(t, '(?i)\b(rupee|heart|sword|shield|item)\b')::int + regexp_matches(t, '(?i)\b(WRAM|SRAM|ROM|bank)\b')::int as terms from r),
b as (select *, case when n < 20 then 0.1 when n < 50 then 0.4 else 0.7 end::double as base from x), c as (select *, case when words < 5 then least(base, 0.2) when words >= 20 then least(base + 0.2::double, 1.0) else base end as s from b)
select result_id, n >= 20 and words >= 5 as valid, case when terms >= 2 then least(s + 0.1::double, 1.0) else s end as score, words, terms from c""")
def text_reply_verdict(spark, d):
    rows = dedup.first_per_key(table(spark, d, "test_results", "result_id", "response", "loaded_at"), F.col("result_id"), [F.col("loaded_at")])
    return rows.select("result_id", validate.text_reply(F.col("response")).alias("v")).select("result_id", "v.*")


def _tested(spark, d):
    """Each result once, with the keywords of its test case."""
    rows = dedup.first_per_key(table(spark, d, "test_results", "result_id", "test_name", "model", "response", "loaded_at"), F.col("result_id"), [F.col("loaded_at")])
    cases = table(spark, d, "test_cases", "name", "expected_keywords", "anti_keywords", "category").withColumn("_name", norm_label(F.col("name"))).drop("name")
    return rows.withColumn("_name", norm_label(F.col("test_name"))).join(cases, "_name")


_TESTED = f"(select r.*, c.expected_keywords, c.anti_keywords, c.category from (select result_id, min(test_name) as test_name, min(model) as model, min(response) as response from test_results group by 1) r join test_cases c on {_norm('r.test_name')} = {_norm('c.name')})"
_COVER = "case when coalesce(len(expected_keywords), 0) = 0 then 1.0 else len(list_filter(expected_keywords, lambda k: contains(lower(coalesce(response, '')), lower(k)))) / len(expected_keywords) end"
_ANTI = "coalesce(len(list_filter(anti_keywords, lambda k: contains(lower(coalesce(response, '')), lower(k)))), 0) > 0"


@query(f"with x as (select result_id, {_COVER} as cover, {_ANTI} as anti_found from {_TESTED}) select result_id, case when anti_found then cover * 0.5 else cover end as score, case when anti_found then false else cover >= 0.6 end as passed, anti_found from x")
def keyword_coverage(spark, d):
    return _tested(spark, d).select("result_id", validate.expert_test(F.col("response"), F.col("expected_keywords"), F.col("anti_keywords")).alias("v")).select("result_id", "v.*")


_RESULTS = "(select * from (select *, row_number() over (partition by result_id order by loaded_at) as rn from test_results) where rn = 1)"


def _results(spark, d, *columns):
    """Each result once, as it was first delivered."""
    return dedup.first_per_key(table(spark, d, "test_results", "result_id", "loaded_at", *columns), F.col("result_id"), [F.col("loaded_at")])


@query(f"select model, count(*) as total, count(*) filter (passed) as passed, avg(score) as avg_score, avg(case when latency_ms > 0 then latency_ms end) as avg_latency, count(*) filter (latency_ms > 1000) as slow from {_RESULTS} group by model")
def expert_test_rollup(spark, d):
    rows = _results(spark, d, "model", "passed", "score", "latency_ms")
    report = profile.eval_report(rows, F.col("score"), F.col("passed"), F.lit(False), F.col("latency_ms"), ["model"]).drop("pass_rate")
    return report.join(rows.groupBy("model").agg(F.count_if(F.col("latency_ms") > 1000).alias("slow")), "model")


@query(f"""with x as (select result_id, {_COVER} as cover, {_ANTI} as anti_found, coalesce(nullif({_norm('category')}, ''), 'uncategorized') as category from {_TESTED}), y as (select category, case when anti_found then cover * 0.5 else cover end as score, not anti_found and cover >= 0.6 as passed from x)
select category, count(*) as total, count(*) filter (passed) as passed, count(*) filter (passed) / count(*) as pass_rate, avg(score) as avg_score from y group by 1""")
def eval_by_category(spark, d):
    judged = _tested(spark, d).select(F.coalesce(F.nullif(norm_label(F.col("category")), F.lit("")), F.lit("uncategorized")).alias("category"), validate.expert_test(F.col("response"), F.col("expected_keywords"), F.col("anti_keywords")).alias("v"))
    return profile.eval_report(judged, F.col("v.score"), F.col("v.passed"), F.lit(False), F.lit(1.0), ["category"]).drop("avg_latency")


_TOKENS = "len(regexp_extract_all(coalesce(response, ''), '[A-Za-z0-9]+')) * 1000.0::double / nullif(latency_ms, 0)"


@query(f"""select model, count(*) as total, count(*) filter (passed) as passed, count(*) filter (passed) / count(*) as pass_rate, avg(case when starts_with(coalesce(error, ''), 'timeout') then 0.0 else score end) as avg_score, avg(case when latency_ms > 0 then latency_ms end) as avg_latency,
avg(case when {_TOKENS} > 0 then {_TOKENS} end) as avg_tokens_per_second from {_RESULTS} group by model""")
def eval_report(spark, d):
    rows = _results(spark, d, "model", "score", "passed", "error", "latency_ms", "response")
    rate = F.regexp_count(or_empty(F.col("response")), F.lit("[A-Za-z0-9]+")) * 1000.0 / F.nullif("latency_ms", F.lit(0.0))
    return profile.eval_report(rows, F.col("score"), F.col("passed"), F.coalesce(F.col("error").startswith("timeout"), F.lit(False)), F.col("latency_ms"), ["model"], rate)


@query("select keyword, count(*) as n from (select result_id, unnest(missing_keywords) as keyword from (select result_id, any_value(missing_keywords) as missing_keywords from test_results group by 1)) group by keyword order by n desc, keyword limit 5")
def missing_concepts_top5(spark, d):
    rows = dedup.first_per_key(table(spark, d, "test_results", "result_id", "missing_keywords", "loaded_at"), F.col("result_id"), [F.col("loaded_at")])
    return profile.top_values(rows.select(F.explode("missing_keywords").alias("k")), F.col("k"), "keyword")


# --- graph, catalog, integrity ---------------------------------------------------------------------


@query(f"""with e as (select rec_id, list_distinct(list_transform(coalesce(kg_entities, []), lambda x: lower(x))) as es, coalesce(kg_validated, false) as v from {_LIBRARY}), n as (select distinct lower(unnest(kg_entities)) as k from pattern_library where kg_validated),
f as (select rec_id, count(*) as found from (select rec_id, unnest(es) as k from e) join n using (k) group by 1), c as (select rec_id, v, len(es) as mentioned, coalesce(found, 0) as found from e left join f using (rec_id))
select rec_id, mentioned, found, mentioned - found as missing, coverage, mentioned > 0 and coverage < 0.3 as low, case when mentioned > found then greatest(lifted - (mentioned - found) * 0.05::double, 0.3) else lifted end as score
from (select *, least(least(coverage + 0.3::double, 1.0) + case when v and mentioned > 0 then 0.1::double else 0.0 end, 1.0) as lifted from (select *, case when mentioned = 0 then 1.0 else found / mentioned end::double as coverage from c))""")
def kg_coverage(spark, d):
    rows = _library(spark, d, "kg_entities", "kg_validated")
    nodes = table(spark, d, "pattern_library", "kg_entities", "kg_validated").filter("kg_validated").select(F.explode("kg_entities").alias("name")).distinct()
    return graph.coverage(rows, "rec_id", "kg_entities", nodes.select(F.col("name").alias("id"), "name"), "kg_validated")


@query("""with m as (select distinct model, 'model ' || model as v from test_results where model is not null), e as (select distinct expert, 'expert ' || expert as v from test_cases where expert is not null)
select run_id, coalesce(m.v, e.v, harness_version) as harness_version from eval_runs left join m on m.model = eval_runs.model left join e on e.expert = eval_runs.expert""")
def override_priority_join(spark, d):
    by_model = table(spark, d, "test_results", "model").filter("model is not null").distinct().select(F.col("model").alias("override_key"), F.concat(F.lit("model "), F.col("model")).alias("harness_version"))
    by_expert = table(spark, d, "test_cases", "expert").filter("expert is not null").distinct().select(F.col("expert").alias("override_key"), F.concat(F.lit("expert "), F.col("expert")).alias("harness_version"))
    runs = table(spark, d, "eval_runs", "run_id", "model", "expert", "harness_version")
    return graph.override(runs, by_model.unionByName(by_expert), ["model", "expert"], "run_id", ["harness_version"]).select("run_id", "harness_version")


@query("""select doc_id, regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(sha1(path), 1, 8) as paper_id from documents where path is not null""")
def paper_ids(spark, d):
    return table(spark, d, "documents", "doc_id", "path").filter("path is not null").select("doc_id", F.concat(slug(F.col("path")), F.lit("-"), F.substring(F.sha1("path"), 1, 8)).alias("paper_id"))


@query("""with a as (select run_id, count(distinct result_id)::int as size, min(model) as h from test_results where run_id is not null group by 1)
select coalesce(e.run_id, a.run_id) as run_id, case when a.run_id is null then 'missing' when e.run_id is null then 'extra' when e.n_tests is distinct from a.size then 'size_mismatch' when e.model is distinct from a.h then 'corrupted' else 'verified' end as status from eval_runs e full outer join a on e.run_id = a.run_id""")
def manifest_diff(spark, d):
    """Registered runs against what was delivered of them."""
    expected = table(spark, d, "eval_runs", "run_id", "n_tests", "model").select("run_id", F.col("n_tests").alias("size"), F.col("model").alias("h"))
    results = table(spark, d, "test_results", "run_id", "result_id", "model").filter("run_id is not null")
    actual = results.groupBy("run_id").agg(F.count_distinct("result_id").cast("int").alias("size"), F.min("model").alias("h"))
    return graph.manifest_diff(expected, actual, "run_id", "size", "h")


@query("""select project, count(*) as files, sum(n_chars) as bytes, max(updated_at) as latest, list_sort(list_distinct(list(split_part(path, '/', -1)) filter (split_part(path, '/', -1) in ('hud_util.asm', 'room_core.asm')))) as found from documents where project is not null group by project having count(*) filter (split_part(path, '/', -1) in ('hud_util.asm', 'room_core.asm')) > 0""")
def registry_rollup(spark, d):
    docs = table(spark, d, "documents", "project", "path", "n_chars", "updated_at").filter("project is not null").withColumn("name", F.substring_index("path", "/", -1))
    return graph.registry(docs, "project", "name", "n_chars", "updated_at", ["hud_util.asm", "room_core.asm"])


@query("select label, count(*) as n, min(len(embedding)) as dims from embeddings group by label")
def embedding_inventory(spark, d):
    return table(spark, d, "embeddings", "label", "embedding").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("dims"))


@query("select p_brand, count(*) as n, grouping(p_brand) = 1 as is_total from part group by rollup (p_brand)")
def suite_rollup(spark, d):
    return profile.totals_by(table(spark, d, "part", "p_brand"), "p_brand")


# --- routines, summaries, lookups ------------------------------------------------------------------


def _techniques_sql(t: str) -> str:
    tests = []
    for name, signs in routines.TECHNIQUES:
        if isinstance(signs, str):
            tests.append((name, f"regexp_matches({t}, '{signs}')"))
        else:
            glue = " and " if isinstance(signs, tuple) else " or "
            tests.append((name, "(" + glue.join(f"contains({t}, '{s}')" for s in signs) + ")"))
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in tests) + "], lambda v: v is not null), '; ')"


@query(f"select rec_id, {_techniques_sql('upper(coalesce(output, ' + chr(39) * 2 + '))')} as techniques from {_LIBRARY}")
def technique_tags(spark, d):
    return _library(spark, d, "output").select("rec_id", F.array_join(routines.techniques(F.col("output")), "; ").alias("techniques"))


_TECHNIQUES = _techniques_sql("upper(coalesce(output, ''))").replace("array_to_string(", "", 1).removesuffix(", '; ')")


@query(rf"""with r as (select rec_id, output, {_norm("category")} as category, 'Routine' || rec_id::varchar as name, {_TECHNIQUES} as t from {_LIBRARY} where output is not null), l as (select rec_id, unnest(string_split(output, chr(10))) as line from r), s as (select rec_id, {_strip("line")} as s, {_strip(r"regexp_replace(line, '#_[0-9A-Fa-f]+:\s*', '', 'g')")} as x from l),
k as (select rec_id, count(*) filter (s <> '') as n, coalesce(bool_and(regexp_matches(lower(x), '{routines.DATA_LINE}')) filter (x <> '' and not starts_with(x, ';') and not ends_with(x, ':') and not starts_with(x, '===')), true) as data from s group by 1),
q as (select r.*, least(least(len(t) * 0.15::double, 0.6) + case when n between 8 and 50 then 0.3 when n between 5 and 7 then 0.15 when n > 50 then 0.2 else 0.0 end::double + case when category in ('sprite_behavior', 'player_action', 'damage_system', 'spawn_entity') then 0.2 else 0.0 end::double, 1.0) as q from r join k using (rec_id) where not data)
select rec_id, 'explain' as kind, 'Explain the routine ' || name || '.' as instruction, output from q union all select rec_id, 'generate', 'Write a 65816 routine named ' || name || '.', output from q where ('0x' || substr(md5('42|' || rec_id::varchar || '|generate'), 1, 8))::bigint / 4294967296.0 < q * 0.6
union all select rec_id, 'technique', 'Which techniques does ' || name || ' show?', array_to_string(t, '; ') from q where len(t) > 0 and ('0x' || substr(md5('42|' || rec_id::varchar || '|technique'), 1, 8))::bigint / 4294967296.0 < q""")
def routine_samples(spark, d):
    rows = _library(spark, d, "output", "category").withColumn("name", F.concat(F.lit("Routine"), F.col("rec_id").cast("string"))).filter("output is not null")
    return routines.routine_samples(rows, "rec_id", "name", "output", norm_label(F.col("category")))


@query(rf"""with d as (select item_id, regexp_replace({_clean_sql("coalesce(expected_output, '')")}, '[.]+$', '') as t from eval_prompts) select item_id, case when length(t) >= 8 and regexp_matches(t, '[A-Za-z]') then 'Write a 65816 routine that ' || t || '.' else '' end as instruction from d""")
def inverted_instructions(spark, d):
    return table(spark, d, "eval_prompts", "item_id", "expected_output").select("item_id", routines.description_to_instruction(F.col("expected_output")).alias("instruction"))


@query(r"""select test_id, coalesce(nullif(regexp_extract(prompt, '(\$[0-9A-Fa-f]{2}:[0-9A-Fa-f]{4})', 1), ''), nullif(regexp_extract(prompt, '(\$[0-9A-Fa-f]{6})', 1), ''), nullif(regexp_extract(prompt, '(\$[0-9A-Fa-f]{5})', 1), ''), nullif(regexp_extract(prompt, '(\$[0-9A-Fa-f]{4})', 1), '')) as address from test_cases""")
def prompt_addresses(spark, d):
    return table(spark, d, "test_cases", "test_id", "prompt").select("test_id", routines.extract_address(F.col("prompt")).alias("address"))


@query(f"""with s as (select lower(subject) as low from {_COMMITS})
select case when {_any("low", ["fix", "bug", "crash", "issue", "regress"])} then 'farore' else 'oos_specialist' end as expert, case {" ".join(f"when {_any('low', w)} then '{n}'" for n, w in routines.SYSTEMS.items())} else 'Core' end as system, count(*) as n from s group by all""")
def commit_profiles(spark, d):
    return commits(spark, d).select(routines.commit_profile(F.col("subject")).alias("c")).groupBy("c.expert", "c.system").agg(F.count(F.lit(1)).alias("n"))


_FAMILY = f"case {' '.join(f'when ' + _any('lower(error)', k) + f' then {chr(39)}{n}{chr(39)}' for n, k in classify.ERROR_FAMILIES.items())} else 'other' end"


def _texts(keys: str, value: str, source: str) -> str:
    """A histogram as text by ``keys`` in SQL."""
    return f"(select {keys}, string_agg(v || ':' || n, ';' order by v) as h from (select {keys}, {value} as v, count(*) as n from {source} where {value} is not null group by all) group by all)"


@query(f"""with r as (select *, score >= 0.4 as tried from {_RESULTS}), f as {_texts("model", "case when coalesce(tried, false) and not coalesce(passed, false) then " + _FAMILY + " end", "r")}
select model, count(*) as total, count(*) filter (tried) as attempted, count(*) filter (tried and passed) as passed, count(*) filter (tried) - count(*) filter (tried and passed) as failed, count(*) - count(*) filter (tried) as skipped, count(*) filter (tried and passed) / nullif(count(*) filter (tried), 0) as pass_rate,
avg(case when tried then score end) as mean_score, avg(case when tried and passed then score end) as mean_score_valid, any_value(h) as failure_families from r left join f using (model) group by model""")
def validation_summary(spark, d):
    """Results of a score of 0.4 or more count as attempted."""
    rows = _results(spark, d, "model", "passed", "score", "error")
    return profile.validation_summary(rows, F.col("score") >= 0.4, F.col("passed"), F.col("score"), classify.error_family(F.col("error")), ["model"])


_EXPERT_ROLLUP = f"""with r as (select * from {_RESULTS}), f as {_texts("expert", "substr(error, 1, 50)", "r")}, g as (select expert, count(*) as calls, count(*) filter (passed) as completed, count(*) filter (score < 0.5) as low_confidence, avg(score) as mean_confidence from r group by 1)
select g.*, calls / sum(calls) over () as share, h as reasons from g left join f on f.expert = g.expert"""


@query(_EXPERT_ROLLUP)
def expert_rollup(spark, d):
    return profile.expert_rollup(_results(spark, d, "expert", "score", "passed", "error"), "expert", F.col("error"), F.col("score"), F.col("passed"))


@query(f"select expert, calls, share, mean_confidence, completed / calls as success_rate from ({_EXPERT_ROLLUP})")
def expert_analysis(spark, d):
    return profile.expert_analysis(expert_rollup(spark, d), "expert")


@query("select r.result_id, coalesce(e.harness_version, 'unknown') as harness_version from (select distinct result_id, run_id from test_results) r left join eval_runs e using (run_id)")
def lookup_with_default(spark, d):
    rows = table(spark, d, "test_results", "result_id", "run_id").distinct()
    return graph.with_default(rows, table(spark, d, "eval_runs", "run_id", "harness_version"), "run_id", "harness_version", "unknown").select("result_id", "harness_version")


@query("""with e as (select l_orderkey, l_linenumber, l_quantity from lineitem), t as (select l_orderkey, sum(l_quantity) as quantity, count(*) as n from e group by 1) select o_orderpriority, count(*) as orders, sum(n) as n, sum(quantity) as quantity from orders join t on o_orderkey = l_orderkey group by 1""")
def order_enrichment(spark, d):
    """A large equi join after pre-aggregating its larger side."""
    t = table(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return o.join(t, o.o_orderkey == t.l_orderkey).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))
