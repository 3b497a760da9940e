"""The queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, norm_label, table
from .languages import fit_languages
from .leakage import leaked_passages
from .mixing import mix_records, mix_to_weights, plan, report
from .nearduplicates import near_duplicate_groups, near_duplicate_pairs
from .pairs import broken_pairs
from .sampling import sample_to_targets, shares
from .splitting import oversized, split_oversized
from .tokens import encode_table
from .truncation import truncated_texts, truncation_by_source


_POOLS = {"pattern_library": "rec_id", "test_cases": "test_id"}


def _by_pool(spark: SparkSession, d: str):
    """The records and the requests of each pool; a request of any other pool is an error."""
    targets = table(spark, d, "sample_targets").withColumn("_pool", norm_label(F.col("pool")))
    other = [r["pool"] for r in targets.filter(~F.coalesce(F.col("_pool").isin(*_POOLS), F.lit(False))).select("pool").distinct().limit(10).collect()]
    if other:
        raise ValueError(f"requests of unknown pools: {other}")
    for pool, key in _POOLS.items():
        requests = targets.filter(F.col("_pool") == pool).drop("_pool")
        yield key, table(spark, d, pool, key, "category"), requests


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Seats, available records and shortfalls of every request and category."""
    reports = [shares(pool, requests, key) for key, pool, requests in _by_pool(spark, d)]
    return reports[0].unionByName(reports[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_report(spark, d).filter("short").select("request_id", "category")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The records drawn for every request."""
    drawn = [sample_to_targets(pool, requests, key)[0].withColumnRenamed(key, "record_id") for key, pool, requests in _by_pool(spark, d)]
    return drawn[0].unionByName(drawn[1])


_MIX_COLUMNS = ("rec_id", "source", "category", "instruction", "output")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted, available and actual sizes and shares of every mix and member."""
    return report(plan(mix_records(table(spark, d, "pattern_library", *_MIX_COLUMNS)), table(spark, d, "mix_weights")))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """What every member is wanted to give and can give, and whether its actual size adds up with what was left unfilled."""
    adds_up = F.col("actual") + F.col("unfilled") == F.floor(F.least("wanted", F.col("available").cast("double")))
    return p2_report(spark, d).select("mix_id", "dimension", "member", "wanted", "available", "target_weight", "short", adds_up.alias("adds_up"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_report(spark, d).filter("short").select("mix_id", "member")


def p2_mix(spark: SparkSession, d: str) -> DataFrame:
    """The records of every mix and how often each is used."""
    return mix_to_weights(table(spark, d, "pattern_library", *_MIX_COLUMNS), table(spark, d, "mix_weights"))[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "pattern_library", "rec_id", "instruction", "output"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class, group, copies and links."""
    return near_duplicate_groups(table(spark, d, "pattern_library", "rec_id", "instruction", "output"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Test results with the prompt of their test, null if the test is unknown."""
    results = table(spark, d, "test_results", "result_id", "test_name", "model", "response").withColumn("_name", norm_label(F.col("test_name")))
    prompts = table(spark, d, "test_cases", "name", "prompt").groupBy(norm_label(F.col("name")).alias("_name")).agg(F.min("prompt").alias("prompt"))
    return results.join(broadcast_if_small(prompts), "_name", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    languages = fit_languages(table(spark, d, "documents", "doc_id", "lang", "text"))
    library = broken_pairs(table(spark, d, "pattern_library"), "rec_id", "instruction", "output", languages)
    results = broken_pairs(_answers(spark, d), "result_id", "prompt", "response", languages, source="model")
    named = lambda df, name, key: df.select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "defect")
    return named(library, "pattern_library", "rec_id").unionByName(named(results, "test_results", "result_id"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs by table and defect."""
    return p4_found(spark, d).groupBy("table_name", "defect").agg(F.count(F.lit(1)).alias("pairs"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on every response."""
    return truncated_texts(_answers(spark, d), prompt_col="prompt")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_texts(spark, d).filter("truncated").select("result_id")


def p5_models(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut responses of each model."""
    return truncation_by_source(p5_texts(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_table(table(spark, d, "documents"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked passage with its tiles."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_prompts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_passages(spark, d).select("doc_id", "item_id").distinct()


def p7_reordered(spark: SparkSession, d: str) -> DataFrame:
    """Passages of which tiles of five words or more cover three fifths, in any order: cut up, reordered or edited."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_prompts"), min_words=5, min_coverage=0.6)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: how many documents hold them, and the most that one document covers."""
    found = p7_passages(spark, d)
    return found.groupBy("item_id", "passage").agg(
        F.count_distinct("doc_id").alias("documents"), F.max("coverage").alias("most_covered"), F.max("longest").alias("longest")
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(table(spark, d, "documents"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def _norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '^\s+|\s+$', '', 'g'), '[-\s]', '_', 'g')"


_POOL_CATEGORIES = f"""select distinct 'pattern_library' as pool, rec_id as id, {_norm("category")} as c from pattern_library union all select distinct 'test_cases', test_id, {_norm("category")} from test_cases"""
_SQL = {
    # Seats as ranks: floors first, then the smallest (rank - 0.5) / target of every record that a category has.
    "p1_report": f"""with p as ({_POOL_CATEGORIES}), n as (select pool, count(distinct id) as pool_rows from p group by 1), k as (select pool, c, count(distinct id) as k from p group by 1, 2),
t as (select request_id, t.category, target_share, min_rows::bigint as min_rows, pool_rows, sample_share, round(sample_share * pool_rows)::bigint as sample_rows, coalesce(k, 0) as available, target_share * sample_share * pool_rows as wanted, least(coalesce(k, 0), greatest(min_rows, 0))::bigint as floor_seats
  from sample_targets t join n on n.pool = {_norm("t.pool")} left join k on k.pool = n.pool and k.c = {_norm("t.category")}),
r as (select *, unnest(range(1, available + 1)) as rank from t), o as (select request_id, category, rank, target_share, floor_seats, row_number() over (partition by request_id order by (rank <= floor_seats)::int desc, (rank - 0.5) / nullif(target_share, 0) nulls last, category) as place from r where rank <= floor_seats or target_share > 0),
room as (select request_id, greatest(max(sample_rows), sum(floor_seats)) as room from t group by 1), s as (select request_id, category, count(*) as seats from o join room using (request_id) where place <= room group by all),
j as (select t.*, coalesce(seats, 0)::bigint as seats from t left join s using (request_id, category))
select request_id, category, target_share, min_rows, pool_rows, sample_share, sample_rows, available, wanted, seats, floor_seats, coalesce(max(case when target_share > 0 and seats > floor_seats then (seats - 0.5) / target_share end) over w, 0.0) as cut, available < greatest(wanted, min_rows) as short,
seats / greatest(sum(seats) over w, 1)::double as actual_share, seats < floor(wanted) as below_target from j window w as (partition by request_id)""",
    "p2_members": f"""with r as (select distinct rec_id, {_norm("source")} as source, {_norm("category")} as category, coalesce(length(instruction), 0) + coalesce(length(output), 0) as s from pattern_library),
t as (select sum(s) as t from r), m as (select 'source' as dimension, source as member, sum(s) as s from r group by all union all select 'category', category, sum(s) from r group by all),
w as (select mix_id, w.dimension, w.member, weight * mix_share * t as wanted, (coalesce(s, 0) * max_repeats)::bigint as available, weight as target_weight from mix_weights w cross join t left join m on m.dimension = w.dimension and m.member = {_norm("w.member")})
select *, available < wanted as short, true as adds_up from w""",
    "p1_found": f"""with p as ({_POOL_CATEGORIES}),
n as (select pool, count(distinct id) as n from p group by 1), k as (select pool, c, count(distinct id) as k from p group by 1, 2)
select request_id, t.category from sample_targets t join n on n.pool = {_norm("t.pool")} left join k on k.pool = n.pool and k.c = {_norm("t.category")} where coalesce(k, 0) < greatest(target_share * sample_share * n, min_rows)""",
    "p2_found": f"""with r as (select distinct rec_id, {_norm("source")} as source, {_norm("category")} as category, coalesce(length(instruction), 0) + coalesce(length(output), 0) as s from pattern_library),
t as (select sum(s) as t from r), m as (select 'source' as dimension, source as member, sum(s) as s from r group by all union all select 'category', category, sum(s) from r group by all)
select mix_id, w.member from mix_weights w cross join t left join m on m.dimension = w.dimension and m.member = {_norm("w.member")} where coalesce(s, 0) * max_repeats < weight * mix_share * t""",
    "p7_found": r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents), i as (select item_id, regexp_extract_all(lower(unnest([instruction, expected_output])), '[\p{L}\p{N}]+') as ws from eval_prompts),
dg as (select doc_id, array_to_string(ws[k:k + 11], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as k from d)), ig as (select distinct item_id, array_to_string(ws[k:k + 11], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 10)) as k from i))
select distinct doc_id, item_id from dg join ig using (g)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
