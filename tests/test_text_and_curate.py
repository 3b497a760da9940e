import pytest
from pyspark.sql import functions as F

from sparkloom.functions import asm
from sparkloom.functions.text import argmax, lines, seeded_uniform, slug, strip
from sparkloom.operators import classify, curate, dedup, formats, graph, mix, profile, rewrite, routines, segment, validate
from sparkloom.runtime import exact_rank, norm_label


def one(spark, column, **values):
    """The value of an expression over one row of literals."""
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1)])
    return df.select(column.alias("v")).first()["v"]


def test_strip_and_lines(spark):
    assert one(spark, strip(F.col("t")), t=" \t a b \n") == "a b"
    assert one(spark, F.size(lines(F.col("t"))), t="a\r\nb\n") == 3
    assert one(spark, strip(F.lit(None).cast("string"))) is None
    assert one(spark, slug(F.col("t")), t="--A Big/Paper--") == "a-big-paper"
    assert one(spark, norm_label(F.col("t")), t="  Loop-Copy x\t") == "loop_copy_x"


def test_argmax_takes_the_first_of_equal_scores(spark):
    assert one(spark, argmax([("a", F.lit(1.0)), ("b", F.lit(2.0)), ("c", F.lit(2.0))]))["label"] == "b"


@pytest.mark.parametrize(
    "text,want",
    [("Do it ; *$8000-$8010 LONG", "Do it"), ("Fix ==== this;", "Fix this"), ("Move org $EE1ED now", "Move now"), ("Keep ; TODO", "Keep"), ("Plain text", "Plain text"), ("Go on ; $1234", "Go on")],
)
def test_clean_instruction(spark, text, want):
    assert one(spark, curate.clean_instruction(F.col("t")), t=text) == want


def test_clean_instruction_for_augmentation(spark):
    assert one(spark, curate.clean_instruction(F.col("t"), "augment"), t="Write org $8000 TODO: later\nmore") == "Write org $8000"


def test_output_kind_and_label(spark):
    assert one(spark, asm.output_kind(F.col("t")), t="Foo:\n  db 1\n LDA $10") == "code"
    assert one(spark, asm.output_kind(F.col("t")), t="; x\nTable: dw $10") == "data"
    assert one(spark, asm.output_kind(F.col("t")), t="prose") == "unknown"
    assert one(spark, asm.first_label(F.col("t")), t="; c\n#_0: x\nFoo: {\nBar:") == "Foo"
    assert one(spark, asm.first_label(F.col("t")), t="none here") is None


def test_addressing_modes(spark):
    for op, want in {"": None, "A": "accumulator", "#$12": "immediate_8", "#$1234": "immediate_16", "#Foo": "immediate_symbol", "$12,S": "stack_relative", "($12),Y": "indirect_indexed_y", "($12,X)": "indexed_indirect_x", "($12)": "indirect", "[$12]": None, "$1234,X": "indexed_x", "$123456": "long", "$1234": "absolute", "$12": "direct_page", "Foo": "label"}.items():
        assert one(spark, asm.addressing_mode(F.col("t")), t=op) == want


def test_normalize_records(spark):
    rows = [
        (1, "Do it", "LDA $10", None, ""), (2, "x", "  ", "d", "s"), (3, "====", "no label", "d", "s"), (4, "====", "Foo:\n RTS", "d", "s"), (5, "Please todo this", "LDA", "d", "s"),
        (6, "Write a 65816 routine that $1234 org $8000", "Tab:\n dw 1", None, None), (7, "Write a 65816 routine that adds one .", "RTS", None, None), (8, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, instruction string, output string, domain string, source string")
    got = {r["id"]: r for r in curate.normalize_records(df).collect()}
    assert [got[k]["reject_reason"] for k in (1, 2, 3, 4, 5, 8)] == [None, "drop_missing_output", "drop_empty_instruction", None, "drop_todo_instruction", "drop_missing_output"]
    assert got[4]["instruction"] == "Write a 65816 routine named Foo." and got[4]["generated_kind"] == "code"
    assert got[6]["instruction"] == "Define the ASM data table Tab."
    assert got[7]["instruction"] == "Write a 65816 routine that adds one." and got[7]["domain"] == "asm-generate"
    assert got[1]["source"] == "unknown" and got[1]["domain"] == "asm"
    stats = {r["reason"]: r["n"] for r in curate.reject_stats(curate.normalize_records(df)).collect()}
    assert stats["kept"] == 4


def test_gold_dedup(spark):
    rows = [(1, "a", None, "x"), (2, " a ", "", "x\n"), (3, "a", "i", "x"), (4, "a", None, " x"), (5, "", None, "x"), (6, "b", None, None)]
    df = spark.createDataFrame(rows, "id int, instruction string, input string, output string")
    assert [r["status"] for r in dedup.gold(df, [F.col("id")]).orderBy("id").collect()] == ["kept", "duplicate", "kept", "duplicate", "missing", "missing"]
    first = dedup.first_per_key(df, dedup.record_key("instruction", "input", "output"), [F.col("id")])
    assert sorted(r["id"] for r in first.collect()) == [1, 3, 5, 6]
    assert dedup.first_per_key(df.limit(0), F.col("id"), [F.col("id")]).count() == 0


def test_combine_by_priority(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x")], "id int, k string")
    b = spark.createDataFrame([(3, "x"), (5, "y"), (4, "y")], "id int, k string")
    assert sorted(r["id"] for r in dedup.combine_by_priority(a, b, "k", [F.col("id")]).collect()) == [1, 2, 4]
    assert one(spark, dedup.distinct_ignoring_case(F.array(*map(F.lit, ["A", "b", "a", "B", "c"])))) == ["A", "b", "c"]


def test_published_mix_sizes(spark):
    sizes = {"a": 28707, "b": 11044, "c": 19303, "d": 3894, "e": 211, "f": 53}
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()], "k string, n bigint")
    got = {r["k"]: r["h"] for r in df.select("k", mix.held_out(F.col("n"), 0.02, 1).alias("h")).collect()}
    assert got == {"a": 574, "b": 221, "c": 386, "d": 78, "e": 4, "f": 1}
    assert [one(spark, mix.held_out(F.lit(n), 0.5, m)) for n, m in ((0, 5), (1, 5), (5, 1), (7, 1))] == [0, 1, 2, 4]


def test_split_and_rank(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").alias("s"))
    split = mix.stratified_split(df, "s", "id", 0.1).groupBy("s", "split").count().collect()
    assert {(r["s"], r["split"]): r["count"] for r in split} == {("hot", "eval"): 200, ("hot", "train"): 1800, (None, "eval"): 100, (None, "train"): 900}
    ranked = exact_rank(df.withColumn("h", F.xxhash64("id")), ["s"], "h", "id", "r").collect()
    for s in ("hot", None):
        mine = sorted((r["h"], r["r"]) for r in ranked if r["s"] == s)
        assert [r for _, r in mine] == list(range(1, len(mine) + 1))
    parts = mix.ordered_split(df, "id", 0.9).groupBy("split").agg(F.min("id").alias("lo"), F.count("*").alias("n")).collect()
    assert {r["split"]: (r["lo"], r["n"]) for r in parts} == {"train": (0, 2700), "val": (2700, 300)}
    assert 0 <= one(spark, seeded_uniform(1, F.lit("x"))) < 1
    assert mix.fixed_sample(df, "id", 7).count() == 7 and mix.fixed_sample(df.limit(0), "id", 7).count() == 0


def test_classifiers(spark):
    d = one(spark, classify.domain(F.lit("nothing here")))
    assert (d["domain"], d["confidence"]) == ("farore_debug", 0.0)
    d = one(spark, classify.domain(F.lit("Optimize this: save cycles, faster performance")))
    assert d["domain"] == "din_optimize" and d["confidence"] == 1.0
    assert one(spark, classify.pools(F.lit("fix the zelda bug"))) == ["oos", "debug"]
    assert one(spark, classify.pools(F.lit("lovely day"))) == []
    assert one(spark, classify.route(F.lit("please organize it"))) == "asm"
    assert one(spark, classify.route(F.lit("short"))) is None
    assert one(spark, classify.intent(F.lit("Organize the code"))) == "write"
    assert one(spark, classify.intent(F.lit("Use org $EE1ED here"))) == "hook"
    assert one(spark, classify.commit_type(F.lit("Add menu"))) == "feature"
    assert one(spark, classify.error_family(F.lit("Unknown command"))) == "instruction"
    assert one(spark, classify.file_kind(F.lit("/a/B.ASM"))) == "asm"
    rules = [(["asm"], "m1"), (["C++"], "m2")]
    assert one(spark, classify.chat_models(F.lit("ASM c++"), rules, F.lit("keyword"), None)) == ["m1"]
    assert one(spark, classify.chat_models(F.lit("c++"), rules, F.lit("keyword"), "m9")) == ["m9"]
    assert one(spark, classify.chat_models(F.lit("x"), rules, F.lit("ensemble"), None)) == ["m1", "m2"]


def test_validators(spark):
    v = one(spark, validate.listing(F.lit("a:b: LDA $10\nFOO $11\n; c\nSTA INIDISP")))
    assert abs(v["score"] - (2 / 3 + 0.1)) < 1e-9 and v["valid"] and v["warnings"] == ["unknown instruction FOO"]
    assert one(spark, validate.listing(F.lit("a:b: LDA $10\nFOO $11"), strict=True))["valid"] is False
    assert one(spark, validate.listing(F.lit(None).cast("string")))["score"] == 0.5
    scored = lambda text: validate.semantic_scores(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first()
    s = scored("")
    assert s["score"] == 0 and not s["returns"] and s["comment_ratio"] == 0
    assert scored(None)["score"] == 0
    s = scored("; note\nFoo:\n LDA #$10\n STA $2100,X\n RTS")
    assert s["instructions"] == 3 and s["orphans"] == 1 and s["modes"] == 4 and s["registers"] == 1 and abs(s["score"] - 0.64) < 1e-9  # RTS holds the name TS
    r = one(spark, validate.text_reply(F.lit("nineteen chars okay")))
    assert not r["valid"] and r["score"] == 0.1
    r = one(spark, validate.text_reply(F.lit(" ".join(["word"] * 20))))
    assert r["valid"] and abs(r["score"] - 0.9) < 1e-9
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.expr("cast(array() as array<string>)")
    t = one(spark, validate.expert_test(F.lit("lda sta"), words("LDA", "STA"), words("sta")))
    assert (t["score"], t["passed"]) == (0.5, False)
    assert one(spark, validate.keyword_coverage(F.lit("x"), words())) == 1.0 and one(spark, validate.keyword_coverage(F.lit("x"), words(), 0.0)) == 0.0
    assert [validate.unbalanced(t) for t in ("f(a[1])", 'x = "(";', "// (\n)", "/* ( */ {", "'\\'' (", None)] == [0, 0, 1, 1, 1, 0]
    assert one(spark, validate.log_errors(F.lit("x\nError: ValueError"))) == ["value_error", "error_line"]
    assert [one(spark, validate.backoff(F.lit(x))) for x in (0, 3, 10)] == [1.0, 8.0, 60.0]


def test_composite_validator(spark):
    df = spark.createDataFrame([("asm", "LDA $10"), ("cpp", "int f( {"), ("other", "x")], "domain string, output string")
    got = [r["v"] for r in df.select(validate.default_registry().composite().alias("v")).collect()]
    assert got[0]["valid"] and not got[1]["valid"] and got[1]["errors"] == ["unbalanced brackets"] and (got[2]["valid"], got[2]["score"]) == (True, 1.0)


def test_graph_and_catalog(spark):
    nodes = spark.createDataFrame([("sprite:Guard", "The Guard"), ("Link", None)], "id string, name string")
    df = spark.createDataFrame([(1, ["GUARD", "guard", "nobody"], True), (2, None, None), (3, [], True)], "id int, e array<string>, v boolean")
    got = {r["id"]: r for r in graph.coverage(df, "id", "e", nodes, "v").collect()}
    assert (got[1]["mentioned"], got[1]["found"], got[1]["coverage"]) == (2, 1, 0.5) and abs(got[1]["score"] - 0.85) < 1e-9
    assert got[2]["coverage"] == 1.0 and got[2]["score"] == 1.0 and got[3]["score"] == 1.0
    catalog = spark.createDataFrame([("p1", "a.pdf", "old"), ("p2", "b.pdf", "old")], "id string, filename string, title string")
    o = spark.createDataFrame([("p1", "by id"), ("a.pdf", "by file"), ("b.pdf", "")], "override_key string, title string")
    assert {r["id"]: r["title"] for r in graph.override(catalog, o, ["id", "filename"], "id", ["title"]).collect()} == {"p1": "by id", "p2": "old"}
    e = spark.createDataFrame([(1, 5, "x"), (2, 5, "x"), (3, 5, "x"), (4, 5, "x")], "id int, size int, h string")
    a = spark.createDataFrame([(1, 5, "x"), (2, 6, "y"), (3, 5, "y"), (9, 5, "x")], "id int, size int, h string")
    got = {r["id"]: r["status"] for r in graph.manifest_diff(e, a, "id", "size", "h").collect()}
    assert got == {1: "verified", 2: "size_mismatch", 3: "corrupted", 4: "missing", 9: "extra"}
    assert "FooBar" in one(spark, graph.entities(F.lit("See FooBar and $7E1234, FOOBAR")))


def test_segments(spark):
    body = "text " * 40
    df = spark.createDataFrame([(1, f"intro\n# One\n{body}\n# Two\nshort"), (2, None), (3, "")], "id int, text string")
    assert [(r["title"], r["body"]) for r in segment.sections(df, "id", "text").collect()] == [("One", body.strip())]
    asm_text = "; loads it\n; twice\nFoo:\n LDA $10\n RTS\nBar:\n NOP\n; last\nBaz:"
    got = segment.commented_blocks(spark.createDataFrame([(1, asm_text)], "id int, text string"), "id", "text").collect()
    assert [(r["label"], r["comment"], r["code"]) for r in got] == [("Foo", "loads it twice", " LDA $10\n RTS")]
    c = segment.context(spark.createDataFrame([(1, "a\nb\nHIT\nd")], "id int, text string"), "id", "text", "HIT", 2).first()
    assert (c["line_no"], c["before"], c["after"]) == (2, "a\nb", "d")
    tokens = lambda n: F.array(*(F.lit(str(k)) for k in range(n)))
    t = one(spark, segment.trim_tokens(tokens(5), tokens(4), tokens(3), 6))
    assert (t["prefix"], len(t["completion"]), len(t["suffix"])) == ([], 4, 2)
    assert one(spark, segment.abstract(F.lit("Title\nAbstract\nWe do it.\n1 Introduction\nx"))) == "We do it."
    p = segment.paraphrases(spark.createDataFrame([(1, "go"), (2, None)], "id int, text string"), "id", "text", [("a", "{}"), ("b", "Please {}")], 3).collect()
    assert sorted(r["variant"] for r in p) == ["Please go", "go"]


def test_rewriting(spark):
    symbols = spark.createDataFrame([("7E0010", "Work", 1, 0), ("7E0010", "Main", 2, 0), ("7E0010", "Last", 2, 5), ("10", "Low", 1, 0)], "address string, name string, priority int, line_no int")
    merged = rewrite.merge_symbols(symbols)
    assert {r["address"]: r["name"] for r in merged.collect()} == {"7E0010": "Last", "0010": "Last", "10": "Low"}
    df = spark.createDataFrame([(1, "LDA $7e0010\nSTA $1000\nLDX $10"), (2, "NOP")], "id int, code string")
    assert [r["enriched"] for r in rewrite.enrich(df, "id", "code", merged).collect()] == ["LDA Last\nSTA $1000\nLDX Low"]
    got = one(spark, rewrite.replace_labels(F.lit("JSR B ; B\nJSL A\nLDA AB"), F.array(F.lit("B"), F.lit("A"))))
    assert got == "JSR $2002 ; B\nJSL $7E2000\nLDA AB"
    assert one(spark, rewrite.missing_labels(F.lit("Label 'Foo' wasn't found; Label 'Foo' wasn't found"))) == ["Foo"]
    found = rewrite.scan_symbols(spark.createDataFrame([(1, "Foo = $7e10 ; x\n; Bar = $1")], "id int, text string"), "id", "text").collect()
    assert [(r["name"], r["address"]) for r in found] == [("Foo", "7E10")]


def test_formats_and_profile(spark):
    m = one(spark, formats.chatml("S", F.lit("q"), F.lit("i"), F.lit("a"), F.lit("t")))
    assert [x["content"] for x in m] == ["S", "q\n\ni", "<thinking>\nt\n</thinking>\n\na"]
    assert one(spark, formats.chat_text(formats.chatml("S", F.lit("q"), F.lit(""), F.lit("a")))).count("<|im_start|>") == 3
    df = spark.createDataFrame([("a", "xx"), ("", None), ("b", "```\ny\n```")], "instruction string, output string")
    p = profile.qa_profile(df).first()
    assert (p["total"], p["missing_instruction"], p["missing_output"], p["fenced"], p["mean_output"]) == (3, 1, 1, 1, 11 / 3)
    scores = spark.createDataFrame([(0.0,), (0.75,), (0.0,), (0.2,), (0.0,)], "s double")
    r = profile.eval_report(scores, F.col("s"), F.col("s") >= 0.6, F.lit(False), F.lit(0.0)).first()
    assert r["passed"] == 1 and abs(r["avg_score"] - 0.19) < 1e-9 and r["avg_latency"] is None


def test_routines(spark):
    assert one(spark, routines.techniques(F.lit("phb\nplb\nLDX #$07\n.l\nDEX\nBPL .l\nRTL"))) == ["bank switching with data bank register preservation", "long return from subroutine", "loop with counter"]
    assert one(spark, routines.techniques(F.lit(None).cast("string"))) == []
    assert one(spark, routines.is_data_only(F.lit("; c\nTab:\n#_01: db 1\n dw 2"))) is True
    assert one(spark, routines.is_data_only(F.lit("Tab:\n db 1\n RTS"))) is False
    assert one(spark, routines.is_room_data(F.lit("GFX_x"))) and not one(spark, routines.is_room_data(F.lit("LinkGraphicsX")))
    assert abs(one(spark, routines.routine_quality(F.lit("\n".join(["JSL Foo"] * 8)), F.lit("spawn_entity"))) - 0.65) < 1e-9
    assert one(spark, routines.description_to_instruction(F.lit("adds two numbers. ;"))) == "Write a 65816 routine that adds two numbers."
    assert one(spark, routines.description_to_instruction(F.lit("$12"))) == ""
    assert one(spark, routines.extract_address(F.lit("at $EE1ED or $02:8000"))) == "$02:8000"
    assert one(spark, routines.is_long_context(F.lit("lda.l Foo"))) and not one(spark, routines.is_long_context(F.lit("LDA Foo")))
    df = spark.createDataFrame([(1, "a\n LDA $1 ; TODO: fix the crash\nb"), (2, None)], "id int, text string")
    t = routines.task_cases(df, "id", "text").first()
    assert (t["marker"], t["task"], t["task_type"], t["category"], t["difficulty"], t["before"]) == ("TODO", "fix the crash", "bug", "todos", "hard", "a")
    c = one(spark, routines.commit_profile(F.lit("Fix HUD bug")))
    assert (c["expert"], c["system"]) == ("farore", "Menu")
    assert one(spark, routines.explanation(F.lit("LDA $1\nRTS"))) == "This code loads values, returns."
    r = spark.createDataFrame([(1, "Foo", "JSL Bar\nRTS"), (2, "GFX_a", "RTS"), (3, "Tab", "db 1")], "id int, name string, code string")
    assert {x["id"] for x in routines.routine_samples(r, "id", "name", "code", F.lit("x")).collect()} == {1}


def test_summaries_and_lookups(spark):
    df = spark.createDataFrame([("m", True, True, 1.0, None), ("m", True, False, 0.5, "label"), ("m", None, None, None, None)], "m string, a boolean, v boolean, s double, f string")
    r = profile.validation_summary(df, F.col("a"), F.col("v"), F.col("s"), F.col("f"), ["m"]).first()
    assert (r["total"], r["attempted"], r["passed"], r["failed"], r["skipped"], r["pass_rate"], r["mean_score"], r["failure_families"]) == (3, 2, 1, 1, 1, 0.5, 0.75, "label:1")
    e = profile.expert_rollup(df, "m", F.col("f"), F.col("s"), F.col("v")).first()
    assert (e["calls"], e["share"], e["completed"], e["reasons"]) == (3, 1.0, 1, "label:1")
    look = graph.with_default(df.select("m").distinct(), spark.createDataFrame([("x", "v")], "m string, w string"), "m", "w", "none")
    assert look.first()["w"] == "none"
    entries = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    logged = spark.createDataFrame([("a", 1, "kept"), ("a", 2, "purged"), ("b", 1, "kept")], "k string, n int, s string")
    assert {r["k"]: r["s"] for r in graph.listing_with_state(entries, logged, "k", "n", "s", "purged").collect()} == {"b": "kept", "c": "untracked"}
