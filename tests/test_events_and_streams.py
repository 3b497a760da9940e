import pytest
from pyspark.sql import functions as F

from sparkloom import runtime
from sparkloom.operators import curate, events, generate, mix
from sparkloom.sources import files
from sparkloom.streaming import jobs

ROWS = [(k, "u", t, v) for k, (t, v) in enumerate([("a", 10.0), ("a", 0.0), ("a", 20.0), ("b", 5.0), ("c", 6.0)])]


def log(spark, rows=None):
    return spark.createDataFrame(rows or ROWS, "seq int, user string, tool string, d double")


def test_running_average(spark):
    got = {r["tool"]: r for r in events.tool_rollup(log(spark), "tool", F.lit(False), F.col("d"), F.col("seq")).collect()}
    assert abs(got["a"]["running_avg"] - 40 / 3) < 1e-9 and got["a"]["mean_positive"] == 15.0 and got["a"]["calls"] == 3
    rows = [(k, "u", "t", float(k * 7 % 5) - 1) for k in range(60)]
    avg = 0.0
    for k, (_, _, _, d) in enumerate(rows, 1):
        avg = (avg * (k - 1) + d) / k if d > 0 else avg
    for part in (None, F.floor(F.col("seq") / 9)):
        got = events.tool_rollup(log(spark, rows), "tool", F.lit(False), F.col("d"), F.col("seq"), part).first()
        assert abs(got["running_avg"] - avg) < 1e-9
    one = events.tool_rollup(log(spark, [(1, "u", "x", 0.0)]), "tool", F.lit(False), F.col("d"), F.col("seq")).first()
    assert one["running_avg"] == 0.0


def test_progress(spark):
    rows = [(1, "u", "x", 1.0), (2, "u", "x", 1.0), (3, "u", "x", 1.0), (4, "u", "y", 0.0), (5, "u", "z", 0.0)]
    got = [r["state"] for r in events.progress(log(spark, rows), ["user"], ["seq"], "tool", F.col("d") > 0).orderBy("seq").collect()]
    assert got == [None, None, "spinning", None, "making_progress"]


def test_sequences(spark):
    df = log(spark)
    assert [r["s"] for r in events.sticky(df, F.when(F.col("d") > 9, F.col("tool")), ["user"], ["seq"], "s").orderBy("seq").collect()] == ["a"] * 5
    assert [r["seen_before"] for r in events.seen_before(df, F.col("tool") == "b", ["user"], "seq").orderBy("seq").collect()] == [False] * 4 + [True]
    assert events.rolling_context(df, "tool", ["user"], ["seq"], 2).orderBy("seq").collect()[-1]["context"] == "b > c"
    assert [r["seq"] for r in events.latest(df, ["tool"], [F.col("seq")]).orderBy("seq").collect()] == [2, 3, 4]
    assert [r["n"] for r in events.share_of_total(df, "tool").orderBy("tool").collect()] == [3, 1, 1]
    assert [r["seq"] for r in events.every_nth(df, ["user"], ["seq"], 2).collect()] == [1, 3]
    assert events.steps(df, ["user"], ["seq"], F.col("d") > 0).orderBy("seq").collect()[-1]["next_step"] == 4
    turns = spark.createDataFrame([(1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "r")], "c int, t int, role string, text string")
    assert [(r["text"], r["reply"]) for r in events.pair_turns(turns, "c", "t", "role", "text").collect()] == [("q", "a")]
    assert df.select(events.level_at_least(F.lit("error"), "warning").alias("x")).first()["x"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"instruction":"x"}\n\nnot json\n{"instruction":"caf\xff"}\n')
    df = files.read_jsonl(spark, str(tmp_path), "instruction string").cache()
    assert df.count() == 3 and df.filter("_corrupt_record is not null").count() == 1
    assert files.read_jsonl(spark, str(tmp_path), "instruction string", drop_bad=True).count() == 2
    assert [r["src_pos"] for r in files.read_lines(spark, str(tmp_path)).orderBy("src_pos").collect()] == [0, 2, 3]
    files.write_split(spark.createDataFrame([(True, "a"), (False, "b")], "passed boolean, x string"), "passed", str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("passed")) == ["passed=false", "passed=true"]


def test_files_and_parsers(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("same")
    (tmp_path / "docs/b.md").write_text("same")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/c.md").write_text("x")
    df = files.index_files(spark, [str(tmp_path)], "*.md", content=True)
    assert sorted(r["name"] for r in df.collect()) == ["a.md", "b.md"] and df.select("md5").distinct().count() == 1
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(files.pdf_info(F.lit(b"%PDF-1.4 /Title (A b) /Author ()"))).asDict() == {"is_pdf": True, "title": "A b", "author": None}
    assert [(e["file"], e["line"]) for e in one(files.compiler_errors(F.lit("a.asm:12: error: bad\nb: note")))] == [("a.asm", 12)]
    assert one(files.linker_symbols(F.lit("7e:0010 Foo")))[0].asDict() == {"address": 0x7E0010, "name": "Foo"}
    assert one(files.scan_log(F.lit("#scanall\nRSSI: -40 Ch: 6 BSSID: AA:BB:CC:DD:EE:FF ESSID: net")))["networks"][0]["channel"] == 6
    assert one(F.try_variant_get(files.marked_json(F.lit('x<<{"a":1}>>y'), "<<", ">>"), "$.a", "int")) == 1
    assert one(F.try_variant_get(files.reply_json(F.lit('```json\n{"a":2}\n```')), "$.a", "int")) == 2
    assert one(files.reply_json(F.lit("no json"))) is None
    assert files.markdown_table(spark.createDataFrame([(1, None)], "a int, b string")).endswith("| 1 |  |")


def test_streams_equal_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 5).cast("string").alias("user"), F.timestamp_seconds(F.col("id") * 37).alias("ts"), F.lit(1.0).alias("value"))
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = jobs.windowed(stream, "ts", "user", "value").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = jobs.windowed(rows, "ts", "user", "value")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    jobs.current_state(stream, ["user"], "id", str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    state = lambda: sorted(r["id"] for r in jobs.read_state(spark, str(tmp_path / "state"), rows.schema).collect())
    assert state() == [195, 196, 197, 198, 199]
    rows.filter("id = 0").withColumn("id", F.lit(900).cast("bigint")).write.mode("append").parquet(src)
    jobs.current_state(stream, ["user"], "id", str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    assert state() == [196, 197, 198, 199, 900]  # only the part of the changed key has a new version
    assert len(list((tmp_path / "state/v=1").glob("part=*"))) == 1
    with pytest.raises(Exception, match="another checkpoint"):
        jobs.current_state(stream, ["user"], "id", str(tmp_path / "state"), str(tmp_path / "cp2")).awaitTermination(120)
    raw = spark.createDataFrame([('{"kind":"scan","networks":[]}',), ("not json",), ('{"links":[1]}',)], "value string")
    got = jobs.ingest(raw).select("error", "raw", jobs.is_scan(F.col("kind"), F.col("body")).alias("s")).collect()
    assert [(r["error"], r["raw"], bool(r["s"])) for r in got] == [(None, None, True), ("invalid_json", "not json", False), (None, None, True)]
    assert jobs.sessions(rows, "ts", "user").count() == 5


def test_fan_out_and_handlers(spark, tmp_path):
    src, rows = str(tmp_path / "src"), spark.range(20).select("id", F.when(F.col("id") % 2 == 0, "tool").otherwise("route").alias("kind"))
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    sinks = {name: (lambda batch, number, name=name: batch.write.mode("overwrite").parquet(f"{tmp_path}/{name}/{number}")) for name in ("a", "b")}
    jobs.fan_out(stream, sinks, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/a/*").count() == spark.read.parquet(f"{tmp_path}/b/*").count() == 20
    handlers = jobs.Handlers()
    handlers.on("tool", "calls", lambda: F.lit("x"))
    handlers.on("tool", "sum", lambda: F.lit("x"), lambda: F.col("id"))
    q = handlers.metrics(stream, "kind").writeStream.format("memory").queryName("m").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("m").collect())) == sorted(map(tuple, handlers.metrics(rows, "kind").collect())) == [("calls", "x", 10, 10.0), ("sum", "x", 10, 90.0)]


def test_sinks_and_configuration(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Explain it", "LDA $10", None, None), (2, "x", "", None, None), (3, "TODO later", "RTS", None, None)], "id int, instruction string, output string, domain string, source string")
    annotated = curate.normalize_records(rows)
    counts = files.write_normalized(annotated, str(tmp_path / "out"))
    assert counts == {"kept": 1, "drop_missing_output": 1, "drop_todo_instruction": 1}
    assert spark.read.json(f"{tmp_path}/out/status=kept").count() == 1 and spark.read.json(f"{tmp_path}/out/status=rejected").count() == 2
    assert spark.read.json(f"{tmp_path}/out_report").count() == 3
    with pytest.raises(Exception):
        files.write_jsonl(rows, str(tmp_path / "out"))
    files.write_jsonl(rows, str(tmp_path / "plain"))
    files.write_index(rows.select("id"), str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "plain")).count() == spark.read.json(str(tmp_path / "index")).count() == 3
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf/a.toml").write_text('name = "x"\n[limits]\nmost = 3\n')
    got = files.read_config("a.toml", ["/nowhere", str(tmp_path / "conf")], {"name": "d", "limits": {"most": 1, "least": 0}})
    assert got == {"name": "x", "limits": {"most": 3, "least": 0}}
    assert files.read_config("none.json", [str(tmp_path)], {"a": 1}) == {"a": 1} and files.resolve_path("b.toml", [str(tmp_path / "conf")]) is None
    assert [r["error"] for r in files.missing_roots(spark, [str(tmp_path), str(tmp_path / "gone")]).collect()] == ["missing"]
    assert files.fixed_width(spark.createDataFrame([("a", 1.5), ("bcd", None)], "k string, v double")).splitlines() == ["k    v", "a    1.50", "bcd"]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.json").write_text('{"messages": [{"role": "user"},\n {"role": "x"}]}')
    (tmp_path / "logs/b.json").write_text("broken")
    assert [r["message"]["role"] for r in files.read_messages(spark, str(tmp_path / "logs"), "role: string").orderBy("message_no").collect()] == ["user", "x"]
    (tmp_path / "tree").mkdir()
    for name in ("a.md", "b.md", "skipme.md"):
        (tmp_path / "tree" / name).write_text("x")
    assert [r["name"] for r in files.index_files(spark, [str(tmp_path / "tree")], "*.md", skip=["skipme"], most=1).collect()] == ["a.md"]


def test_generators(spark):
    made = generate.Generators()
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, t string")
    made.add("all", lambda rows: rows.select("id", F.col("t").alias("instruction")))
    made.add("some", lambda rows: rows.select("id", F.upper("t").alias("instruction")), lambda: F.col("t") == "a")
    samples, report = made.run(df, ["id", "instruction"])
    assert samples.count() == 4 and {tuple(r) for r in report.select("generator", "taken", "skipped").collect()} == {("all", 3, 0), ("some", 1, 2)}


def test_ordered_split_over_any_numbers(spark):
    for rows in ([(float(k * k),) for k in range(1000)], [(0.5,)], [(k * 10**15 + (k == 999),) for k in range(1000)]):
        df = spark.createDataFrame(rows, "v double" if isinstance(rows[0][0], float) else "v bigint")
        for fraction in (0.0, 0.1, 0.9, 1.0):
            got = mix.ordered_split(df, "v", fraction)
            want = sorted(r[0] for r in rows)[: int(len(rows) * fraction)]
            assert sorted(r["v"] for r in got.filter("split = 'train'").collect()) == want


def test_mix_of_datasets_has_the_known_sizes(spark):
    """Six datasets of known sizes at 2 %, one row at least, rounded half to even."""
    sizes = {"a": 28707, "b": 11044, "c": 19303, "d": 3894, "e": 211, "f": 53}
    rows = None
    for name, n in sizes.items():
        one = spark.range(n).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("id"), F.lit(name).alias("dataset"))
        rows = one if rows is None else rows.unionByName(one)
    report = {r["dataset"]: r for r in mix.mix_report(mix.stratified_split(rows, "dataset", "id"), "dataset").collect()}
    assert report[None]["is_total"] and (report[None]["train"], report[None]["eval"]) == (61_948, 1_264)
    assert [round(report[k]["ratio_percent"], 2) for k in sizes] == [45.41, 17.47, 30.54, 6.16, 0.33, 0.08]


def test_broadcasts_and_filters_of_keys(spark):
    big = spark.range(200_000).withColumn("t", F.repeat(F.lit("x"), 300))
    assert runtime.broadcast_if_small(big, 1000) is big and runtime.broadcast_if_small(big.limit(3), 1 << 40) is not None
    wanted = spark.createDataFrame([(3,), (77,), (None,)], "id bigint")
    kept = runtime.maybe_among(spark.range(1000), "id", wanted)
    assert {3, 77} <= {r["id"] for r in kept.collect()} and kept.count() < 10


def test_slices_of_a_key_give_what_the_whole_key_gives(spark):
    import random

    rng = random.Random(8)
    rows = [(k, rng.choice("uvw") if k % 3 else "hot", rng.choice("abc"), rng.random() < 0.5, rng.choice([None, "", "x", "y"]), rng.choice([None] * 9 + [1])) for k in range(400)]
    df = spark.createDataFrame(rows, "seq int, user string, tool string, failed boolean, value string, back int")
    keys, order, part, failed = ["user"], ["seq"], F.floor(F.col("seq") / 23), F.col("failed")
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("seq") * F.col("seq") * 7))
    for make in (
        lambda s: events.sticky(df, F.col("value"), keys, order, "out", s),
        lambda s: events.progress(df, keys, order, "tool", failed, s),
        lambda s: events.rolling_context(df, "tool", keys, order, 4, slice_of=s),
        lambda s: events.idle_gaps(timed, keys, "ts", 15, s),
        lambda s: events.every_nth(df, keys, order, 7, s),
        lambda s: events.steps(df, keys, order, ~failed, F.col("back"), s),
        lambda s: events.watcher_samples(df, keys, order, "tool", failed, F.col("tool"), 6, s),
    ):
        whole, sliced = make(None), make(part)
        assert whole.columns == sliced.columns
        assert sorted(map(str, whole.collect())) == sorted(map(str, sliced.collect())) != []
    assert events.sticky(df.limit(0), F.col("value"), keys, order, "out", part).count() == 0
