import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkloom.llm.mixing import fill, mix_to_weights
from sparkloom.llm.sampling import allot, sample_to_targets


def brute_seats(size, have, share, floor):
    """Floors first, then the smallest (rank - 0.5) / target."""
    got = [min(h, f) for h, f in zip(have, floor)]
    queue = sorted(((r - 0.5) / t, k) for k, (h, t) in enumerate(zip(have, share)) if t > 0 for r in range(1, h + 1))
    taken = [0] * len(have)
    for _, k in queue:
        if sum(max(t, g) for t, g in zip(taken, got)) >= max(size, sum(got)):
            break
        taken[k] += 1
    return [max(t, g) for t, g in zip(taken, got)]


def test_seats_follow_the_smallest_priorities():
    rng = random.Random(1)
    for _ in range(200):
        k = rng.randrange(1, 7)
        have, floor = [rng.randrange(0, 30) for _ in range(k)], [rng.randrange(0, 4) for _ in range(k)]
        share = [rng.random() for _ in range(k)]
        share = [s / sum(share) for s in share]
        size = rng.randrange(0, 60)
        df = pd.DataFrame({"category": [f"c{j}" for j in range(k)], "target_share": share, "min_rows": floor, "available": have, "sample_rows": size, "sample_share": 0.5, "pool_rows": 2 * size})
        assert allot(df)["seats"].tolist() == brute_seats(size, have, share, floor)


POOL = [(k, ["A b", "a-b ", "c", None, "zz"][k % 5]) for k in range(200)]


def test_sample_and_report(spark):
    pool = spark.createDataFrame([(i, c, "x") for i, c in POOL + POOL[:50]] + [(None, "c", "x")], "rec_id bigint, category string, rank string")
    targets = spark.createDataFrame([(1, 0.3, "a_b", 0.5, 2), (1, 0.3, "c", 0.4, 2), (1, 0.3, "none", 0.1, 3), (2, 0.9, "c", 1.0, 0)], "request_id int, sample_share double, category string, target_share double, min_rows int")
    sample, report = sample_to_targets(pool, targets, "rec_id")
    rows = {(r["request_id"], r["category"]): r for r in report.collect()}
    assert rows[1, "a_b"]["available"] == 80 and rows[1, "c"]["available"] == 40 and rows[1, "none"]["available"] == 0
    assert {k for k, r in rows.items() if r["short"]} == {(1, "none"), (2, "c")}
    assert sum(r["seats"] for k, r in rows.items() if k[0] == 1) == 60  # the seats of the missing category pass on
    drawn = sample.collect()
    assert len({(r["request_id"], r["rec_id"]) for r in drawn}) == len(drawn) == 60 + 40
    for key, r in rows.items():
        assert sum((d["request_id"], d["category"]) == key for d in drawn) == r["seats"]
        assert sorted(d["rank"] for d in drawn if (d["request_id"], d["category"]) == key) == list(range(1, r["seats"] + 1))


def test_sample_of_empty_tables(spark):
    pool = spark.createDataFrame([], "rec_id bigint, category string")
    targets = spark.createDataFrame([(1, 0.3, "a_b", 1.0, 2)], "request_id int, sample_share double, category string, target_share double, min_rows int")
    sample, report = sample_to_targets(pool, targets, "rec_id")
    assert sample.count() == 0 and [r["short"] for r in report.collect()] == [True]
    assert sample_to_targets(pool, targets.limit(0), "rec_id")[0].count() == 0


def test_fill_reaches_the_budget():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 90, 8))
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = fill(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((lengths * take).sum())
        assert got <= budget
        assert budget - got <= 3 or got == max(s for s in sums if s <= budget)


def test_fill_large_counts_are_exact():
    lengths, counts = np.arange(10, 500), np.full(490, 1000)
    budget = int((lengths * counts).sum() // 3)
    assert int((lengths * fill(lengths, counts, budget)).sum()) == budget
    assert fill(np.array([0, 5]), np.array([3, 2]), 5).tolist()[1] == 1


def test_mix(spark):
    rows = [(k, ["S one", "s_one", "two", None][k % 4], "cat", "i" * (k % 17), "o" * (k % 23)) for k in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:20]], "rec_id bigint, source string, category string, instruction string, output string, size int")
    weights = spark.createDataFrame([(1, "source", 0.5, "s_one", 0.6, 2), (1, "source", 0.5, "two", 0.4, 1), (2, "source", 3.0, "two", 1.0, 2), (3, "category", 0.1, "nope", 1.0, 5)], "mix_id int, dimension string, mix_share double, member string, weight double, max_repeats int")
    mixture, report = mix_to_weights(df, weights)
    got = {(r["mix_id"], r["member"]): r for r in report.collect()}
    assert {k for k, r in got.items() if r["short"]} == {(2, "two"), (3, "nope")}
    sizes = {r[0]: len(r[3]) + len(r[4]) for r in rows}
    drawn = mixture.collect()
    for key, r in got.items():
        mine = [d for d in drawn if (d["mix_id"], d["member"]) == key]
        assert sum(sizes[d["rec_id"]] * d["repeats"] for d in mine) == r["actual"]
        assert len({d["rec_id"] for d in mine}) == len(mine)
        assert r["short"] or 0 <= r["wanted"] - r["actual"] < 2
    assert max(d["repeats"] for d in drawn if d["mix_id"] == 2) == 2
    empty, report = mix_to_weights(df.limit(0), weights)
    assert empty.count() == 0 and report.count() == 4


def test_mix_by_another_size(spark):
    df = spark.createDataFrame([(k, "one", "cat", "text", 3 + k % 5) for k in range(100)], "rec_id bigint, source string, category string, instruction string, tokens int")
    weights = spark.createDataFrame([(1, "source", 0.5, "one", 1.0, 1)], "mix_id int, dimension string, mix_share double, member string, weight double, max_repeats int")
    mixture, report = mix_to_weights(df, weights, texts=("instruction",), size=F.col("tokens"))
    row = report.first()
    assert row["available"] == 500 and row["actual"] == 250 and row["unfilled"] == 0
    assert mixture.join(df, "rec_id").agg(F.sum("tokens")).first()[0] == 250


def test_fill_keeps_the_spread_of_lengths_beside_an_outlier():
    lengths, counts = np.array([50, 100, 150, 1_000_000]), np.array([4000, 4000, 4000, 1])
    take = fill(lengths, counts, 120_000)
    assert int((lengths * take).sum()) == 120_000 and take[3] == 0 and (take[:3] > 250).all()


def test_fill_has_no_cap_on_its_work():
    lengths = np.arange(1, 3001) * 7  # nothing but multiples of seven: the exact budget is out of reach
    take = fill(lengths, np.ones(3000, np.int64), 7 * 1_000_000 + 3)
    assert int((lengths * take).sum()) == 7 * 1_000_000


def test_report_shows_categories_that_floors_of_others_push_down(spark):
    pool = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(100)], "rec_id bigint, category string")
    targets = spark.createDataFrame([(1, 0.2, "a", 0.9, 0), (1, 0.2, "b", 0.1, 15)], "request_id int, sample_share double, category string, target_share double, min_rows int")
    rows = {r["category"]: r for r in sample_to_targets(pool, targets, "rec_id")[1].collect()}
    assert rows["a"]["seats"] == 5 and rows["a"]["below_target"] and not rows["a"]["short"] and abs(rows["b"]["actual_share"] - 0.75) < 1e-9
