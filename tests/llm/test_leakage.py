import random

from sparkloom.llm import leakage
from sparkloom.llm.leakage import leaked_passages
from sparkloom.llm.tiling import tiles
from sparkloom.llm.words import HASHES, rolling, words


def test_rolling_hash_depends_on_the_run_only():
    a = HASHES.array("x y z a b c d e".split())
    b = HASHES.array("q a b c d e r".split())
    assert rolling(a, 5)[3] == rolling(b, 5)[1]
    assert len(rolling(a, 9)) == 0


def test_tiles_cover_reordered_parts():
    text, pattern = "m n a b c d q e f g h".split(), "e f g h a b c d".split()
    found = tiles(text, pattern, HASHES.array(text), HASHES.array(pattern), 3)
    assert sorted(n for _, _, n in found) == [4, 4]


def test_tiles_do_not_overlap_and_are_common():
    rng = random.Random(2)
    for _ in range(60):
        t, p = ([rng.choice("abc") for _ in range(rng.randrange(40))] for _ in range(2))
        found = tiles(t, p, HASHES.array(t), HASHES.array(p), 3)
        used_t = [i for i, _, n in found for i in range(i, i + n)]
        used_p = [j for _, j, n in found for j in range(j, j + n)]
        assert len(used_t) == len(set(used_t)) and len(used_p) == len(set(used_p))
        assert all(t[i : i + n] == p[j : j + n] for i, j, n in found)
        longest = max((n for n in range(3, 41) for i in range(len(t) - n + 1) for j in range(len(p) - n + 1) if t[i : i + n] == p[j : j + n]), default=0)
        assert max((n for _, _, n in found), default=0) == longest


def test_repetitive_texts_end(monkeypatch):
    text, pattern = ["a"] * 60_000, ["a"] * 80
    assert tiles(text, pattern, HASHES.array(text), HASHES.array(pattern), 5) == [(0, 0, 80)]
    text, pattern = "a b a b a b c a b a b".split() * 30, "a b a b x a b c a b".split()
    whole = tiles(text, pattern, HASHES.array(text), HASHES.array(pattern), 2)
    monkeypatch.setattr("sparkloom.llm.tiling.PAIRS", 7)  # seeds in many parts give the same tiles
    assert tiles(text, pattern, HASHES.array(text), HASHES.array(pattern), 2) == whole


def brute(docs, items, least=12):
    grams = lambda t: {tuple(w[i : i + least]) for w in [words(t)] for i in range(len(w) - least + 1)}
    return {(d, i) for d, t in docs for i, a, b in items if grams(t) & (grams(a) | grams(b))}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(50)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, sentence(30), sentence(20) if k % 3 else None) for k in range(12)]
    docs = []
    for k in range(60):
        text = sentence(40)
        if k % 3 == 0:
            w = items[k % 12][1].split()
            n = rng.choice([11, 12, 20])
            text = sentence(5) + " " + ", **".join(w[3 : 3 + n]).upper() + "\n" + sentence(9)
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    c = spark.createDataFrame([(d, t, "item") for d, t in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, instruction string, expected_output string")
    want = brute([(d, t or "") for d, t in docs], items)
    for size in (leakage.BLOCK_WORDS, 60):  # one block, several blocks
        monkeypatch.setattr(leakage, "BLOCK_WORDS", size)
        assert {(r[0], r[1]) for r in leaked_passages(c, i).select("doc_id", "item_id").collect()} == want


def test_reordered_passage_by_its_coverage(spark):
    w = [f"w{k}" for k in range(40)]
    parts = [w[k : k + 8] for k in range(0, 40, 8)]
    text = " and then ".join(" ".join(p) for p in reversed(parts))
    c = spark.createDataFrame([(1, text), (2, " ".join(w[:8])), (3, "other")], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(w), None)], "item_id bigint, instruction string, expected_output string")
    assert leaked_passages(c, i).count() == 0  # no twelve words in a row
    found = leaked_passages(c, i, min_words=5, min_coverage=0.6).collect()
    assert [(r["doc_id"], r["tiles"], r["covered"], r["coverage"]) for r in found] == [(1, 5, 40, 1.0)]


def test_passages_of_all_lengths_take_one_scan(spark):
    c = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join("abcdef"[: k + 1]), None) for k in range(6)], "item_id bigint, instruction string, expected_output string")
    found = leaked_passages(c, i)
    assert found.count() == 6 and str(found._jdf.queryExecution().executedPlan()).count("MapInArrow ") == 1


def test_empty_sides_and_short_passages(spark):
    c = spark.createDataFrame([(1, "we saw alpha beta gamma there")], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, "Alpha, beta gamma!", None), (8, None, ""), (None, "saw alpha", "x")], "item_id bigint, instruction string, expected_output string")
    assert [(r["item_id"], r["coverage"]) for r in leaked_passages(c, i).collect()] == [(7, 1.0)]
    assert leaked_passages(c, i.limit(0)).count() == 0
    assert leaked_passages(c.limit(0), i).count() == 0
