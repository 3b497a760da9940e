import random

import pytest

from sparkloom.llm.splitting import oversized, split_oversized, split_text
from sparkloom.llm.tokens import encoder, read_vocabulary


@pytest.fixture(scope="module")
def enc():
    return encoder(read_vocabulary(None))


def check(text, enc, limit=60, overlap=10):
    pieces = split_text(text, enc, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in zip(pieces, pieces[1:]):
        assert a[0] < b[0] <= a[1] < b[1]
        assert overlap - 2 <= len(enc.encode(text[b[0] : a[1]])) <= overlap + 8
    assert all(len(enc.encode(text[a:b])) <= limit for a, b, _, _ in pieces)
    return pieces


def test_cuts_at_headings(enc):
    text = "# One\n\n" + "alpha beta. " * 12 + "\n\n# Two\n\n" + "gamma delta. " * 12
    pieces = check(text, enc, 60, 10)
    assert any(text[a:b].find("# Two") >= 0 and n for a, b, _, n in pieces)
    assert all(natural for _, _, _, natural in pieces)


def test_unbroken_text(enc):
    for text in ("x" * 3000, "😀" * 400, "qwzkvj" * 400, "中文字" * 300):
        pieces = split_text(text, enc, 60, 10)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(len(enc.encode(text[a:b])) <= 60 for a, b, _, _ in pieces)
        assert all(b[0] <= a[1] for a, b in zip(pieces, pieces[1:]))


def test_random_texts(enc):
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice(["word ", "Sentence end. ", "\n", "\n\n", "# head\n", "- item\n", "```\ncode\n```\n", "é", "$7E12AB "]) for _ in range(300))
        check(text, enc)


def test_first_piece_is_filled_to_the_limit(enc):
    pieces = check(" a." * 200, enc, 60, 10)
    assert pieces[0][2] >= 58 and pieces[1][2] >= 50


def test_many_fences_and_blank_lines(enc):
    text = "```\ncode\n\nmore\n```\n\nprose here\n\n" * 400
    pieces = check(text, enc, 60, 10)
    assert all(natural for _, _, _, natural in pieces)


def test_table_cases(spark):
    long = "One sentence here. " * 500
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "short", 1), (4, long, 1), (4, long, 1), (None, long, 1), (6, "   ", 1)], "doc_id bigint, text string, piece_no int")
    rows = split_oversized(df).collect()
    assert {r["doc_id"] for r in rows} == {3, 4, 6, None}
    assert all(r["n_tokens"] is None or r["n_tokens"] <= 1000 for r in rows)
    assert sorted(str(r[0]) for r in oversized(df).collect()) == ["4", "4", "None"]
    assert split_oversized(df.limit(0)).count() == 0


def test_exact_limit_is_one_piece(enc):
    text = " a" * 60
    assert len(split_text(text, enc, 60, 10)) == 1 and len(split_text(text + " a", enc, 60, 10)) == 2
