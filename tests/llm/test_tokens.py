import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.tokens import RankQueue, encode_table, encoder, read_vocabulary

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    file = read_vocabulary(None)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    return encoder(file), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefgh ther'sllve \n\t 　​é中😀_-#$0123456789\x85\x1c<|endoftext|>"), max_size=120))
def test_same_ids_as_the_public_library(text):
    file = read_vocabulary(None)
    ours = encoder(file)
    ranks = ours.ranks
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_very_long_pretoken(both):
    ours, theirs = both
    text = "abcabd" * 3000
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert len(ours.merge(b"ab" * 200_000)) > 0


def test_rank_queue_gives_ranks_in_order():
    q = RankQueue(50_257)
    for rank, at in ((70, 3), (5, 1), (50_000, 9), (70, 2)):
        q.push(rank, at)
    assert [q.pop() for _ in range(4)] == [(5, [1]), (70, [2, 3]), (50_000, [9]), None]


def test_table_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " ", "z"), (3, " ", "z"), (None, "hello world", "w"), (5, "a" * 50_000, "v")], "doc_id bigint, text string, ids string")
    rows = sorted(((r["doc_id"], r["ids"]) for r in encode_table(df).collect()), key=str)
    by = [ids for i, ids in rows if i in (1, 2)]
    assert by == [[], []]
    assert [len(ids) for i, ids in rows if i == 3] == [1, 1]
    assert any(i is None and len(ids) == 2 for i, ids in rows)
    assert encode_table(df.limit(0)).count() == 0
