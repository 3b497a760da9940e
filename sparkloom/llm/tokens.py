"""Byte-pair encoding of whole tables with a public vocabulary (problem 6).

Each pre-token is merged with a hierarchical-bitmap rank queue: one bucket of linked-list positions
for each merge rank, and a three-level bitmap over the ranks whose find-first-set gives the next
rank to merge. Entries made stale by a neighbouring merge are skipped when they come up. The cost is
linear in the merges done, so a pre-token of a million bytes takes seconds, not hours.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_TOKENIZER = "byte_bpe_50k.tiktoken"
#: Pre-tokens remembered by a Python worker; the memory is emptied when full.
CACHE_ENTRIES = 400_000
CACHED_CHARS = 64

# The split pattern of this vocabulary family, with white space as Unicode defines it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{l}+| ?{n}+| ?[^{s}{ln}]+|[{s}]+(?![^{s}])|[{s}]+"
_SPLIT_ANY = regex.compile(_SPLIT.format(l=r"\p{L}", n=r"\p{N}", s=_SPACE, ln=r"\p{L}\p{N}"))
_SPLIT_ASCII = re.compile(_SPLIT.format(l="[A-Za-z]", n="[0-9]", s=r"\t-\r ", ln="A-Za-z0-9"))


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where the installed vocabulary file lies; any other path may be passed to the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split(text: str) -> list[str]:
    """The pre-tokens of ``text``; together they are the whole text."""
    return (_SPLIT_ASCII if text.isascii() else _SPLIT_ANY).findall(text)


class RankQueue:
    """Positions by merge rank; the lowest rank is found by three find-first-set steps of 64 bits."""

    def __init__(self, ranks: int) -> None:
        words = (ranks >> 6) + 1
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions in text order; the bucket is emptied."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, sorted(self.buckets.pop(rank))


class Encoder(dict):
    """A vocabulary; as a dict it maps the pre-tokens met so far to their ids."""

    def __init__(self, file: bytes) -> None:
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        self.size = max(self.ranks.values()) + 1
        self.by_id: dict[int, bytes] | None = None

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(piece.encode("utf-8", "replace")))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [ranks.get(raw[i : i + 2]) for i in range(n - 1)] + [None]
        queue = RankQueue(self.size)
        for i, rank in enumerate(pair):
            if rank is not None:
                queue.push(rank, i)
        while (lowest := queue.pop()) is not None:
            rank, positions = lowest
            for k, i in enumerate(positions):
                if pair[i] != rank or part[i] is None:
                    continue  # stale
                j = after[i]
                part[i] += part[j]
                part[j] = pair[j] = None
                after[i] = m = after[j]
                if m < n:
                    before[m] = i
                    pair[i] = new = ranks.get(part[i] + part[m])
                    if new is not None:
                        queue.push(new, i)
                else:
                    pair[i] = new = None
                h, old = before[i], None
                if h >= 0:
                    pair[h] = old = ranks.get(part[h] + part[i])
                    if old is not None:
                        queue.push(old, h)
                if min(rank if new is None else new, rank if old is None else old) < rank:
                    for left in positions[k + 1 :]:
                        queue.push(rank, left)
                    break
        return [ranks[p] for p in part if p is not None]

    def bytes_of(self, token: int) -> bytes:
        """The bytes of an id."""
        if self.by_id is None:
            self.by_id = {v: k for k, v in self.ranks.items()}
        return self.by_id[token]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, split(text))))


_encoders: dict[int, Encoder] = {}


def encoder(file: bytes) -> Encoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    key = hash(file)
    if key not in _encoders:
        _encoders[key] = Encoder(file)
    return _encoders[key]


def read_vocabulary(path: str | None) -> bytes:
    """The vocabulary file, read on the driver; under 2 MB whatever the data's size."""
    with open(path or tokenizer_path(), "rb") as f:
        return f.read()


def list_array(lists: list, kind: pa.DataType) -> pa.Array:
    """Lists of integers as one Arrow column, by a single flat buffer."""
    ends = np.cumsum([0, *map(len, lists)])
    flat = np.fromiter(chain.from_iterable(lists), dtype=kind.to_pandas_dtype(), count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row (``id_col``, ``ids`` ARRAY<INT>) for each row of ``df``, without special tokens.

    Strings that look like special tokens are ordinary text. Null text and empty text both give an
    empty list; blank text is encoded as it is. A null id stays null, repeated rows come out as often
    as they came in, and an empty table gives an empty result. No shuffle; texts of any length are
    encoded whole. ``vocabulary`` is the path of a rank file, by default that of ``byte_bpe_50k``.
    """
    file = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = df.select(id_col).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1) + ", ids array<int>"

    def run(batches):
        enc = encoder(file.value)
        for batch in batches:
            ids = [enc.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(ids, pa.int32())], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
