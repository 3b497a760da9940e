"""Cutting oversized texts at natural boundaries, with overlap (problem 8).

Structure-tree packing: the text is the root of a tree whose levels are headings, blocks between
blank lines (a fenced block is one block), lines and list items, sentences, pre-tokens and, only for
a pre-token that is itself too long, tokens. A node within the limit is never opened; the pieces that
come out of an oversized node are merged with their siblings, bottom-up, as long as they fit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, read_vocabulary, split

#: Tokens a piece may gain when it is encoded alone, as its overlap may begin inside a pre-token.
SLACK = 8

_HEADING = re.compile(r"^(#{1,6})[ \t]+\S|^[^\s].*\n(?==+\s*$|-{3,}\s*$)|^<h([1-6])\b|^(?=commit [0-9a-f]{7,40}$)", re.M | re.I)
_FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"')\]»”]*\s+|[。！？]+[」』]*\s*|[;:]\s+")


def _fences(text: str) -> list[tuple[int, int]]:
    """Spans of fenced blocks; one that is never closed runs to the end."""
    at = [m.start() for m in _FENCE.finditer(text)]
    return [(a, (at[k + 1] + 3) if k + 1 < len(at) else len(text)) for k, a in list(enumerate(at))[::2]]


def _headings(text: str) -> dict[int, int]:
    """Level by offset of the headings outside fenced blocks."""
    fences = _fences(text)
    starts = [a for a, _ in fences]
    found = {}
    for m in _HEADING.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if k < 0 or m.start() >= fences[k][1]:
            found[m.start()] = len(m.group(1)) if m.group(1) else int(m.group(2) or 1)
    return found


def _cuts(text: str, level: int, headings: dict[int, int], fences: list[tuple[int, int]]) -> list[int]:
    """Offsets at which a node of ``level`` is divided: 1-6 headings, 7 blocks, 8 lines, 9 sentences."""
    if level <= 6:
        return sorted(p for p, depth in headings.items() if depth == level)
    if level == 7:
        starts = [a for a, _ in fences]
        inside = lambda p: (k := bisect_right(starts, p) - 1) >= 0 and starts[k] < p < fences[k][1]
        return sorted({p for m in _BLANK.finditer(text) if not inside(p := m.end())} | {a for a, _ in fences})
    if level == 8:
        return [m.end() for m in re.finditer(r"\r\n|[\n\r\v\f  ]", text)]
    return [m.end() for m in _SENTENCE.finditer(text)]


class _Document:
    """A text, where its pre-tokens begin, and how many tokens precede each."""

    def __init__(self, text: str, enc) -> None:
        self.text, self.enc = text, enc
        pieces = split(text)
        self.pieces = pieces
        self.start = np.cumsum([0, *map(len, pieces)])
        self.ids = [enc[p] for p in pieces]
        self.before = np.cumsum([0, *map(len, self.ids)])
        self.total = int(self.before[-1])
        self.levels: dict[int, list[int]] = {}
        self.headings, self.fences = _headings(text), _fences(text)

    def boundaries(self, level: int) -> list[int]:
        """Pre-token numbers at which ``level`` cuts; a cut inside a pre-token moves to its start."""
        if level not in self.levels:
            offsets = _cuts(self.text, level, self.headings, self.fences)
            self.levels[level] = sorted({int(np.searchsorted(self.start, o, "right")) - 1 for o in offsets})
        return self.levels[level]

    def size(self, a: int, b: int) -> int:
        return int(self.before[b] - self.before[a])

    def pack(self, a: int, b: int, limit: int, first: int, level: int = 1) -> list[tuple[int, int]]:
        """Spans of pre-tokens [a, b), each within ``limit`` (the text's first within ``first``) unless it is a single longer pre-token."""
        if self.size(a, b) <= (limit if a else first) or b - a == 1:
            return [(a, b)]
        if level <= 9:
            own = self.boundaries(level)
            inner = own[bisect_right(own, a) : bisect_left(own, b)]
            if not inner:
                return self.pack(a, b, limit, first, level + 1)
            edges = [a, *inner, b]
            children = [s for x, y in zip(edges, edges[1:]) for s in self.pack(x, y, limit, first, level + 1)]
        else:
            children = [(k, k + 1) for k in range(a, b)]
        merged = [children[0]]
        for x, y in children[1:]:
            if self.size(merged[-1][0], y) <= (limit if merged[-1][0] else first):
                merged[-1] = (merged[-1][0], y)
            else:
                merged.append((x, y))
        return merged

    def offset(self, token: int) -> tuple[int, int]:
        """The offset of ``token`` and its number, moved back to where a character begins."""
        k = min(int(np.searchsorted(self.before, token, "right")) - 1, len(self.pieces) - 1)
        if token >= self.total:
            return len(self.text), self.total
        inside = token - int(self.before[k])
        raw = self.pieces[k].encode("utf-8", "replace")
        ends = np.cumsum([0, *(len(self.enc.bytes_of(i)) for i in self.ids[k])]) if inside else [0]
        while inside and raw[ends[inside]] & 0xC0 == 0x80:
            inside -= 1
        return int(self.start[k]) + len(raw[: ends[inside]].decode("utf-8", "replace")), int(self.before[k]) + inside


def split_text(text: str, enc, max_tokens: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """(begin, end, tokens, natural) of each piece; begin and end are code points of ``text``."""
    if len(text) * 4 <= max_tokens or len(text.encode("utf-8", "replace")) <= max_tokens:
        return [(0, len(text), -1, True)]
    doc = _Document(text, enc)
    if doc.total <= max_tokens:
        return [(0, len(text), doc.total, True)]
    limit = max_tokens - overlap - SLACK
    cores: list[tuple[int, bool]] = []  # first token of each piece without its overlap
    for a, b in doc.pack(0, len(doc.pieces), limit, max_tokens):
        first, last = int(doc.before[a]), int(doc.before[b])
        cores.append((first, True))
        while last - first > (limit if first else max_tokens):
            room = limit if first else max_tokens - SLACK
            _, cut = doc.offset(first + room)
            first = cut if cut > first else min(first + room, last)
            cores.append((first, False))
    if len(cores) > 1 and cores[1][0] <= overlap:
        del cores[0]  # the second piece's overlap would hold all of the first
        cores[0] = (0, True)
    out = []
    for k, (first, natural) in enumerate(cores):
        last = cores[k + 1][0] if k + 1 < len(cores) else doc.total
        end = doc.offset(last)[0]
        whole = k + 1 == len(cores) or cores[k + 1][1]  # ends with a pre-token
        begin, count = _begin(doc, first, end, overlap, max_tokens) if k else (0, last if whole else len(enc.encode(text[:end])))
        out.append((begin, end, count, natural))
    return out


def _begin(doc: _Document, first: int, end: int, overlap: int, max_tokens: int) -> tuple[int, int]:
    """Where a piece begins whose own tokens begin at ``first``, and its tokens when it is encoded alone.

    A piece that begins inside a pre-token may take more tokens alone. Then a few tokens more of overlap are
    tried, as one that begins with a pre-token takes no more; only if none fits is the overlap cut down.
    """
    for more in [*range(SLACK + 1), *range(-1, -overlap - 1, -1)]:
        begin = doc.offset(max(0, first - overlap - more))[0]
        count = len(doc.enc.encode(doc.text[begin:end]))
        if count <= max_tokens:
            return begin, count
    return doc.offset(first)[0], count


def split_oversized(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 1000,
    overlap: int = 100,
    vocabulary: str | None = None,
    with_text: bool = True,
) -> DataFrame:
    """Pieces of at most ``max_tokens`` tokens: (id, piece_no, n_pieces, begin_char, end_char, n_tokens, natural, piece).

    Consecutive pieces share ``overlap`` tokens of the whole text's encoding (up to three more where a
    character would be split). ``natural`` is false where a piece had to begin inside a pre-token.
    A text within the limit is one piece, whose ``n_tokens`` is null if counting was not needed; blank
    text is one piece; null and empty text give no piece. Rows with a null id are cut as well, repeated
    rows come out as often as they came in. No shuffle.
    """
    if not 0 <= overlap < max_tokens - SLACK:
        raise ValueError("overlap must be at least 0 and smaller than max_tokens")
    file = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    schema = f"{id_col} {id_type}, piece_no int, n_pieces int, begin_char bigint, end_char bigint, n_tokens int, natural boolean"
    schema += ", piece string" if with_text else ""

    def run(batches):
        enc = encoder(file.value)
        for batch in batches:
            source, rows = [], []
            texts = batch.column(1).to_pylist()
            for k, text in enumerate(texts):
                pieces = split_text(text, enc, max_tokens, overlap) if text else []
                for no, (begin, end, count, natural) in enumerate(pieces):
                    source.append(k)
                    rows.append((no, len(pieces), begin, end, None if count < 0 else count, natural, text[begin:end] if with_text else None))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)][: 7 if with_text else 6]
            names = [id_col, "piece_no", "n_pieces", "begin_char", "end_char", "n_tokens", "natural", "piece"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *arrays], names[: len(arrays) + 1])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1000, overlap: int = 100, vocabulary: str | None = None) -> DataFrame:
    """Ids of the texts that had to be cut: a text over the limit always gives two pieces or more."""
    pieces = split_oversized(df, id_col, text_col, max_tokens, overlap, vocabulary, with_text=False)
    return pieces.filter((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select(id_col)
