"""Whether a text without a closing mark ends where a sentence ends, learned from sentences that have one."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut_lineage, spread
from .words import mix

#: Words of the longest run looked up, and how often a run must occur to count as evidence.
LONGEST_RUN, LEAST_SEEN = 5, 4
#: Characters whose runs are made at a time, and different runs that a task adds up before it passes them on.
_CHARACTERS, _HELD = 1 << 20, 1 << 20
#: Different tokens that a task remembers.
_TOKENS = 100_000

_TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\s぀-ヿ一-鿿]+")
_TOKEN_OR_LINE = re.compile(r"\n|" + _TOKEN.pattern)
_STOP = re.compile(r"[.!?。！？‽]+[\"'’”»)\]」』*_]*$")
_OUTSIDE = re.compile(r"^[^\w$#]+|[^\w]+$")
_PART = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+")

def shape(token: str) -> str:
    """A token as compared between sentences: names, numbers and addresses by their kind, words in lower case."""
    token = _OUTSIDE.sub("", token)
    if token.isalpha():
        return token.lower() if token[1:].islower() or len(token) == 1 else "A" if token.isupper() else "_"
    if token[:1] in ("$", "#"):
        return f"{token.count('#')}${len(token)}"
    return "0" if token.isdigit() else "_" if token else ""


def last_part(token: str) -> str:
    """The last word within a token: of a name written in camel case or with underscores, its last component."""
    parts = _PART.findall(_OUTSIDE.sub("", token))
    return "_" + parts[-1].lower() if parts else ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


#: Stands before the first word of a sentence; multiplies a run's hash; a key's lowest bit is left free.
_STARTED = np.uint64(_hash("\x02"))
_STEP, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 2)


#: All digits are one where tokens are told apart, as shapes and last parts do not tell them.
_DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))


class _Tokens(dict):
    """Number by token; by number the hashes of its shape and of its last part (0: none), and whether it ends a sentence or a line."""

    def __init__(self) -> None:
        self.shapes, self.parts, self.stops, self.lines = [], [], [], []

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self.shapes)
        own, part = shape(token), last_part(token)
        self.shapes.append(_hash(own) if own else 0)
        self.parts.append(_hash("\x02" + part) if own and part else 0)
        self.stops.append(bool(_STOP.search(token)) and not token.endswith("..."))
        self.lines.append(token == "\n")
        return at


def _run_keys(shapes: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, keys) for runs of one word, two and so on that end with these words, by the words' shapes.

    ``place`` numbers the words of each sentence from 0; the mark before its first word counts as one more.
    """
    out, at = [], np.arange(len(shapes))
    key = mix(shapes)
    for n in range(1, LONGEST_RUN + 1):
        out.append((at, key & _EVEN))
        more = place[at] >= n - 1
        at, key = at[more], key[more]
        before = np.where(place[at] >= n, shapes[at - n], _STARTED)
        key = mix(key * _STEP + before)
    return out


def _observed(texts: list[str], tokens: _Tokens) -> np.ndarray:
    """A number for every word of sentences that end with a mark and every run of words that ends with it.

    Its upper 63 bits are the key of the run, or of the word's last part; its lowest says that the sentence ended there.
    """
    flat = "\n".join([*texts, ""]).encode("utf-8", "replace").translate(_DIGITS).decode()
    found = np.fromiter(map(tokens.__getitem__, _TOKEN_OR_LINE.findall(flat)), np.int64)
    if not len(found):
        return np.empty(0, np.uint64)
    stop, line = np.array(tokens.stops, bool)[found], np.array(tokens.lines, bool)[found]
    edge = stop | line
    following = np.minimum.accumulate(np.where(edge, np.arange(len(found)), len(found) - 1)[::-1])[::-1]
    shapes, parts = np.array(tokens.shapes, np.uint64)[found], np.array(tokens.parts, np.uint64)[found]
    kept = np.flatnonzero(stop[following] & (shapes != 0))  # what follows a line's last mark is left out
    sentence = (np.cumsum(edge) - edge)[kept]
    first = np.r_[True, sentence[1:] != sentence[:-1]][: len(kept)]
    at = np.arange(len(kept))
    place = at - np.maximum.accumulate(np.where(first, at, 0)) if len(kept) else at
    ended, parts = stop[kept].astype(np.uint64), parts[kept]
    rows = [key | ended[word] for word, key in _run_keys(shapes[kept], place)]
    return np.concatenate([*rows, (parts & _EVEN | ended)[parts != 0]])


def _asked(line: str) -> list[int]:
    """What the verdict on a line's end asks for: the key of its last part, 0 if it has none, and of runs, the longest first."""
    tokens = _TOKEN.findall(line)
    if not tokens:
        return []
    shapes: list[int] = []
    for token in tokens:
        if own := shape(token):
            shapes.append(_hash(own))
        if _STOP.search(token) and token is not tokens[-1]:
            shapes = []
    part = last_part(tokens[-1])
    known = [_hash("\x02" + part) & int(_EVEN) if part else 0]
    if not shapes:
        return known
    runs = _run_keys(np.array(shapes[-LONGEST_RUN:], np.uint64), np.arange(min(len(shapes), LONGEST_RUN)) + max(0, len(shapes) - LONGEST_RUN))
    return known + [int(key[-1]) for at, key in reversed(runs) if len(at) and at[-1] == min(len(shapes), LONGEST_RUN) - 1]


class EndModel:
    """Shares of runs of words at which sentences end, by hash of the run."""

    def __init__(self, keys: np.ndarray, shares: np.ndarray) -> None:
        self.keys, self.shares = keys, shares

    def share(self, key: int) -> float | None:
        at = int(np.searchsorted(self.keys, np.uint64(key)))
        return float(self.shares[at]) if at < len(self.keys) and int(self.keys[at]) == key else None

    def ends(self, line: str) -> bool:
        """Whether a sentence can end with the last word of a line.

        The last word, or the last component of a name, has to be known as a whole one; a part of a word
        is not. Then the longest run of words before the end that occurs often enough decides: sentences
        end there more often than they go on.
        """
        part, *runs = _asked(line) or [0]
        if part and self.share(part) is None:
            return False
        return next((share >= 0.5 for share in map(self.share, runs) if share is not None), False)


class Asking:
    """Stands in for an :class:`EndModel`: says no, and keeps what the last question asks for until it is taken."""

    def __init__(self) -> None:
        self._keys: list[int] | None = None

    def ends(self, line: str) -> bool:
        self._keys = _asked(line)
        return False

    def take(self) -> list[int] | None:
        """The keys as signed numbers, None if nothing was asked since."""
        keys, self._keys = self._keys, None
        return None if keys is None else np.array(keys, np.uint64).view(np.int64).tolist()


def end_runs(df: DataFrame, text_col: str) -> DataFrame:
    """(key, share): how often sentences of a table end at a run of words, of runs that occur ``LEAST_SEEN`` times.

    A word before a full stop, question or exclamation mark is an end, a word before another one is none;
    lines without such a mark are left out. Every text counts; null texts teach nothing. Tasks add up their
    runs, the cluster adds up the tasks'; nothing comes to the driver.
    """

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added():
            codes, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], n[order]
            begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
            return codes[begin], np.add.reduceat(n, begin)

        def passed_on():
            codes, n = held.pop()
            return pa.RecordBatch.from_arrays([pa.array((codes & _EVEN).view(np.int64)), pa.array(n * (codes & np.uint64(1)).astype(np.int64)), pa.array(n)], ["key", "ends", "seen"])

        fresh, tokens = 0, _Tokens()
        for batch in batches:
            texts = [x for x in batch.column(0).to_pylist() if x]
            size = np.cumsum([0, *map(len, texts)]) // _CHARACTERS
            edge = np.flatnonzero(np.diff(size, prepend=-1, append=size[-1] + 1)).tolist()
            for begin, end in zip(edge, edge[1:]):
                tokens = tokens if len(tokens) < _TOKENS else _Tokens()
                codes, n = np.unique(_observed(texts[begin:end], tokens), return_counts=True)
                held.append((codes, n))
                fresh += len(codes)
                if fresh > _HELD:
                    held[:], fresh = [added()], 0
                    if len(held[0][0]) > _HELD // 2:
                        yield passed_on()
        if held:
            held[:] = [added()]
            yield passed_on()

    runs = spread(df.select(text_col)).mapInArrow(count, "key bigint, ends bigint, seen bigint").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))
    return runs.filter(F.col("seen") >= LEAST_SEEN).select("key", (F.col("ends") / F.col("seen")).alias("share"))


def with_verdict(df: DataFrame, asked: str, runs: DataFrame, out: str) -> DataFrame:
    """``df`` with what :meth:`EndModel.ends` says of the keys in ``asked``, false where nothing is asked.

    ``df`` has to be written. Different questions are met with the runs in the cluster, so neither has to fit
    on one machine.
    """
    questions = df.filter(F.col(asked).isNotNull()).select(asked).distinct()
    each = questions.select(asked, F.posexplode(asked).alias("_at", "key"))
    known = each.join(runs, "key", "left").groupBy(asked).agg(
        F.bool_and((F.col("_at") > 0) | (F.col("key") == 0) | F.col("share").isNotNull()).alias("_whole"), F.expr("min_by(share, _at) filter (where _at > 0 and share is not null)").alias("_share")
    )
    ended = cut_lineage(known.filter(F.col("_whole") & (F.col("_share") >= 0.5)).select(F.col(asked).alias("_answered")))
    return df.join(broadcast_if_small(ended, measure=True), F.col(asked) == F.col("_answered"), "left").withColumn(out, F.col("_answered").isNotNull()).drop("_answered")


def fit_ends(df: DataFrame, id_col: str, text_col: str) -> EndModel:
    """The runs of :func:`end_runs` over all rows that have an id, as a model on the driver, 16 bytes each.

    For texts that are judged by another table's sentences; a table's own are judged by :func:`with_verdict`.
    An empty table gives a model that knows no end.
    """
    kept = end_runs(df.filter(F.col(id_col).isNotNull()), text_col).toArrow()
    keys, shares = kept.column(0).to_numpy().view(np.uint64), kept.column(1).to_numpy()
    order = np.argsort(keys)
    return EndModel(keys[order], shares[order])
