"""Evaluation texts that leaked into a corpus (problem 7)."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiling import diagonals, joined, mark, meetings
from .words import HASHES, raw_words, rolling

#: Words of evaluation text sent to the executors at a time, 16 bytes each and the words themselves; more
#: are handled in further blocks, each with a scan of its own.
BLOCK_WORDS = 4_000_000
_BITS = 22


class _Index:
    """Rolling hashes of evaluation passages that are searched by runs of ``least`` words: a bitmap and a sorted array.

    It is built once and broadcast as it is.
    """

    def __init__(self, passages: list[tuple[int, str, list[bytes]]], least: int) -> None:
        self.passages, self.least = passages, least
        hashes = [rolling(HASHES.array(ws), least) for _, _, ws in passages]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(passages)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else owner
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner, self.place = flat[order], owner[order].astype(np.int32), place[order].astype(np.int32)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(flat >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def seeds(self, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """Seeds by passage, as rows of :func:`.tiling.diagonals`."""
        near = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for at, k in meetings(hashes[near], self.keys) if len(near) else ():
            owner, i, j = self.owner[k], near[at], self.place[k].astype(np.int64)
            order = np.argsort(owner, kind="stable")
            owner, i, j = owner[order], i[order], j[order]
            edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                found[int(owner[a])].append(diagonals(i[a:b], j[a:b]))
        return {p: joined(parts) for p, parts in found.items()}


def leaked_passages(
    corpus: DataFrame,
    items: DataFrame,
    corpus_id: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    passage_cols: tuple[str, ...] = ("instruction", "expected_output"),
    min_words: int = 12,
    min_coverage: float = 0.0,
) -> DataFrame:
    """Passages of ``items`` found in ``corpus``: (doc id, item id, passage, longest, tiles, covered, coverage).

    One row for each text and passage that share ``min_words`` consecutive words or more, whatever
    stands between the words, and whose tiles cover at least ``min_coverage`` of the passage. The tiles
    come from greedy string tiling, so a passage given in parts or in another order is seen as a whole.
    A passage shorter than ``min_words`` words is searched as a whole if it has any word.

    The evaluation side is a query set against all rows: up to ``BLOCK_WORDS`` words of it, whatever their
    passages' lengths, are sent out for one scan of the corpus, which is never shuffled. Null and empty
    texts or passages match nothing; repeated rows of the corpus come out as often as they came in; repeated
    items count once. Other columns of either table are ignored.
    """
    schema = (
        f"{corpus_id} {corpus.select(corpus_id).schema[0].dataType.simpleString()}, "
        f"{item_id} {items.select(item_id).schema[0].dataType.simpleString()}, "
        "passage string, longest int, tiles int, covered int, coverage double"
    )
    source = corpus.select(corpus_id, text_col)
    item_type = {"int": pa.int32(), "bigint": pa.int64()}.get(items.select(item_id).schema[0].dataType.simpleString(), pa.string())

    def scan(block):
        """One pass over the corpus for passages by the run of words that each is searched by."""
        shared = corpus.sparkSession.sparkContext.broadcast([_Index(passages, least) for least, passages in sorted(block.items())])

        def run(batches):
            for batch in batches:
                out = []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    ws = raw_words(text)
                    if not ws:
                        continue
                    hashes = HASHES.array(ws)
                    for index in shared.value:
                        for p, runs in index.seeds(rolling(hashes, index.least)).items():
                            item, name, passage = index.passages[p]
                            found = mark(ws, passage, runs, index.least)
                            covered = sum(n for _, _, n in found)
                            if found and covered >= min_coverage * len(passage):
                                out.append((k, item, name, max(n for _, _, n in found), len(found), covered, covered / len(passage)))
                cols = list(zip(*out)) if out else [[]] * 7
                kinds = [item_type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                arrays = [pa.array(c, t) for c, t in zip(cols[1:], kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *arrays], [corpus_id, item_id, "passage", "longest", "tiles", "covered", "coverage"])

        return source.mapInArrow(run, schema)

    parts: list[DataFrame] = []
    block: dict[int, list] = defaultdict(list)
    filled = 0
    for row in items.select(item_id, *passage_cols).filter(F.col(item_id).isNotNull()).dropDuplicates().toLocalIterator():
        for name in passage_cols:
            ws = raw_words(row[name])
            if ws:
                block[min(len(ws), min_words)].append((row[item_id], name, ws))
                filled += len(ws)
            if filled >= BLOCK_WORDS:
                parts.append(scan(block))
                block, filled = defaultdict(list), 0
    if block or not parts:
        parts.append(scan(block))
    return reduce(DataFrame.unionByName, parts)
