"""Greedy string tiling over words by running Karp-Rabin matching (problems 4 and 7)."""

from __future__ import annotations

import numpy as np

from .words import rolling


#: Pairs of seeds made at a time.
PAIRS = 1 << 22


def meetings(hashes: np.ndarray, keys: np.ndarray):
    """Where hashes of a text occur among sorted ``keys``: arrays (position in the text, index of the key), in parts.

    A repetitive text meets a repetitive pattern at very many places; they are never held all at once.
    """
    low, high = (np.searchsorted(keys, hashes, side) for side in ("left", "right"))
    counts = high - low
    near = np.flatnonzero(counts)
    edge = np.cumsum(counts[near])
    begin = 0
    while begin < len(near):
        end = max(begin + 1, int(np.searchsorted(edge, (edge[begin - 1] if begin else 0) + PAIRS, "right")))
        some = near[begin:end]
        n = counts[some]
        at = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield np.repeat(some, n), at
        begin = end


def diagonals(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Seeds (i, j) as rows (i - j, i, seeds in a row along the diagonal)."""
    order = np.lexsort((i, i - j))
    d, i = (i - j)[order], i[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])
    return np.stack([d[first], i[first], np.diff(np.r_[first, len(i)])], axis=1)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of :func:`diagonals` of several parts, those that continue each other made one."""
    if len(parts) == 1:
        return parts[0]
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    follows = np.r_[False, (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1] + rows[:-1, 2])]
    first = np.flatnonzero(~follows)
    return np.stack([rows[first, 0], rows[first, 1], np.add.reduceat(rows[:, 2], first)], axis=1)


def tiles(text: list, pattern: list, text_hashes: np.ndarray, pattern_hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs (text position, pattern position, length) of ``least`` words or more.

    Seeds are runs of ``least`` words with equal rolling hash, confirmed word by word. The longest
    match still free is marked first, then the next, until none of ``least`` words is left; so a
    passage whose parts were reordered is covered by several tiles.
    """
    keys = rolling(pattern_hashes, least)
    order = np.argsort(keys, kind="stable")
    parts = [diagonals(i, order[at]) for i, at in meetings(rolling(text_hashes, least), keys[order])]
    return mark(text, pattern, joined(parts), least) if parts else []


def mark(text: list, pattern: list, runs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles from seeds given as rows of :func:`diagonals`; see :func:`tiles`. It ends when the pattern has no room left."""
    matches = []
    for d, i, m in runs.tolist():
        j, n = i - d, m + least - 1
        if text[i : i + n] == pattern[j : j + n]:
            matches.append((n, i, j))
        else:  # unequal words of equal hash
            k = 0
            while k < n:
                e = k
                while e < n and text[i + e] == pattern[j + e]:
                    e += 1
                if e - k >= least:
                    matches.append((e - k, i + k, j + k))
                k = e + 1
    found, used_text, used_pattern = [], bytearray(len(text)), bytearray(len(pattern))
    room, free_run = True, b"\0" * least
    queue = sorted(matches, key=lambda m: (-m[0], m[1], m[2]))
    while queue and room:
        shorter = []
        top = queue[0][0]
        for n, i, j in queue:
            if n < top and shorter:
                shorter.append((n, i, j))
                continue
            free, k = [], 0
            while k < n:  # longest free stretches of this match
                s = k
                while k < n and not used_text[i + k] and not used_pattern[j + k]:
                    k += 1
                if k - s >= least:
                    free.append((k - s, i + s, j + s))
                k += 1
            if free and free[0][0] == n:
                used_text[i : i + n] = used_pattern[j : j + n] = b"\1" * n
                found.append((i, j, n))
                room = free_run in used_pattern and free_run in used_text
                if not room:
                    break
            else:
                shorter += free
        queue = sorted(shorter, key=lambda m: (-m[0], m[1], m[2]))
    return sorted(found)
