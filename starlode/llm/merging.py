"""Byte-pair merges of many words at once, in numpy.

The words of a batch are columns, their symbols rows. A round merges one pair in every word: that of the least rank, the
leftmost of equal ones, which is the order of the tokenizers library. Words are dealt by length, so that columns are
hardly padded, and words without further merges leave the rounds.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

ROW_BITS = 6
#: Symbols of the longest word taken; callers leave longer ones to the library.
LONGEST = (1 << ROW_BITS) - 2
NEVER = np.int64(1 << 62)
#: Symbols that are merged at once, so that the arrays stay in a processor's cache.
CELLS = 1 << 17
WIDTHS = (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 28, LONGEST)


class Merges:
    """Pairs of symbols with the symbol that takes their place, those of the least rank first."""

    def __init__(self, merges: Iterable[tuple[int, int, int]], symbols: int):
        last = {(a, b): (rank, to) for rank, (a, b, to) in enumerate(merges)}
        left, right = (np.array([p[k] for p in last], np.int64) for k in (0, 1))
        rank, to = (np.array([v[k] for v in last.values()], np.int64) for k in (0, 1))
        self.none, self.size = symbols, symbols + 1
        self.to = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.to[rank] = to
        # A table of open addresses, at most an eighth full, with each pair's rank above the row's bits.
        bits = max(4, int(8 * len(last) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER)
        keys = left * self.size + right
        at, rest = self.place(keys), np.arange(len(keys))
        while rest.size:
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[rest[free]]
            done = self.keys[at] == keys[rest]
            self.ranks[at[done]] = rank[rest[done]] << ROW_BITS
            rest, at = rest[~done], at[~done] + 1 & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair above the row's bits, or NEVER."""
        keys = left.astype(np.int64) * self.size + right
        at = self.place(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.ranks[at], NEVER)
        on = np.flatnonzero((met != keys) & (met >= 0))
        at, keys = at[on], keys[on]
        while on.size:
            at = at + 1 & self.mask
            met = self.keys[at]
            hit = met == keys
            out[on[hit]] = self.ranks[at[hit]]
            go = ~hit & (met >= 0)
            on, at, keys = on[go], at[go], keys[go]
        return out

    def merged(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of the words that lie at these places of ``symbols``, word after word, and how many each has."""
        if lengths.max(initial=0) > LONGEST:
            raise ValueError(f"a word of more than {LONGEST} symbols")
        order = np.argsort(lengths, kind="stable")
        edges = np.searchsorted(lengths[order], WIDTHS, side="right").tolist()
        counts, done = np.zeros(len(lengths), np.int64), []
        for first, end, width in zip([0, *edges[:-1]], edges, WIDTHS, strict=True):
            step = CELLS // (width + 2)
            for a in range(first, end, step):
                some = order[a : min(a + step, end)]
                left, counts[some] = self.columns(symbols, starts[some], lengths[some])
                done.append((some, left))
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), np.int32)
        for some, left in done:
            n = counts[some]
            out[np.repeat(ends[some] - np.cumsum(n), n) + np.arange(len(left))] = left
        return out, counts

    def columns(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left, word after word, and how many each word has."""
        rows = np.arange(int(lengths.max()) + 2)[:, None]  # before the first and behind the last there are none
        inside = (rows >= 1) & (rows <= lengths)
        grid = np.full(inside.shape, self.none, np.int32)
        grid[inside] = symbols[(starts + rows - 1)[inside]]
        rank = np.full(inside.shape, NEVER)
        rank[:-1] = self.ranked(grid[:-1].ravel(), grid[1:].ravel()).reshape(-1, grid.shape[1]) | rows[:-1]
        ahead, back = np.broadcast_to(rows + 1, grid.shape).copy(), np.broadcast_to(rows - 1, grid.shape).copy()
        whole, ids = grid, np.arange(grid.shape[1])
        while True:
            best = rank.min(axis=0)
            live = np.flatnonzero(best < NEVER)
            if 2 * live.size <= best.size:
                whole[:, ids] = grid
                if not live.size:
                    break
                grid, rank, ahead, back = (np.take(x, live, axis=1) for x in (grid, rank, ahead, back))
                ids, best = ids[live], best[live]
                live = np.arange(live.size)
            else:
                best = best[live]
            n, row = len(ids), best & LONGEST + 1
            g, r, up, down = grid.reshape(-1), rank.reshape(-1), ahead.reshape(-1), back.reshape(-1)
            here = row * n + live
            gone = up[here] * n + live
            after, before = up[gone], down[here]
            new = self.to[best >> ROW_BITS]
            g[here], g[gone], r[gone] = new, -1, NEVER
            up[here], down[after * n + live] = after, row
            m = len(live)
            both = self.ranked(np.concatenate((g[before * n + live], new)), np.concatenate((new, g[after * n + live])))
            r[before * n + live], r[here] = both[:m] | before, both[m:] | row
        keep = ((whole >= 0) & (whole != self.none)).T
        return whole.T[keep], keep.sum(axis=1)
