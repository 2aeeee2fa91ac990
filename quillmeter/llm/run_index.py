"""A run-length index: run-compressed Burrows-Wheeler transform with suffix-array samples at run ends.

The indexed strings end in separators of their own, so that no match goes from one to another.
The suffix order comes from prefix doubling in numpy and is dropped once the runs are made: what is
kept of the transform are heads, first rows, counts of each head's symbol before it, and the text
positions of each run's first and last row. A string that occurs more than once is indexed twice; its
suffixes sort beside their copies, so that the second copy only makes runs longer.

Matching statistics come from this alone:
* of the indexed strings against each other (the longest match of each position elsewhere): at run ends
  the neighbouring samples are compared on bytes; elsewhere the match of a position is that of the
  position before it, one byte shorter, since both rows lie in one run.
* of other strings: these are streamed from right to left, many in step.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # symbols of the first sort, 9 bits each


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _shared(words: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that words' text from a on and others' text from b on have in common, most at most: compared 8 at a time."""
    out = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(most > 0)
    done = 0
    while len(open_):
        differ = words[a[open_] + done] ^ others[b[open_] + done]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        out[open_] = np.minimum(done + same, most[open_])
        done += 8
        open_ = open_[(same == 8) & (most[open_] > done)]
    return out


def _suffix_order(symbol: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    n = len(symbol)
    key, size = symbol, 1
    for more in (1, 2, 3):  # 2, 4 and FIRST symbols, high bits first
        after = np.zeros(n, np.int64)
        after[: n - size] = key[size:] >> (9 * (size - more))
        key, size = (key << (9 * more)) | after, size + more
    left = np.minimum(end_of - np.arange(n), FIRST)  # nothing from behind a string's own separator
    key = key & ~((np.int64(1) << (9 * (FIRST - left))) - 1)
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (ordered[1:] == 0)  # separators differ from one another
    first = np.flatnonzero(new)
    size = np.diff(first, append=n)
    rank = np.empty(n, np.int64)  # the first row of suffixes with the same beginning
    rank[order] = np.repeat(first, size)
    step = FIRST
    open_rows = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_rows):  # only suffixes that still tie are sorted on
        own = order[open_rows]
        key = rank[own] * n + rank[np.minimum(own + step, end_of[own])]
        by = np.argsort(key)
        own, key = own[by], key[by]  # old ties are contiguous rows, and stay on them
        order[open_rows] = own
        new = np.ones(len(own), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(own))
        rank[own] = np.repeat(open_rows[first], size)
        step *= 2
        open_rows = open_rows[np.repeat(size > 1, size)]
    return order


class RunIndex:
    """strings are distinct; twice says which of them have a second copy in the index."""

    def __init__(self, strings: list[bytes], twice: list[bool] | None = None):
        lengths = np.array([len(s) for s in strings])
        copied = [s for s, x in zip(strings, twice or [], strict=False) if x]
        self.strings = len(strings)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        own = int((lengths + 1).sum())
        self.text = np.frombuffer(b"".join(x for s in [*strings, *copied] for x in (s, b"\0")), np.uint8)
        self.n = len(self.text)
        every = np.concatenate([lengths, np.array([len(s) for s in copied], lengths.dtype)])
        ends = np.cumsum(every + 1) - 1
        self.end_of = np.repeat(ends, every + 1)  # by position: its own separator
        self.symbol = self.text.astype(np.int64) + 1
        self.symbol[ends] = 0
        self.words = _words(self.text)
        order = _suffix_order(self.symbol[:own], self.end_of[:own])
        if copied:
            second = np.full(own, -1)
            again = np.flatnonzero(np.repeat(np.array(twice), lengths + 1))
            second[again] = own + np.arange(len(again))
            has = second[order] >= 0
            row = np.cumsum(1 + has) - 1 - has
            both = np.empty(self.n, np.int64)
            both[row] = order
            both[row[has] + 1] = second[order[has]]
            order = both
        self._runs(order)

    def _runs(self, order: np.ndarray) -> None:
        bwt = self.symbol[order - 1]  # the row of position 0 wraps to the last separator
        new = np.ones(self.n, bool)
        new[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)  # separators differ from one another
        first = np.flatnonzero(new)
        self.head, self.first = bwt[first], first
        self.last = np.append(first[1:], self.n) - 1
        size = self.last - first + 1
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.symbol, minlength=257))])[:257]  # first row by symbol
        by_head = np.argsort(self.head, kind="stable")
        before = np.zeros(len(first), np.int64)
        sizes = size[by_head]
        total = np.cumsum(sizes) - sizes
        heads = self.head[by_head]
        group = np.searchsorted(heads, heads)
        before[by_head] = total - total[group]
        self.before = before  # rows of the same symbol in earlier runs
        self.at_first, self.at_last = order[first], order[self.last]  # the samples
        self.by_head, self.run_key = by_head, heads * self.n + first[by_head]

    @property
    def runs(self) -> int:
        return len(self.head)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at positions a and b, compared on bytes."""
        return _shared(self.words, a, self.words, b, np.minimum(self.end_of[a] - a, self.end_of[b] - b))

    def elsewhere(self) -> np.ndarray:
        """By text position: length of the longest string there that starts elsewhere in the index too."""
        between = self.common(self.at_first[1:], self.at_last[:-1])
        out = np.zeros(self.n, np.int64)
        for at, value in ((self.at_first, np.append(0, between)), (self.at_last, np.append(between, 0))):
            known = np.full(self.n, -1)
            known[at] = value
            sampled = np.flatnonzero(known >= 0)  # among them the beginnings of all strings
            since = np.repeat(sampled, np.diff(sampled, append=self.n))
            np.maximum(out, known[since] - (np.arange(self.n) - since), out=out)
        return out

    def repeated(self, length: int) -> np.ndarray:
        """By position of the strings (without second copies): whether its length bytes start elsewhere in the index too."""
        own = int(self.end_of[self.starts[-1]]) + 1 if self.strings else 0
        return self.elsewhere()[:own] >= length

    def _step(self, run: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Row of the preceding symbol's suffix (LF) for rows in runs."""
        return self.begin[self.head[run]] + self.before[run] + row - self.first[run]

    def matching(self, strings: list[bytes]) -> list[np.ndarray]:
        """By string: for each position, a text position whose suffix shares the longest prefix with what follows (-1: none)."""
        lengths = np.array([len(s) for s in strings])
        most = int(lengths.max(initial=0))
        pattern = np.zeros((len(strings), most), np.int64)
        for i, s in enumerate(strings):  # right-aligned: all end together
            pattern[i, most - len(s) :] = np.frombuffer(s, np.uint8).astype(np.int64) + 1
        out = np.full((len(strings), most), -1, np.int64)
        row = np.zeros(len(strings), np.int64)
        at = np.full(len(strings), self.at_first[0], np.int64)
        for k in range(most - 1, -1, -1):
            live = np.flatnonzero(pattern[:, k])
            if not len(live):
                break
            c, r, p = pattern[live, k], row[live], at[live]
            slot = np.searchsorted(self.run_key, c * self.n + r, side="right") - 1  # the last run of c that starts at or before the row
            has_up = (slot >= 0) & (self.head[self.by_head[np.maximum(slot, 0)]] == c)
            up = self.by_head[np.maximum(slot, 0)]
            nxt = np.minimum(slot + 1, self.runs - 1)
            down = self.by_head[nxt]
            has_down = (slot + 1 < self.runs) & (self.head[down] == c)
            inside = has_up & (self.last[up] >= r)
            p_up, p_down = self.at_last[up], self.at_first[down]
            both = has_up & has_down & ~inside
            better = np.zeros(len(live), bool)  # whether the run below shares more
            if both.any():
                better[both] = self.common(p[both], p_down[both]) > self.common(p[both], p_up[both])
            down_it = ~inside & has_down & (~has_up | better)
            up_it = ~inside & has_up & ~down_it
            run = np.where(down_it, down, up)
            r = np.where(inside, r, np.where(down_it, self.first[down], self.last[up]))
            p = np.where(inside, p, np.where(down_it, p_down, p_up))
            found = inside | up_it | down_it
            row[live] = np.where(found, self._step(run, r), 0)
            at[live] = np.where(found, p - 1, self.at_first[0])
            out[live, k] = np.where(found, p - 1, -1)
        return [out[i, most - n :] for i, n in enumerate(lengths)]

    def matched(self, strings: list[bytes], length: int) -> list[np.ndarray]:
        """By string: whether its length bytes from each position on occur in the index, confirmed on bytes."""
        data = np.frombuffer(b"".join(strings), np.uint8)
        begins = np.cumsum([0, *map(len, strings[:-1])])
        at = np.concatenate(self.matching(strings))
        ends = np.repeat(begins + [len(s) for s in strings], [len(s) for s in strings])
        places = np.arange(len(data))
        tried = np.flatnonzero((at >= 0) & (ends - places >= length))
        p = at[tried]
        found = np.zeros(len(data), bool)
        found[tried] = _shared(_words(data), tried, self.words, p, np.minimum(length, self.end_of[p] - p)) >= length
        return [found[b : b + len(s)] for b, s in zip(begins, strings, strict=True)]
