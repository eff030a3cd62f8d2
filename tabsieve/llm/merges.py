"""Merge replay: all merges of a vocabulary applied in rank order to many words at once.

The words of a slice of the corpus lie one after the other in one space of positions. An inverted index
from merge rank to positions finds every place a merge applies; a merge updates the touched neighbours
only, and their new pairs enter the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np

_NONE = np.int32(2**31 - 1)
#: Characters that patterns take as a word of their own after letters.
_STOPS = frozenset(",.;:!?)")


class Merges:
    """Pairs of symbol numbers -> rank and merged symbol number."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], rank[order].astype(np.int32)
        self.merged = np.zeros(int(rank.max()) + 1, np.int32)  # pairs of one rank merge into one symbol
        self.merged[rank] = merged

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def replay(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of all words, and how many each word has: lowest rank first, then leftmost.

        ``symbols`` holds the words' first symbols one after the other. A merge can make a pair of lower
        rank than its own while equal pairs of the same word still wait; such words, which trained
        vocabularies hardly give, are merged on their own by ``single``.
        """
        n = len(symbols)
        if not n:
            return symbols.astype(np.int32), np.zeros(len(lengths), np.int64)
        first = symbols
        symbols = symbols.astype(np.int32)
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(lengths)[lengths > 0]
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        rank = np.full(n, _NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        held = inner[rank[inner] < _NONE].astype(np.int32)
        held = held[np.argsort(rank[held], kind="stable")]
        values, starts = np.unique(rank[held], return_index=True)
        index: dict[int, list[np.ndarray]] = {r: [g] for r, g in zip(values.tolist(), np.split(held, starts[1:]))} if len(held) else {}
        queue, odd = list(index), set()
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            groups = index.pop(r, None)
            if groups is None:
                continue
            p = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            p = p[rank[p] == r]
            if not len(p):
                continue
            q = after[p]
            if len(p) > 1 and (clash := np.flatnonzero(q[:-1] == p[1:])).size:
                keep = np.ones(len(p), bool)  # of overlapping equal pairs the left one merges
                for i in clash.tolist():
                    keep[i + 1] = not keep[i]
                p, q = p[keep], q[keep]
            far = after[q]
            if len(p) > 1 and (side := np.flatnonzero(far[:-1] == p[1:])).size:
                # Between two neighbouring merges of this rank a pair (merged, next left part) shows up for a moment.
                between = self.ranks(np.full(len(side), self.merged[r]), symbols[p[side + 1]])
                odd.update(word[p[side[between < r]]].tolist())
            symbols[p] = self.merged[r]
            symbols[q] = -1
            rank[q] = _NONE
            after[p] = far
            inside = far >= 0
            right, beyond = p[inside], far[inside]
            before[beyond] = right
            near = before[p]
            near = near[near >= 0]
            rank[p] = _NONE
            at = np.concatenate([right, near])
            if not len(at):
                continue
            new = self.ranks(symbols[at], symbols[after[at]])
            rank[at] = new
            known = new < _NONE
            if not known.any():
                continue
            at, new = at[known], new[known]
            if (low := new < r).any():
                odd.update(word[at[low]].tolist())
            order = np.argsort(new, kind="stable")
            at, new = at[order], new[order]
            cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
            edges = [0, *cuts.tolist(), len(at)]
            for a, b, v in zip(edges, edges[1:], new[edges[:-1]].tolist()):
                if v in index:
                    index[v].append(at[a:b])
                else:
                    # Groups of a rank come unsorted from many merges, hence the unique above for more than one.
                    index[v] = [np.unique(at[a:b])]
                    heapq.heappush(queue, v)
        if odd:
            return self._with_singles(symbols, first, lengths, odd)
        left = symbols >= 0
        return symbols[left], np.bincount(word[left], minlength=len(lengths))

    def _with_singles(self, symbols, first, lengths, odd):
        at = np.concatenate([[0], np.cumsum(lengths)])
        parts = [self.single(first[a:b]) if w in odd else symbols[a:b][symbols[a:b] >= 0] for w, (a, b) in enumerate(zip(at, at[1:]))]
        return np.concatenate(parts).astype(np.int32), np.array([len(p) for p in parts])

    def single(self, symbols: np.ndarray) -> np.ndarray:
        """One word, merge by merge: the lowest rank, of equal ranks the leftmost."""
        parts = list(map(int, symbols))
        while len(parts) > 1:
            ranks = self.ranks(np.array(parts[:-1]), np.array(parts[1:]))
            i = int(np.argmin(ranks))
            if ranks[i] == _NONE:
                break
            parts[i:i + 2] = [int(self.merged[ranks[i]])]
        return np.array(parts, np.int32)


def in_slices(emit: Callable[[list[tuple], list[str]], Iterable[tuple]], chars: int):
    """Row function for ``map_rows(finish=True)``: gathers rows (…, text) and hands them over by about ``chars`` characters.

    ``emit`` gets the values before the text, and the texts (null as empty).
    """
    state: dict = {"rows": [], "texts": [], "n": 0}

    def row(*values):
        if values:
            state["rows"].append(values[:-1])
            state["texts"].append(values[-1] or "")
            state["n"] += len(state["texts"][-1])
            if state["n"] < chars:
                return
        rows, texts = state["rows"], state["texts"]
        state.update(rows=[], texts=[], n=0)
        if rows:
            yield from emit(rows, texts)
    return row


class Numbering(dict):
    """Piece -> number in order of first appearance; texts become arrays of numbers in one pass."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n

    def of(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int32, len(pieces))


class Parts:
    """Rows of numbers of different lengths, stored one after the other."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts = flat, counts.astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def join(self, rows: np.ndarray) -> np.ndarray:
        """The chosen rows one after the other."""
        n = self.counts[rows]
        ends = np.cumsum(n)
        if not len(n) or not ends[-1]:
            return self.flat[:0]
        return self.flat[np.arange(int(ends[-1])) + np.repeat(self.starts[rows] - (ends - n), n)]

    def merged(self, rows: np.ndarray, sizes: np.ndarray) -> Parts:
        """Rows put together: the first ``sizes[0]`` of ``rows`` become one, and so on."""
        ends = np.concatenate([[0], np.cumsum(self.counts[rows])])
        at = np.concatenate([[0], np.cumsum(sizes)])
        return Parts(self.join(rows), ends[at[1:]] - ends[at[:-1]])


def cut_all(pieces: Iterable[str], cut: Callable[[str], list[str]], head: str = "") -> tuple[Numbering, np.ndarray, np.ndarray]:
    """Words of all pieces: their numbering, the words' numbers piece by piece, and how many each piece has.

    Pieces of letters only, or of letters and one stop, are cut without the pattern; ``head`` may stand
    before the letters.
    """
    words, flat, sizes = Numbering(), [], []
    for p in pieces:
        body = p[1:] if head and p[:1] == head else p
        if body.isalpha():
            flat.append(words[p])
            sizes.append(1)
        elif p[-1:] in _STOPS and body[:-1].isalpha():
            flat.append(words[p[:-1]])
            flat.append(words[p[-1]])
            sizes.append(2)
        else:
            found = cut(p)
            flat.extend([words[w] for w in found])
            sizes.append(len(found))
    return words, np.array(flat, np.int64), np.array(sizes, np.int64)
