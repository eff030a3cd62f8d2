"""Periodic runs of words: recursive splitting at rare words, then a scan over lags of what is left."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tabsieve.llm.batches import map_rows

#: A run has at least so many words and so many periods, so each of its words occurs that many times in it.
LEAST_WORDS = 6
LEAST_PERIODS = 4


def surviving_segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches ``[start, end)`` in which every word occurs ``LEAST_PERIODS`` times at least.

    A word that occurs fewer times inside its segment can be in no run of that segment and splits it; the
    parts are counted anew until none changes. All open segments are counted together in each round; a
    segment that did not change is done.
    """
    done, at, segment = [], np.arange(len(ids)), np.zeros(len(ids), np.int64)
    while len(at):
        order = np.lexsort((ids[at], segment))
        s, w = segment[order], ids[at][order]
        first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])]))
        counts = np.diff(np.append(first, len(order)))
        often = np.empty(len(order), bool)
        often[order] = np.repeat(counts >= LEAST_PERIODS, counts)
        changed = np.zeros(segment[-1] + 1, bool)
        changed[segment[~often]] = True
        for part in np.flatnonzero(~changed).tolist():
            low, high = np.searchsorted(segment, [part, part + 1])
            done.append((int(at[low]), int(at[high - 1]) + 1))
        stay = often & changed[segment]
        at, old = at[stay], segment[stay]
        if not len(at):
            break
        starts = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (old[1:] != old[:-1])])
        number = np.cumsum(starts) - 1
        wide = np.bincount(number) >= LEAST_WORDS
        at, number = at[wide[number]], number[wide[number]]
        segment = (np.cumsum(wide) - 1)[number]
    return sorted(done)


def _same_ahead(ids: np.ndarray, i: int, lag: int) -> int:
    """First position from ``i`` on whose word differs from the one ``lag`` later."""
    end, step = len(ids) - lag, 16
    while i < end:
        stop = min(i + step, end)
        differ = ids[i:stop] != ids[i + lag:stop + lag]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = stop, step * 4
    return end


def _same_behind(ids: np.ndarray, i: int, lag: int) -> int:
    """First position of the stretch around ``i`` in which words equal those ``lag`` later."""
    step = 16
    while i > 0:
        low = max(i - step, 0)
        differ = (ids[low:i] != ids[low + lag:i + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, step = low, step * 4
    return 0


def lag_scan(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of one segment.

    A run of period q repeats over at least three whole blocks of q words, so it holds three neighbouring
    multiples of q whose words equal those q later. Only multiples are compared for each lag, n / q of them; the
    stretches that pass are followed to both ends. Lags come in ascending order, and what lies inside a
    known run has a smaller period and is passed over.
    """
    n, runs = len(ids), []
    far = np.zeros(n, np.int64)  # farthest end of a known run that holds the position
    for q in range(1, n // LEAST_PERIODS + 1):
        marks = ids[::q]
        same = marks[1:] == marks[:-1]
        k = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
        if not len(k):
            continue
        k = k[far[k] < k + 3 * q + 1]
        for j in {1, q // 3, q // 2, q - 1} if q > 1 else ():
            k = k[ids[k + j] == ids[k + j + q]]
        past = 0
        for i in k.tolist():
            if i < past:
                continue
            past = _same_ahead(ids, i, q)
            start = _same_behind(ids, i, q)
            length = past - start + q
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q) and far[start] < past + q:
                runs.append((start, length, q))
                far[start:past + q] = np.maximum(far[start:past + q], past + q)
    return runs


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """All maximal runs ``(start, length, period)`` of ``words``, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) * LEAST_PERIODS > len(words) and np.bincount(ids).max() < LEAST_PERIODS:
        return []
    return sorted((start + low, length, q) for low, high in surviving_segments(ids) for start, length, q in lag_scan(ids[low:high]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that some run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, q in runs:
        drop[start + q:start + length] = True
    return [w for w, d in zip(words, drop.tolist()) if not d]


def periodic_runs(df: DataFrame, id_col: str, text_col: str, edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``id_col, runs array<struct<start, length, period>>, collapsed`` per row of ``df``.

    Words are the stretches between ASCII white space of the whole text. A run is a stretch with smallest
    period q and at least ``max(6, 4 q)`` words that no neighbour extends; runs come by start, then period.
    ``collapsed`` is the text with one period left of each run, words joined by one space. ``edit`` may change
    the words of a row first. Null and empty texts have no runs and an empty text; null ids and repeated rows
    stay rows of their own; an empty table gives an empty table; other columns are ignored, whatever their
    names. Each text is one unit of work, in memory in proportion to its words.
    """
    def row(doc_id, text):
        words = (text or "").encode().split()
        if edit is not None:
            words = edit(doc_id, words)
        runs = find_runs(words)
        return [(doc_id, [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(kept_words(words, runs)).decode())]

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), f"`{id_col}` {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string", lambda: row)
