"""Packing of token sequences: large pieces pair greedily, small ones best-fit the gaps that remain.

The packing is planned on the number of pieces per length, which the capacity bounds, never on single
pieces; every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsieve.llm.batches import boxed
from tabsieve.llm.token_counts import encoded_slices
from tabsieve.session import broadcast_if, materialise

#: Pieces of one length that are numbered within one group.
RANK_GROUP = 20_000


def token_pieces(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int = 0,
                 with_ids: bool = False, slice_chars: int = 16_000_000) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` (and ``ids``): each text's ids and ``end_id``, cut at ``capacity``.

    Only documents longer than ``capacity`` are cut. A null or empty text is the end id alone. Null ids and
    repeated rows stay; other columns are ignored; an empty table gives an empty table.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def emit(values, text, parts, numbers):
        ids = (numbers if parts is None else parts.join(numbers)).astype("<u4").tobytes() + end
        for k, start in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[start:start + 4 * capacity]
            made = values[0], k, start // 4, len(part) // 4, zlib.crc32(part)
            yield (*made, np.frombuffer(part, "<u4").tolist()) if with_ids else made

    kind = df.schema[id_col].dataType.simpleString()
    return encoded_slices(df, [id_col, text_col], path,
                          f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids, emit, slice_chars)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges ``(length, first_rank, n, first_bin, offset)`` that place every piece counted in ``counts``.

    Pieces above a third of the capacity: the longest takes the longest partner that still fits beside it,
    so that a bin holds at most two. Smaller pieces, longest first, each go to the smallest gap that holds
    them. Equal lengths are interchangeable, so equal bins are handled together: the work depends on the
    number of lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: Counter[int] = Counter()
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def put(length: int, n: int, first_bin: int, offset: int) -> None:
        out.append((length, used[length], n, first_bin, offset))
        used[length] += n

    def open_gap(gap: int, first_bin: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first_bin, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    rising = large[::-1]
    for length in large:
        while left[length]:
            k = bisect.bisect_right(rising, capacity - length) - 1
            while k >= 0 and not (left[rising[k]] - (rising[k] == length) > 0):
                k -= 1
            if k < 0:
                n = left[length]
                put(length, n, bins, 0)
                left[length] = 0
                open_gap(capacity - length, bins, n)
            else:
                other = rising[k]
                n = left[length] // 2 if other == length else min(left[length], left[other])
                put(length, n, bins, 0)
                put(other, n, bins, length)
                left[length] -= n
                left[other] -= n
                open_gap(capacity - length - other, bins, n)
            bins += n
        rising = [x for x in rising if left[x]]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[length]
        while todo:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                each = capacity // length
                n = max(1, todo // each)
                open_gap(capacity, bins, n)
                bins += n
                continue
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            each = gap // length
            full = min(n, todo // each)
            for i in range(each if full else 0):
                put(length, full, first, capacity - gap + i * length)
            open_gap(gap - each * length, first, full)
            todo -= full * each
            first, n = first + full, n - full
            if n and 0 < todo < each:
                for i in range(todo):
                    put(length, 1, first, capacity - gap + i * length)
                open_gap(gap - todo * length, first, 1)
                todo, first, n = 0, first + 1, n - 1
            open_gap(gap, first, n)
    return out


def rank_within(df: DataFrame, key: str, order: list[Column], group: int = RANK_GROUP) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each ``key``, numbering at most about ``group`` rows in one place."""
    most = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    cells = max(1, -(-most // group))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    per_cell = dealt.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = per_cell.select(key, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(*order)) - 1
    return (dealt.withColumn("_inside", inside).join(first, [key, "_cell"])
            .withColumn("rank", (F.col("_first") + F.col("_inside")).cast("long")).drop("_cell", "_inside", "_first"))


def pack(pieces: DataFrame, order: list[str], capacity: int, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``order`` should tell rows apart; rows equal in it are interchangeable. ``pieces`` is read several
    times and must be a stored table, or be as deterministic as one. Offsets of a sequence are gapless
    from 0; sequence numbers are gapless from 0. An empty table gives an empty table. Columns
    ``sequence_id`` and ``offset`` of the input are replaced, all others stay, whatever their names.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count(F.lit(1))).collect()}  # one row per length: at most ``capacity``
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    ranges = plan(counts, capacity)
    shape = "array<struct<l:int,r:long,n:long,b:long,o:int>>"
    # Ranges longer than a block are cut at block borders, so that a rank finds its range by equality on the block.
    block = max(1, max(counts.values(), default=1) // 4096)
    placed = (spark.range(1).select(F.explode(F.array(*[F.lit(json.dumps([dict(zip("lrnbo", x)) for x in ranges[i:i + 20_000]]))
                                                        for i in range(0, len(ranges), 20_000)] or [F.lit("[]")])).alias("j"))
              .select(F.inline(F.from_json("j", shape)))
              .withColumn("_block", F.explode(F.sequence(F.expr(f"r div {block}"), F.expr(f"(r + n - 1) div {block}")))))
    n_placed = sum((r + n - 1) // block - r // block + 1 for _, r, n, _, _ in ranges)
    keys = [f"_order{i}" for i in range(len(order))]
    rows = pieces.select(boxed(pieces), F.col(length).cast("int").alias("l"), *[F.col(c).alias(k) for c, k in zip(order, keys)])
    ranked = rank_within(rows, "l", [F.col(k) for k in keys]).withColumn("_block", F.expr(f"rank div {block}"))
    inside = (F.col("rank") >= F.col("r")) & (F.col("rank") < F.col("r") + F.col("n"))
    joined = ranked.join(broadcast_if(placed, n_placed * 64), ["l", "_block"]).where(inside)
    return joined.select("row.*", (F.col("b") + F.col("rank") - F.col("r")).alias("sequence_id"), F.col("o").cast("long").alias("offset"))


def pack_documents(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int, with_ids: bool = False,
                   slice_chars: int = 16_000_000) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place; see ``token_pieces`` and ``pack``.

    Null ids and repeated rows are documents of their own; other columns are ignored; an empty table gives an
    empty table. A task holds some ``slice_chars`` characters at a time: fewer take less memory and more time.
    """
    pieces = materialise(token_pieces(df, id_col, text_col, path, capacity, with_ids=with_ids, slice_chars=slice_chars))
    return pack(pieces, [id_col, "piece", "ids_crc32"], capacity)
