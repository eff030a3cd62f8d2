"""Histogram sort: exact byte counts below candidate boundaries, refined until the splitters fit, then one exchange.

DataFrame functions only. Rows are ordered by ``(k1, k2)``, two longs; ``k2`` is a hash that spreads the
rows of one ``k1``. Splitters name a key and, inside the identical rows of one key, a number of copies,
so that no key is too hot to be cut.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsieve.llm.batches import boxed
from tabsieve.session import materialise, partitions

#: Cells of the first histogram, of the first one inside a single ``k1``, and most cells of a later round.
FIRST_CELLS, KEY_CELLS, ROUND_CELLS = 1 << 12, 1 << 6, 1 << 16
#: Identical rows that one task numbers.
COPY_BLOCK = 1 << 14
#: Hashes are cut to 62 bits, so that sums of two stay in range.
HASH_BITS = 62


def hash62(*columns: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH_BITS)


@dataclass
class Splitter:
    """First key of the right side; ``copies`` identical rows of that key stay on the left."""
    k1: int
    k2: int
    copies: int
    bytes_below: int
    rows_below: int


@dataclass
class _Cell:
    below: int
    rows_below: int
    bytes: int
    rows: int
    lo1: int
    hi1: int
    lo2: int
    hi2: int


def _div(column: str, width: int) -> Column:
    return F.expr(f"{column} div {width}L")


def _cells(df: DataFrame, by: list[str]) -> list[tuple]:
    return df.groupBy(*by).agg(F.sum("size"), F.count(F.lit(1)), F.min("k1"), F.max("k1"), F.min("k2"), F.max("k2")).collect()


def _stack(cells: list[tuple], below: int, rows_below: int) -> list[_Cell]:
    out = []
    for c in sorted(cells, key=lambda c: (c[-4], c[-2])):
        out.append(_Cell(below, rows_below, *c[-6:]))
        below, rows_below = below + c[-6], rows_below + c[-5]
    return out


def find_splitters(keys: DataFrame, targets: list[int], slack: int) -> tuple[list[Splitter], int, int]:
    """Splitters whose bytes below come within ``slack`` of each (ascending) target, with total bytes and rows.

    ``keys`` is a stored table ``k1, k2, size``; ``k2`` is at least 0. Every round is one aggregate over
    the rows of the open cells; the driver gets at most some ``ROUND_CELLS`` cells plus two per target.
    A cell that is a single key is cut inside its identical rows; equal targets give equal splitters.
    """
    ends = keys.agg(F.min("k1"), F.max("k1"), F.sum("size"), F.count(F.lit(1))).first()
    if not ends[3]:
        return [], 0, 0
    width1 = max(1, (ends[1] - ends[0]) // FIRST_CELLS + 1)
    width2 = max(1, (1 << HASH_BITS) // KEY_CELLS)
    done: dict[int, Splitter] = {}
    stacks = {None: _stack(_cells(keys.withColumn("g1", _div("k1", width1)), ["g1"]), 0, 0)}
    waiting = {None: list(range(len(targets)))}
    while waiting:
        open_cells: dict[tuple, tuple[_Cell, list[int]]] = {}
        for parent, mine in waiting.items():
            stack, at = stacks[parent], 0
            for t in mine:
                while at + 1 < len(stack) and stack[at + 1].below <= targets[t]:
                    at += 1
                c = stack[at]
                end = c.below + c.bytes
                lone1, lone = c.lo1 == c.hi1, c.lo1 == c.hi1 and c.lo2 == c.hi2
                left, right = targets[t] - c.below, end - targets[t]
                if lone and c.rows > 1 and min(left, right) > slack:
                    n = min(c.rows - 1, max(1, round(left * c.rows / c.bytes)))
                    done[t] = Splitter(c.lo1, c.lo2, n, c.below + n * (c.bytes // c.rows), c.rows_below + n)
                elif lone or min(left, right) <= slack:
                    if left <= right:
                        done[t] = Splitter(c.lo1, c.lo2 if lone1 else 0, 0, c.below, c.rows_below)
                    else:
                        after = (c.lo1, c.hi2 + 1) if lone1 else (c.hi1 + 1, 0)
                        done[t] = Splitter(*after, 0, end, c.rows_below + c.rows)
                else:
                    open_cells.setdefault((c.lo1, c.lo2 if lone1 else -1), (c, []))[1].append(t)
        if not open_cells:
            break
        fan = max(2, ROUND_CELLS // len(open_cells))
        rows = []
        for i, (c, _) in enumerate(open_cells.values()):
            lone1 = c.lo1 == c.hi1
            lo, hi = (c.lo2, c.hi2) if lone1 else (c.lo1, c.hi1)
            fresh = lone1 and c.lo2 // width2 != c.hi2 // width2  # the first look inside one k1 takes the fixed cells, on which later joins meet
            rows.append({"i": i, "g1": _trunc(c.lo1, width1),
                         "g2": -1 if not lone1 or fresh else c.lo2 // width2, "lo": lo, "hi": hi,
                         "k": c.lo1 if lone1 else None, "w": width2 if fresh else max(1, (hi - lo) // min(fan, FIRST_CELLS) + 1)})
        shape = "array<struct<i:int,g1:long,g2:long,lo:long,hi:long,k:long,w:long>>"
        table = keys.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), shape)))
        found: dict[int, list[tuple]] = {}
        gridded = keys.withColumn("g1", _div("k1", width1))
        parts = []
        if any(r["g2"] == -1 for r in rows):
            inside = F.when(F.col("k").isNull(), F.col("k1").between(F.col("lo"), F.col("hi"))).otherwise(F.col("k1") == F.col("k"))
            parts.append(gridded.join(F.broadcast(table.where("g2 = -1").drop("g2")), "g1").where(inside))
        if any(r["g2"] >= 0 for r in rows):
            near = table.where("g2 >= 0").drop("g1").withColumnRenamed("k", "k1")
            parts.append(keys.withColumn("g2", _div("k2", width2)).join(F.broadcast(near), ["k1", "g2"])
                         .where(F.col("k2").between(F.col("lo"), F.col("hi"))).withColumn("k", F.col("k1")))
        for part in parts:
            cut = F.when(F.col("k").isNull(), F.expr("k1 div w")).otherwise(F.expr("k2 div w"))
            for cell in _cells(part.withColumn("_cut", cut), ["i", "_cut"]):
                found.setdefault(cell[0], []).append(cell)
        stacks, waiting = {}, {}
        for i, (c, mine) in enumerate(open_cells.values()):
            stacks[i], waiting[i] = _stack(found[i], c.below, c.rows_below), mine
    return [done[t] for t in range(len(targets))], ends[2], ends[3]


def _trunc(a: int, b: int) -> int:
    return abs(a) // b * (1 if a >= 0 else -1)


def range_of(splitters: list[Splitter], k1: Column, k2: Column, copy: Column) -> Column:
    """Number of splitters at or below a row's place: a binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    shape = "array<struct<k1:long,k2:long,c:long>>"
    table = F.from_json(F.lit(json.dumps([{"k1": s.k1, "k2": s.k2, "c": s.copies} for s in splitters])), shape)
    place = F.struct(k1.alias("k1"), k2.alias("k2"), copy.cast("long").alias("c"))
    steps = len(splitters).bit_length() + 1

    def step(state, _):
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        right = F.get(table, mid) <= place
        closed = state["lo"] >= state["hi"]
        return F.struct(F.when(closed, state["lo"]).when(right, mid + 1).otherwise(state["lo"]).alias("lo"),
                        F.when(closed | right, state["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lo"])


def histogram_shards(df: DataFrame, id_col: str, text_col: str, shards: int, tolerance: float = 0.001) -> DataFrame:
    """All columns of ``df`` and ``size, shard, slot``: shards of near equal bytes in the order of (text hash, row hash).

    ``size`` is the UTF-8 length of the text (null: 0) plus 1. Equal texts are neighbours, and only a
    group across a boundary is split. A shard differs from its share by ``tolerance`` of it or by the
    largest single row. Slots are gapless from 0. Nulls, ties and repeated rows are rows like others;
    existing columns named ``size``, ``shard`` or ``slot`` are replaced, all others stay, whatever their names;
    an empty table gives an empty table.
    The text is exchanged once; the probing rounds read two hashes and a size per row.
    """
    columns = [c for c in df.columns if c not in ("size", "shard", "slot")]
    own = df.select(*[F.col(f"`{c}`") for c in columns])
    rows = own.select(boxed(own), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("_size"),
                      hash62(F.col(text_col)).alias("_k1"), hash62(*[F.col(f"`{c}`") for c in columns]).alias("_k2"))
    keys = materialise(rows.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("_size").alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    each = max(1, -(-partitions(df.sparkSession) // shards))
    n = shards * each
    targets = [total * j // n for j in range(1, n)]
    splitters, _, _ = find_splitters(keys, targets, int(min(total / shards * tolerance, total / n / 8)))
    hot = sorted({(s.k1, s.k2) for s in splitters if s.copies})
    parts = rows.withColumn("_copy", F.lit(0).cast("long"))
    if hot:
        # Copies of a key that a splitter cuts: identical rows fold into one with a count, and unfold with a number each.
        cut = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"_k1": a, "_k2": b} for a, b in hot])),
                                                                   "array<struct<_k1:long,_k2:long>>")))
        folded = rows.join(F.broadcast(cut), ["_k1", "_k2"], "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_k1", "_k2").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        blocks = (folded.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                  .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPY_BLOCK}L")))).repartition("_k1", "_k2", "_b"))
        first = F.col("_b") * COPY_BLOCK
        copies = blocks.withColumn("_copy", F.explode(F.sequence(first, F.least(first + COPY_BLOCK, F.col("_n")) - 1)))
        copies = copies.withColumn("_copy", F.col("_copy") + F.col("_from"))
        parts = (rows.join(F.broadcast(cut), ["_k1", "_k2"], "left_anti").withColumn("_copy", F.lit(0).cast("long"))
                 .unionByName(copies.drop("_n", "_from", "_b")))
    starts = [0] + [s.rows_below for s in splitters] if splitters else [0]
    shard_of = lambda p: F.floor(p / each).cast("int")
    first_row = F.get(F.from_json(F.lit(json.dumps(starts)), "array<long>"), F.col("_part"))
    shard_row = F.get(F.from_json(F.lit(json.dumps(starts[::each])), "array<long>"), F.col("shard"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_k1", "_k2", "_copy")) - 1
    return (parts.withColumn("_part", range_of(splitters, F.col("_k1"), F.col("_k2"), F.col("_copy")))
            .withColumn("_inside", inside).withColumn("shard", shard_of(F.col("_part")))
            .select("row.*", F.col("_size").alias("size"), "shard", (first_row + F.col("_inside") - shard_row).cast("long").alias("slot")))
