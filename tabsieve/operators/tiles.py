"""Spatial tiles: the shared machinery behind every neighbour computation.

Rows are cut into compact tiles of bounded size by median splits learnt from a
bounded sample (the sample only shapes the layout, never a result). A small table
of tile boxes decides which tile pairs can matter; only those pairs are joined,
and each pair is evaluated as one array block. What leaves a block is already
reduced (counts, sums, k best, component roots), so no list of row pairs is ever
shuffled. Exact copies are folded into one weighted point beforehand.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.session import BROADCAST_BYTES, materialise, partitions

MAX_TILES = 131_072         # bounds the box table that tasks hold in memory
MAX_TILE_ROWS = 1_024       # preferred tile size; grows only past MAX_TILES tiles
SAMPLE_PER_TILE = 24
MAX_SAMPLE_CELLS = 4_000_000  # numbers the driver may hold to learn the splits
LEAF_ROWS = 32              # rows of a block that are pruned together
LEAF_DIMS = 8               # with more columns boxes of leaves overlap and prune nothing
GROUP_TILES = 64            # neighbouring tiles of a that share what is sent of b
SLACK = 1e-9                # box tests are loosened so that rounding never prunes a true pair

TILE_SCHEMA = ("tile int, n long, weight double, lo array<double>, hi array<double>, "
               "ids binary, x binary, w binary, tag binary")


@dataclass
class Tiles:
    df: DataFrame
    dims: int
    rows: int
    tags: int = 0
    n_tiles: int = 1

    @property
    def bytes(self) -> int:
        return self.rows * 8 * (self.dims + 2 + self.tags)


@dataclass
class Block:
    """One unpacked tile."""

    tile: int
    ids: np.ndarray
    x: np.ndarray
    w: np.ndarray
    tag: np.ndarray
    note: bytes = b""


def fold_copies(df: DataFrame, id_col: str, features: Sequence[str], tags: Sequence[str] = ()) -> DataFrame:
    """One weighted point per distinct vector: ``pid`` is the smallest id among its copies.

    A null feature has no distance to anything: the job fails and names the column (impute or drop such rows first).
    """
    keys = [F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"feature {c} is null in some row: impute or drop nulls first")).cast("double"))
            .alias(f"_x{i}") for i, c in enumerate(features)]
    keys += [F.col(c).cast("double").alias(f"_t{i}") for i, c in enumerate(tags)]
    names = [f"_x{i}" for i in range(len(features))] + [f"_t{i}" for i in range(len(tags))]
    return (df.select(F.col(id_col).cast("long").alias("_id"), *keys)
            .groupBy(*names).agg(F.min("_id").alias("pid"), F.count(F.lit(1)).alias("copies")))


def _split_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    dim = np.zeros(2 ** depth - 1, dtype=np.int64)
    cut = np.full(2 ** depth - 1, np.inf)
    parts = {0: sample}
    for node in range(2 ** depth - 1):
        rows = parts.pop(node, sample[:0])
        if len(rows):
            j = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            dim[node], cut[node] = j, np.median(rows[:, j])
            left = rows[:, j] <= cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = rows[left], rows[~left]
    return dim, cut


def build_tiles(points: DataFrame, dims: int, tags: int = 0, id_col: str = "pid",
                weight: str = "copies", max_tile_rows: int = MAX_TILE_ROWS) -> Tiles:
    """``points`` carries ``_x0…``, optional ``_t0…``, an id and a weight; keep it materialised."""
    spark = points.sparkSession
    n = points.count()
    limit = max(min(max_tile_rows, math.ceil(n / (2 * partitions(spark))) or 1), 128, math.ceil(n / MAX_TILES))
    leaves = max(1, math.ceil(n / limit))
    depth = math.ceil(math.log2(leaves)) if leaves > 1 else 0
    xs = F.array(*[F.col(f"_x{i}") for i in range(dims)])
    packed = points.select(F.col(id_col).cast("long").alias("pid"), F.col(weight).cast("double").alias("copies"),
                           xs.alias("x"),
                           (F.array(*[F.col(f"_t{i}") for i in range(tags)]) if tags
                            else F.array().cast("array<double>")).alias("t"))
    if depth:
        wanted = min(SAMPLE_PER_TILE * 2 ** depth, MAX_SAMPLE_CELLS // dims)
        picked = packed.select("x").sample(fraction=min(1.0, 1.5 * wanted / n), seed=7).limit(wanted).collect()
        dim, cut = _split_tree(np.array([r.x for r in picked], dtype=float).reshape(-1, dims), depth)

        @F.pandas_udf("int")
        def leaf_of(x: pd.Series) -> pd.Series:
            m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, dims))
            node = np.zeros(len(m), dtype=np.int64)
            for _ in range(depth):
                right = m[np.arange(len(m)), dim[node]] > cut[node]
                node = 2 * node + 1 + right
            return pd.Series(node - (2 ** depth - 1))

        leafed = packed.withColumn("leaf", leaf_of("x"))
    else:
        leafed = packed.withColumn("leaf", F.lit(0))
    leafed = materialise(leafed)
    # A leaf the sample misjudged is cut further, so every tile stays bounded.
    sizes = leafed.groupBy("leaf").count().orderBy("leaf").collect()
    pieces = {r["leaf"]: max(1, math.ceil(r["count"] / (2 * limit))) for r in sizes}
    starts = dict(zip(pieces, itertools.accumulate([0, *pieces.values()])))
    layout = spark.createDataFrame([(k, pieces[k], starts[k]) for k in pieces] or [(0, 1, 0)],
                                   "leaf int, pieces int, start int")
    tiled = (leafed.join(F.broadcast(layout), "leaf")
             .withColumn("tile", (F.col("start") + F.pmod(F.xxhash64("pid"), F.col("pieces"))).cast("int"))
             .select("tile", "pid", "copies", "x", "t"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid")
        x = np.stack(rows["x"].to_numpy()).astype(float)
        w = rows["copies"].to_numpy(dtype=float)
        t = np.stack(rows["t"].to_numpy()).astype(float)
        return pd.DataFrame([{
            "tile": int(rows["tile"].iloc[0]), "n": len(rows), "weight": float(w.sum()),
            "lo": x.min(axis=0), "hi": x.max(axis=0),
            "ids": rows["pid"].to_numpy(dtype=np.int64).tobytes(), "x": x.tobytes(),
            "w": w.tobytes(), "tag": t.tobytes()}])

    return Tiles(materialise(tiled.groupBy("tile").applyInPandas(pack, TILE_SCHEMA)), dims, n, tags,
                 max(1, sum(pieces.values())))


def _box_span(lo_a, hi_a, lo_b, hi_b, metric):
    """Smallest and largest possible distance from box a to every box in b."""
    gap = np.maximum(0.0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    far = np.maximum(np.abs(hi_b - lo_a), np.abs(hi_a - lo_b))
    if metric == "manhattan":
        return gap.sum(axis=1), far.sum(axis=1)
    return np.sqrt((gap ** 2).sum(axis=1)), np.sqrt((far ** 2).sum(axis=1))


def tile_pairs(a: Tiles, b: Tiles, metric: str = "euclidean", reach: float | None = None, k: int | None = None,
               reach_of_b: bool = False, nearest_too: bool = False) -> DataFrame:
    """Tile pairs (i, j) that can matter, with their nearest and farthest distance.

    ``reach``: pairs within that distance, and with ``nearest_too`` the nearest one where none is. ``k``: pairs able to hold one of the k
    nearest rows. ``reach_of_b``: each tile of b reaches as far as its largest
    first tag. None of them: every pair (for sums over the whole table).
    """
    spark = a.df.sparkSession
    boxes = b.df.select("tile", "weight", "lo", "hi", *([] if not reach_of_b else ["tag", "n"])).orderBy("tile")
    if reach_of_b:
        tags = b.tags

        def radii(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["r"] = [float(np.frombuffer(v).reshape(-1, tags)[:, 0].max()) for v in pdf["tag"]]
                yield pdf[["tile", "weight", "lo", "hi", "r"]]

        boxes = boxes.mapInPandas(radii, "tile int, weight double, lo array<double>, hi array<double>, r double")
    # At most 2 * MAX_TILES boxes exist, whatever the table size.
    got = boxes.toPandas().sort_values("tile")
    same = a is b
    shared = spark.sparkContext.broadcast({
        "tile": got["tile"].to_numpy(), "weight": got["weight"].to_numpy(dtype=float),
        "lo": np.stack(got["lo"].to_numpy()) if len(got) else np.zeros((0, a.dims)),
        "hi": np.stack(got["hi"].to_numpy()) if len(got) else np.zeros((0, a.dims)),
        "r": got["r"].to_numpy(dtype=float) if reach_of_b else None})

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box = shared.value
        for pdf in batches:
            for tile, lo, hi in zip(pdf["tile"], pdf["lo"], pdf["hi"]):
                near, far = _box_span(np.asarray(lo), np.asarray(hi), box["lo"], box["hi"], metric)
                keep = np.ones(len(near), dtype=bool)
                if reach is not None:
                    keep = near <= reach * (1 + SLACK)
                    if nearest_too and len(near) and not keep.any():
                        keep[np.argmin(near)] = True
                elif box["r"] is not None:
                    keep = near <= box["r"] * (1 + SLACK)
                elif k is not None and len(far):
                    order = np.argsort(far)
                    enough = np.searchsorted(np.cumsum(box["weight"][order]), k)
                    if enough < len(order):
                        keep = near <= far[order[enough]] * (1 + SLACK)
                if same:
                    near = np.where(box["tile"] == tile, -1.0, near)  # a tile meets itself first
                yield pd.DataFrame({"i": np.int32(tile), "j": box["tile"][keep].astype(np.int32),
                                    "near": near[keep], "far": far[keep], "w_j": box["weight"][keep]})

    return (a.df.select("tile", "lo", "hi").repartition(min(partitions(spark), a.n_tiles), "tile")
            .mapInPandas(match, "i int, j int, near double, far double, w_j double"))


def _unpack(row, side: str, dims: int, tags: int) -> Block | None:
    ids = getattr(row, f"{side}_ids")
    if ids is None:
        return None
    ids = np.frombuffer(ids, dtype=np.int64)
    return Block(int(row.i if side == "a" else row.j), ids,
                 np.frombuffer(getattr(row, f"{side}_x")).reshape(len(ids), dims),
                 np.frombuffer(getattr(row, f"{side}_w")),
                 np.frombuffer(getattr(row, f"{side}_tag")).reshape(len(ids), tags), getattr(row, f"{side}_note", b""))


def fold_groups(a: Tiles, b: Tiles, pairs: DataFrame, start: Callable, step: Callable, finish: Callable,
                schema: str, group_tiles: int = GROUP_TILES) -> DataFrame:
    """``fold_pairs`` for steps that take the tiles of b in any order.

    A tile of b too large to be broadcast travels once to each group of ``group_tiles`` tiles of a instead of once to
    each tile; tiles with adjacent numbers lie side by side, so groups share most of their partners. A task holds
    one group of tiles and their states, and one tile of b at a time.
    """
    if b.bytes <= BROADCAST_BYTES:
        return fold_pairs(a, b, pairs, start, step, finish, schema)
    pay = ["ids", "x", "w", "tag"]
    n = min(partitions(a.df.sparkSession), math.ceil(a.n_tiles / group_tiles))
    group = F.floor(F.col("i") / group_tiles).cast("int")
    if "payload" not in pairs.columns:
        pairs = pairs.withColumn("payload", F.lit(True))
    met = pairs.groupBy(group.alias("g"), "j").agg(
        F.max("payload").alias("payload"), F.collect_list(F.struct("i", "near", "far", "w_j", "payload")).alias("m"))
    right = b.df.select(F.col("tile").alias("j"), *[F.col(c).alias(f"b_{c}") for c in pay])
    sent = met.where("payload").join(right, "j").unionByName(met.where("not payload"), allowMissingColumns=True)
    own = a.df.select(F.floor(F.col("tile") / group_tiles).cast("int").alias("g"), F.lit(-1).alias("j"),
                      F.array(F.struct(F.col("tile").alias("i"), F.lit(0.0).alias("near"), F.lit(0.0).alias("far"),
                                       F.lit(0.0).alias("w_j"), F.lit(False).alias("payload"))).alias("m"),
                      *[F.col(c).alias(f"b_{c}") for c in pay])
    # the tiles of a group come before its partners
    rows = own.unionByName(sent.drop("payload")).repartition(n, "g").sortWithinPartitions("g", "j")
    ad, at, bd, bt = a.dims, a.tags, b.dims, b.tags

    def close(held):
        for block, state in held.values():
            out = finish(state, block)
            if out is not None and len(out):
                yield out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, {}
        for pdf in batches:
            for g, j, m, ids, x, w, tag in zip(pdf["g"], pdf["j"], pdf["m"], *[pdf[f"b_{c}"] for c in pay]):
                if g != current:
                    yield from close(held)
                    current, held = g, {}
                if j < 0:
                    block = _block(m[0]["i"], ids, x, w, tag, ad, at)
                    held[block.tile] = block, start(block)
                    continue
                other = None if ids is None else _block(j, ids, x, w, tag, bd, bt)
                for p in m:
                    block, state = held[int(p["i"])]
                    made = step(state, block, other if p["payload"] else None, p["near"], p["far"], p["w_j"])
                    if made is not None and len(made):
                        yield made
        yield from close(held)

    return rows.mapInPandas(run, schema)


def _block(tile, ids, x, w, tag, dims: int, tags: int) -> Block:
    ids = np.frombuffer(ids, dtype=np.int64)
    x = np.frombuffer(x) if len(x) == 8 * dims * len(ids) else np.frombuffer(x, dtype=np.float32).astype(float)
    return Block(int(tile), ids, x.reshape(len(ids), dims), np.frombuffer(w), np.frombuffer(tag).reshape(len(ids), tags))


def shortened(tiles: Tiles) -> Tiles:
    """Tiles for ``fold_groups`` whose values travel as four bytes each where that loses nothing, tile by tile."""
    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, packed in enumerate(pdf["x"]):
                x = np.frombuffer(packed)
                with np.errstate(over="ignore"):
                    half = x.astype(np.float32)
                if (half == x).all():
                    pdf.iat[at, pdf.columns.get_loc("x")] = half.tobytes()
            yield pdf

    columns = ["tile", "ids", "x", "w", "tag"]
    short = tiles.df.select(*columns).mapInPandas(shorten, "tile int, ids binary, x binary, w binary, tag binary")
    return Tiles(materialise(short), tiles.dims, tiles.rows, tiles.tags, tiles.n_tiles)


def fold_pairs(a: Tiles, b: Tiles, pairs: DataFrame, start: Callable, step: Callable, finish: Callable,
               schema: str) -> DataFrame:
    """Stream every tile of a past its partner tiles of b, nearest first.

    ``start(A)`` opens a state, ``step(state, A, B, near, far, w_j)`` updates it
    (B is None where the pair row carries no payload) and may return rows at once,
    and ``finish(state, A)`` returns the rows for that tile. One tile plus its state is held at a time.
    A column ``note`` of the tiles of a reaches its blocks as it is.
    """
    spark = a.df.sparkSession
    pay = ["ids", "x", "w", "tag"]
    own = pay + [c for c in ("note",) if c in a.df.columns]
    n = min(partitions(spark), a.n_tiles)  # a task holds at least one tile
    left = a.df.select(F.col("tile").alias("i"), *[F.col(c).alias(f"a_{c}") for c in own])
    right = b.df.select(F.col("tile").alias("j"), *[F.col(c).alias(f"b_{c}") for c in pay])
    need, bare = pairs, None
    if "payload" in pairs.columns:
        need, bare = pairs.where("payload").drop("payload"), pairs.where("not payload").drop("payload")
    if b.bytes <= BROADCAST_BYTES:
        rows = need.repartition(n, "i").join(F.broadcast(right), "j")
    else:
        # the payload of b travels once, straight to the task that holds tile i
        rows = need.join(right, "j").repartition(n, "i")
    if bare is not None:
        rows = rows.unionByName(bare, allowMissingColumns=True).repartition(n, "i")
    rows = rows.join(F.broadcast(left) if a.bytes <= BROADCAST_BYTES else left, "i")
    rows = rows.select("i", "j", "near", "far", "w_j", *[f"a_{c}" for c in own], *[f"b_{c}" for c in pay])
    rows = rows.sortWithinPartitions("i", "near", "j")
    ad, at, bd, bt = a.dims, a.tags, b.dims, b.tags

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if current is None or current.tile != int(row.i):
                    if current is not None:
                        out = finish(state, current)
                        if out is not None and len(out):
                            yield out
                    current = _unpack(row, "a", ad, at)
                    state = start(current)
                made = step(state, current, _unpack(row, "b", bd, bt), row.near, row.far, row.w_j)
                if made is not None and len(made):
                    yield made
        if current is not None:
            out = finish(state, current)
            if out is not None and len(out):
                yield out

    return rows.mapInPandas(run, schema)


def block_distance(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances between two blocks, accumulated column by column (no cancellation)."""
    acc = np.zeros((len(x), len(y)))
    diff = np.empty_like(acc)
    for j in range(x.shape[1]):
        np.subtract(x[:, j, None], y[None, :, j], out=diff)
        acc += np.abs(diff, out=diff) if metric == "manhattan" else np.multiply(diff, diff, out=diff)
    return acc if metric == "manhattan" else np.sqrt(acc, out=acc)


def leaf_boxes(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Row numbers of a block in compact leaves, by halving along the widest column, with the boxes of the leaves."""
    parts, leaves = [np.arange(len(x))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= LEAF_ROWS or x.shape[1] > LEAF_DIMS:
            leaves.append(rows)
            continue
        v, half = x[rows], len(rows) // 2
        order = np.argpartition(v[:, int(np.argmax(v.max(axis=0) - v.min(axis=0)))], half)
        parts += [rows[order[half:]], rows[order[:half]]]
    return leaves, np.stack([x[rows].min(axis=0) for rows in leaves]), np.stack([x[rows].max(axis=0) for rows in leaves])


def near_entries(x: np.ndarray, y: np.ndarray, reach: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) in row order of all entries that can be among the ``k`` nearest of their row and lie
    within the row's ``reach``; ties at the limit stay. Distances are those of ``block_distance``.

    With many columns a matrix product finds the entries first, its rounding error allowed for.
    """
    product = metric != "manhattan" and x.shape[1] > LEAF_DIMS
    if product:
        middle = y.mean(axis=0)
        u, v = x - middle, y - middle
        uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
        d = uu[:, None] + vv[None, :] - 2 * (u @ v.T)
        slack = 16 * np.finfo(float).eps * (x.shape[1] + 4) * (uu.max() + vv.max() + float((middle * middle).sum()))
        limit = reach ** 2 * (1 + SLACK) + slack
    else:
        d, slack, limit = block_distance(x, y, metric), 0.0, reach
    if d.shape[1] > k and np.count_nonzero(d <= limit[:, None]) > 2 * k * len(x):
        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * slack)
    r, c = np.nonzero(d <= limit[:, None])
    if not product:
        return r, c, d[r, c]
    squares = (x[r] - y[c]) ** 2
    acc = np.zeros(len(r))
    for j in range(x.shape[1]):
        acc += squares[:, j]
    return r, c, np.sqrt(acc)


def distance_strips(x: np.ndarray, y: np.ndarray, metric: str = "euclidean", cells: int = 1 << 17):
    """(row slice, distances) in strips small enough to stay in cache."""
    step = max(1, cells // max(len(y), 1))
    for at in range(0, len(x), step):
        rows = slice(at, min(at + step, len(x)))
        yield rows, block_distance(x[rows], y, metric)


def box_reach(x: np.ndarray, other: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and farthest distance from each row of ``x`` to the bounding box of ``other``."""
    lo, hi = other.min(axis=0), other.max(axis=0)
    gap = np.maximum(0.0, np.maximum(lo - x, x - hi))
    far = np.maximum(np.abs(x - lo), np.abs(x - hi))
    if metric == "manhattan":
        return gap.sum(axis=1), far.sum(axis=1)
    return np.sqrt((gap ** 2).sum(axis=1)), np.sqrt((far ** 2).sum(axis=1))


def rows_in_reach(x: np.ndarray, other: np.ndarray, reach: float, metric: str) -> np.ndarray:
    """Rows of ``x`` that can lie within ``reach`` of some row of ``other``."""
    if not len(x) or not len(other):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(box_reach(x, other, metric)[0] <= reach * (1 + SLACK))


def with_tags(tiles: Tiles, tagged: DataFrame, tags: int) -> Tiles:
    """Replace the tag payload by ``tagged`` (tile, tag), rows in id order."""
    return Tiles(tiles.df.drop("tag").join(tagged, "tile"), tiles.dims, tiles.rows, tags, tiles.n_tiles)
