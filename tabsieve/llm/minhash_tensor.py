"""Near-duplicates by MinHash with tensored banding; every link is confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tabsieve.llm.batches import map_rows
from tabsieve.operators.components import connected_components
from tabsieve.session import broadcast_if, materialise, spread_join, spread_lookup

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
#: Distinct words whose hash a worker remembers.
CACHE_ENTRIES = 150_000
#: Classes, and shingles of all its classes, that one verification block holds about.
BLOCK_MEMBERS = 200
BLOCK_SHINGLES = 400_000
#: Classes of a neighbourhood that all its others meet first.
PIVOTS = 24
#: Members of a bucket up to which its pairs are listed instead of its blocks.
LISTED_MEMBERS = 12


class WordHashes(dict):
    """Word -> 64-bit hash; a full memory starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text, A-Z lower-cased.

    Fewer words make one shingle of the whole sequence; no words make no shingle.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    ids = np.fromiter(map(hashes.__getitem__, words), _U, n)
    out = np.full(max(1, n - width + 1), min(n, width), _U)
    for k in range(min(n, width)):
        out = (out ^ ids[k:k + len(out)]) * _GOLD
        out ^= out >> _U(32)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Sketcher:
    """Two collections of ``half_keys`` small band hashes of ``rows`` minima each."""

    def __init__(self, half_keys: int, rows: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        n = 2 * half_keys * rows
        self.shape, self.odd = (2, half_keys, rows), draw.integers(0, 1 << 63, n, dtype=_U) * _U(2) + _U(1)
        self.add = draw.integers(0, 1 << 63, n, dtype=_U)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """32-bit minima under each hash; the full 64-bit product decides."""
        out = np.empty(len(self.odd), _U)
        for i, (a, b) in enumerate(zip(self.odd, self.add)):
            out[i] = ((shingles ^ b) * a).min()
        return (out >> _U(33)).astype(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, width: int, half_keys: int, rows: int) -> DataFrame:
    """``id, text_md5, n_shingles, cls, cls2, minima`` per row.

    ``cls, cls2`` are 128 bits of a digest of the whole shingle set, so rows of one set share them; null for empty sets.
    """
    def make():
        hashes, sketcher = WordHashes(), Sketcher(half_keys, rows)

        def row(doc_id, text, digest) -> Iterable[tuple]:
            found = shingle_set(text, hashes, width)
            if not len(found):
                return [(doc_id, digest, 0, None, None, None)]
            cls = np.frombuffer(hashlib.md5(found.tobytes()).digest(), np.int64)
            return [(doc_id, digest, len(found), *cls.tolist(), sketcher.minima(found).tolist())]
        return row

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(F.col(id_col), F.col(text_col), F.md5(text_col)),
                    f"`{id_col}` {kind}, text_md5 string, n_shingles long, cls long, cls2 long, minima array<int>", make)


def half_hashes(half_keys: int, rows: int):
    """The band hashes of both collections, one array; the first ``half_keys`` are of the first collection."""
    return F.array(*[F.xxhash64(F.lit(i), *[F.get("minima", F.lit(i * rows + r)) for r in range(rows)]) for i in range(2 * half_keys)])


def table_keys(half_keys: int):
    """Keys of the tables a class can meet others in: each of its shared ``halves`` of the first collection with each of the second."""
    first, second = F.filter("halves", lambda h: h["slot"] < half_keys), F.filter("halves", lambda h: h["slot"] >= half_keys)
    return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a["half"], b["half"]))))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``(g1, g2)`` of sorted batches."""
    parts, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        g1, g2 = batch.column("g1").to_numpy(), batch.column("g2").to_numpy()
        cuts = [0, *(np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1).tolist(), len(g1)]
        for low, high in zip(cuts, cuts[1:]):
            key = (g1[low], g2[low])
            if parts and key != last:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts = []
            parts.append(batch.slice(low, high - low))
            last = key
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _open_pairs(group: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the left and the right side of a group, and the pairs of them that may be new links.

    Those of different components within the exact size bound whose sketches agree in half of what the threshold
    expects: at similarity 0.85 fewer than 14 of 32 equal minima have a chance of about 1e-8.
    """
    side = group.column("side").to_numpy()
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    n, comp = (group.column(c).to_numpy() for c in ("n", "comp"))
    minima = group.column("minima").combine_chunks().flatten().to_numpy().reshape(len(side), -1)
    n_left, n_right = n[left][:, None], n[right][None, :]
    may = (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(n_left, n_right) >= percent * np.maximum(n_left, n_right))
    if may.any():
        same = np.zeros(may.shape, np.uint16)
        for k in range(minima.shape[1]):
            same += minima[left, k][:, None] == minima[right, k][None, :]
        may &= 200 * same.astype(np.int64) >= percent * minima.shape[1]
    return left, right, may


def common_counts(a: list[np.ndarray], b: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of ``a`` and ``b`` where ``wanted``, as bit rows over the shingles of both sides."""
    counts = np.zeros(wanted.shape, np.int64)
    if wanted.sum() <= 2 * (len(a) + len(b)):
        for i, j in np.argwhere(wanted).tolist():
            counts[i, j] = len(np.intersect1d(a[i], b[j], assume_unique=True))
        return counts
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)

    def placed(sets):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        at, row = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    (at_a, row_a), (at_b, row_b) = placed(a), placed(b)
    for low in range(0, len(both), 1 << 15):
        width = min(1 << 15, len(both) - low)

        def bits(at, row, n):
            first, last = np.searchsorted(at, [low, low + width])
            field = np.zeros((n, -(-width // 64) * 64), bool)
            field[row[first:last], at[first:last] - low] = True
            return np.packbits(field, axis=1).view(np.uint64)

        bits_a, bits_b = bits(at_a, row_a, len(a)), bits(at_b, row_b, len(b))
        for i in np.flatnonzero(wanted.any(1)).tolist():
            js = np.flatnonzero(wanted[i])
            counts[i, js] += np.bitwise_count(bits_a[i] & bits_b[js]).sum(1, dtype=np.int64)
    return counts


def _forest(u: np.ndarray, v: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """The positions among the pairs ``(u, v)`` that join what ``comp`` and the pairs before them have not joined."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(u.tolist(), v.tolist()):
        a, b = find(comp[i]), find(comp[j])
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def _streamed(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.Table], dict]]) -> DataFrame:
    """``mapInArrow`` over the groups ``(g1, g2)`` of ``df``, one group in memory at a time; results by column."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        target, of, held, n = to_arrow_schema(fields), make(), [], 0
        for group in _groups(batches):
            found = of(group)
            if len(found[target.names[0]]):
                held.append(pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in target], schema=target))
                n += held[-1].num_rows
            if n >= 8192:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return df.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(run, fields)


def links_between(rows: DataFrame, classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int, percent: int) -> DataFrame:
    """Links ``(u, v)`` between the left and right sides of each group ``(g1, g2)``: enough to join what ``percent`` joins.

    ``rows`` has ``g1, g2, node, comp, side`` (1 left, 2 right, 3 both). A group is one array operation over sketches
    first; only classes that are left send their sets, each once to each of its groups.
    """
    sketched = classes.select("node", "n", "minima")

    def near():
        def of(group):
            left, right, may = _open_pairs(group, percent)
            side = np.zeros(group.num_rows, np.int64)
            side[left[may.any(1)]] |= 1
            side[right[may.any(0)]] |= 2
            kept = group.filter(pa.array(side > 0))
            return {"side": side[side > 0].astype(np.int32)} | {c: kept.column(c).to_numpy() for c in ("g1", "g2", "node", "comp")}
        return of

    schema = "g1 long, g2 long, node long, comp long, side int"
    kept = materialise(_streamed(rows.join(sketched, "node").select("g1", "g2", "node", "comp", "side", "n", "minima"), schema, near))
    texts = texts_of(kept.select("node").distinct())

    def sets():
        hashes = WordHashes()
        return lambda node, text: [(node, shingle_set(text, hashes, width).tobytes())]

    shingles = map_rows(texts.select("node", "text"), "node long, shingles binary", sets)

    def links():
        def of(group):
            left, right, may = _open_pairs(group, percent)
            n, node, comp = (group.column(c).to_numpy() for c in ("n", "node", "comp"))
            own = [np.frombuffer(b.as_buffer(), _U) for b in group.column("shingles")]
            both = common_counts([own[i] for i in left], [own[i] for i in right], may)
            i, j = np.nonzero(may & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)))
            found = _forest(left[i], right[j], comp.tolist())
            return {"u": [node[a] for a, _ in found], "v": [node[b] for _, b in found]}
        return of

    full = kept.join(sketched, "node").join(shingles, "node")
    return materialise(_streamed(full.select("g1", "g2", "node", "comp", "side", "n", "minima", "shingles"), "u long, v long", links))


def _blocks(members, shingles):
    """Number of blocks of a group of so many classes and shingles."""
    return F.greatest(F.lit(1), F.ceil(members / F.lit(float(BLOCK_MEMBERS))), F.ceil(shingles / F.lit(float(BLOCK_SHINGLES)))).cast("long")


def _first_meeting(located: DataFrame) -> DataFrame:
    """Groups in which every class of a neighbourhood meets its pivots."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    few = F.col("members") <= PIVOTS
    members = located.select(F.col("loc").alias("g1"), block.alias("g2"), "node", F.col("node").alias("comp"), F.when(few, 3).otherwise(1).alias("side"))
    pivots = located.where(F.col("pivot") & ~few).select(F.col("loc").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("g2"), "node",
                                                         F.col("node").alias("comp"), F.lit(2).alias("side"))
    return members.unionByName(pivots)


def _listed(open_buckets: DataFrame) -> DataFrame:
    """Groups of one class and the later ones it shares a small unsettled bucket with and has not met."""
    small = open_buckets.where(F.col("members") <= LISTED_MEMBERS).select("key", F.struct("node", "comp", "loc", "pivot").alias("a"))
    met = (F.col("a.loc") == F.col("b.loc")) & (F.col("a.pivot") | F.col("b.pivot"))
    pairs = (small.join(small.withColumnRenamed("a", "b"), "key").where((F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & ~met)
             .select("a.node", "a.comp", F.col("b.node").alias("other"), F.col("b.comp").alias("other_comp")).distinct())
    first = pairs.select(F.col("node").alias("g1"), F.lit(-1).cast("long").alias("g2"), "node", "comp", F.lit(1).alias("side")).distinct()
    return first.unionByName(pairs.select(F.col("node").alias("g1"), F.lit(-1).cast("long").alias("g2"), F.col("other").alias("node"),
                                          F.col("other_comp").alias("comp"), F.lit(2).alias("side")))


def _block_pairs(open_buckets: DataFrame, percent: int) -> DataFrame:
    """Groups of two blocks of classes that share a large unsettled bucket.

    A block holds classes of one neighbourhood and one range of set sizes, either of one large component or of
    small ones. Blocks of the same component, or too far apart in size, never meet.
    """
    large = open_buckets.where(F.col("members") > LISTED_MEMBERS)
    own = materialise(large.select("node", "comp", "loc", "n").distinct())
    whole = own.groupBy("loc", "comp").agg(F.count(F.lit(1)).alias("_rows"))
    sub = F.when(F.col("_size") >= BLOCK_MEMBERS, F.col("comp"))
    grade = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))) if percent < 100 else F.col("n"))
    sized = own.join(whole.withColumnRenamed("_rows", "_size"), ["loc", "comp"]).select("node", "comp", "loc", "n", sub.alias("sub"), grade.cast("long").alias("grade"))
    keys = [F.col("loc"), F.coalesce("sub", F.lit(-1)), F.col("grade")]
    sized = materialise(sized.withColumn("group", F.xxhash64(*keys)))
    counts = sized.groupBy("group").agg(F.count(F.lit(1)).alias("_rows"), _blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    placed = spread_lookup(sized, counts.drop("_rows"), ["group"], counts.select("group", "_rows"), sized.count())
    placed = materialise(placed.select("node", "comp", "sub", "grade", F.xxhash64("group", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block")))
    held = materialise(spread_join(large.select("key", "node"), placed.select("node", "sub", "grade", "block"), ["node"]).select("key", "block", "sub", "grade").distinct())
    a, b = (held.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("block", "sub", "grade")]) for s in "ab")
    same = F.coalesce(F.col("a_sub") == F.col("b_sub"), F.lit(False))
    pairs = materialise(a.join(b, "key").where((F.col("a_block") <= F.col("b_block")) & (F.abs(F.col("a_grade") - F.col("b_grade")) <= 1) & ~same)
                        .select(F.col("a_block").alias("g1"), F.col("b_block").alias("g2")).distinct())
    member = placed.select("node", "comp", "block")
    left = pairs.withColumn("block", F.col("g1")).join(member, "block").withColumn("side", F.when(F.col("g1") == F.col("g2"), 3).otherwise(1))
    right = pairs.where("g1 != g2").withColumn("block", F.col("g2")).join(member, "block").withColumn("side", F.lit(2))
    return left.unionByName(right).select("g1", "g2", "node", "comp", "side")


def near_components(df: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80, half_keys: int = 10,
                    rows: int = 2) -> DataFrame:
    """``id_col, n_shingles, text_md5, group, component_id, kept`` per row of ``df``; ``group`` numbers components.

    Rows are linked when ``100 * intersection >= percent * union`` of their shingle sets; the component id
    is the smallest id reachable. Equal sets form one class and are never expanded into pairs. Rows without
    words stay alone. Null ids count after all others; a group of null ids alone has a null component and
    its rows are kept; rows that repeat an id and text share one fate. Other columns are ignored, whatever
    their names; an empty table gives an empty table.

    A half key that one class alone holds can make no table meet, so the table keys are formed of shared
    half keys only. Classes of a bucket first meet some pivots of their neighbourhood, the classes with the same
    smallest bucket mate; then every unsettled bucket is settled, a large one by blocks of classes that meet as
    arrays. Classes of one component do not meet again. No pair that shares a bucket is missed, and none is a row
    unless its bucket has ``LISTED_MEMBERS`` at most.
    """
    sketched = materialise(sketches(df.select(id_col, text_col), id_col, text_col, width, half_keys, rows))
    best = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "text_md5", F.col("n_shingles").alias("n"), "minima"))
    classes = materialise(sketched.where("cls IS NOT NULL").groupBy("cls", "cls2").agg(best.alias("b"), F.count(F.lit(1)).alias("_rows"))
                          .select(F.monotonically_increasing_id().alias("node"), "cls", "cls2", "_rows", "b.id", "b.text_md5", "b.n", "b.minima"))
    halves = classes.select("node", F.posexplode(half_hashes(half_keys, rows)).alias("slot", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    held = halves.join(shared, "half", "left_semi").groupBy("node").agg(F.collect_list(F.struct("slot", "half")).alias("halves"))
    keyed = materialise(held.select("node", F.explode(table_keys(half_keys)).alias("key")))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = materialise(keyed.join(shared, "key"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        wanted = materialise(classes.select("node", "id", "text_md5").join(wanted, "node", "left_semi"))
        docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("md5", F.md5("text"))
        found = docs.join(broadcast_if(wanted, wanted.count() * 96), (F.col("md5") == F.col("text_md5")) & F.col("doc").eqNullSafe(F.col("id")))
        return materialise(found.select("node", "text").dropDuplicates(["node"]))

    located = buckets.groupBy("node").agg(F.min("first").alias("loc")).join(classes.select("node", "n"), "node")
    located = materialise(located)
    areas = located.groupBy("loc").agg(F.count(F.lit(1)).alias("members"), _blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    pivot = (F.col("node") == F.col("loc")) | (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("members") < PIVOTS << 20) | (F.col("members") <= PIVOTS)
    located = materialise(spread_lookup(located, areas, ["loc"], areas.select("loc", F.col("members").alias("_rows")), located.count()).withColumn("pivot", pivot))
    nodes = classes.select("node")
    links = links_between(_first_meeting(located), classes, texts_of, width, percent)
    found = materialise(connected_components(nodes, links, []))
    if not buckets.isEmpty():
        held = materialise(buckets.select("key", "node", "members").join(located.select("node", "loc", "n", "pivot"), "node").join(found, "node"))
        unsettled = held.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("key")
        held = materialise(held.join(unsettled, "key", "left_semi"))
        if not held.isEmpty():
            links = links.unionByName(links_between(_listed(held).unionByName(_block_pairs(held, percent)), classes, texts_of, width, percent))
            found = materialise(connected_components(nodes, links, []))
    members = classes.join(found, "node")
    smallest = members.groupBy("comp").agg(F.min("id").alias("component_id"))
    fate = materialise(members.select("cls", "cls2", "_rows", "comp").join(smallest, "comp").select("cls", "cls2", "_rows", F.col("comp").alias("group"), "component_id"))
    out = spread_lookup(sketched, fate.drop("_rows"), ["cls", "cls2"], fate.select("cls", "cls2", "_rows"), sketched.count(), "left")
    component = F.when(F.col("cls").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(id_col, "n_shingles", "text_md5", "group", component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))


def one_of_each(df: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay, one per component, with all their columns, whatever their names.

    The row with the smallest id stays, of equal ids the one with the smallest digest of its text. Rows
    that repeat an id and text are one document and leave one row; documents without words, null and empty texts
    among them, all stay; an empty table gives an empty table.
    """
    verdicts = near_components(df, id_col, text_col, width, percent)
    folded = verdicts.groupBy("group", F.col(id_col).alias("_id"), F.col("text_md5").alias("_md5")).agg(F.count(F.lit(1)).alias("_n"))
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_md5", "_n")).alias("b")
    stay = materialise(folded.where("group IS NULL").select("_id", "_md5", "_n")
                       .unionByName(folded.where("group IS NOT NULL").groupBy("group").agg(first).select("b._id", "b._md5", "b._n")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.md5(text_col).alias("_digest"))
    out = rows.join(broadcast_if(stay, stay.count() * 96), F.col(f"row.`{id_col}`").eqNullSafe(F.col("_id")) & F.col("_digest").eqNullSafe(F.col("_md5")))
    if stay.where("_n > 1").isEmpty():
        return out.select("row.*")
    once = out.where("_n > 1").dropDuplicates(["_id", "_digest"])
    return out.where("_n = 1").select("row.*").unionByName(once.select("row.*"))
