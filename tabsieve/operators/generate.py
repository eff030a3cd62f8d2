"""Split, sampling and simple table generators, all driven by seeded digests."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.hashing import seeded_digest, seeded_uniform
from tabsieve.functions.ranking import number_rows, running_totals
from tabsieve.operators.filters import distinct_counts
from tabsieve.session import broadcast_if, materialise, null_safe_join


def split_train_holdout(df: DataFrame, id_col: str, share: float = 0.7, seed: int | str = 42) -> DataFrame:
    """Add ``part``: ``train`` for exactly floor(share * n) rows in digest order, else ``holdout``."""
    order = number_rows(df.select(id_col, seeded_digest(seed, id_col).alias("_d")), ["_d", id_col], name="_rn", total="_n")
    # as decimals: 0.7 * 90 is 62.99… in doubles, which would lose a row
    size = F.floor(F.col("_n").cast("decimal(20,0)") * F.lit(Decimal(str(share))))
    part = F.when(F.col("_rn") <= size, "train").otherwise("holdout")
    return df.join(order.select(id_col, part.alias("part")), id_col)


def _uniform_column(spark, n: int, column: str, seed) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("gen_id"), seeded_uniform(f"{seed}|{column}", F.col("id")).alias("_u"))


def _draw(draws: DataFrame, steps: DataFrame, keys: Sequence[str], column: str, buckets: int) -> DataFrame:
    """Pick the step whose [lo, hi) holds the row's ``_u``, per key.

    The interval join runs on equal-width buckets of [0, 1): a wide step appears in
    every bucket it covers, and a hot key is spread over all buckets.
    """
    steps = materialise(steps)
    keyed = steps.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("_lo") * buckets).cast("int"), F.least(F.floor(F.col("_hi") * buckets).cast("int"), F.lit(buckets - 1)))))
    groups = steps.select(*keys).distinct().count() if keys else 1
    side = broadcast_if(keyed, (steps.count() + groups * buckets) * 64)
    return (null_safe_join(draws.withColumn("_b", F.floor(F.col("_u") * buckets).cast("int")), side, [*keys, "_b"])
            .where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_b", "_lo", "_hi", "_u"))


def _steps(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Share of the unit interval per value; null is a value of its own, before all others."""
    counted = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    pos = running_totals(counted, keys, [column], ["n"])
    return pos.select(*keys, column, (F.col("before_n") / F.col("total_n")).alias("_lo"),
                      ((F.col("before_n") + F.col("n")) / F.col("total_n")).alias("_hi"))


def sample_marginal(df: DataFrame, column: str, n: int, seed: int | str = 42, buckets: int = 4096) -> DataFrame:
    """(gen_id, column): n values drawn from the column's own distribution."""
    draws = _uniform_column(df.sparkSession, n, column, seed)
    return _draw(draws, _steps(df, [], column), [], column, buckets).select("gen_id", column)


def independent_marginals(df: DataFrame, columns: Sequence[str], n: int, seed: int | str = 42) -> DataFrame:
    """n rows, every column drawn on its own from its observed distribution."""
    out = None
    for c in columns:
        part = sample_marginal(df, c, n, seed)
        out = part if out is None else out.join(part, "gen_id")
    return out


def uniform_sampler(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], n: int, seed: int | str = 42) -> DataFrame:
    """n rows: numbers uniform over the observed range, categories uniform over those present; null where none is."""
    spark = df.sparkSession
    row = df.agg(*[f(c).cast("double").alias(f"{t}{i}") for i, c in enumerate(numeric) for f, t in ((F.min, "l"), (F.max, "h"))]
                 or [F.lit(1)]).first()
    out = spark.range(n).select(
        F.col("id").alias("gen_id"),
        *[F.lit(None).cast("double").alias(c) if row[f"l{i}"] is None
          else (F.lit(row[f"l{i}"]) + seeded_uniform(f"{seed}|{c}", F.col("id")) * F.lit(row[f"h{i}"] - row[f"l{i}"])).alias(c)
          for i, c in enumerate(numeric)])
    for c in categorical:
        cats = materialise(number_rows(df.where(F.col(c).isNotNull()).select(c).distinct(), [c], name="_rn"))
        size = cats.count()
        if not size:
            out = out.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
            continue
        out = (out.withColumn("_rn", (F.floor(seeded_uniform(f"{seed}|{c}", F.col("gen_id")) * size) + 1).cast("long"))
               .join(broadcast_if(cats, size * 64), "_rn").drop("_rn"))
    return out


def bootstrap(df: DataFrame, id_col: str, n: int, seed: int | str = 42) -> DataFrame:
    """n rows drawn with replacement: a hashed row number is looked up by an equi-join."""
    numbered = number_rows(df, [id_col], name="_rn")
    size = df.count()
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("gen_id"), (F.floor(seeded_uniform(seed, F.col("id")) * size) + 1).cast("long").alias("_rn"))
    return draws.join(numbered, "_rn").drop("_rn")


def mutual_information(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, mi) over discrete columns, from pair counts; pairs in column order, null is a value of its own."""
    n = df.count()
    single = {c: df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")) for c in columns}
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            pair = df.groupBy(F.col(a).alias("va"), F.col(b).alias("vb")).agg(F.count(F.lit(1)).alias("nab"))
            joined = null_safe_join(null_safe_join(pair, single[a].select(F.col("v").alias("va"), F.col("n").alias("na")), ["va"]),
                                    single[b].select(F.col("v").alias("vb"), F.col("n").alias("nb")), ["vb"])
            term = F.col("nab") / n * F.log(F.col("nab") * F.lit(float(n)) / (F.col("na") * F.col("nb")))
            parts.append(joined.agg(F.sum(term).alias("mi")).select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "mi"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chow_liu_tree(mi: list[tuple[str, str, float]], columns: Sequence[str]) -> list[tuple[str, str | None]]:
    """(column, parent) in sampling order: the maximum spanning tree grown from the first column."""
    weight = {frozenset((a, b)): w for a, b, w in mi}
    order: list[tuple[str, str | None]] = [(columns[0], None)]
    inside, outside = [columns[0]], list(columns[1:])
    while outside:
        best = max(((weight[frozenset((p, c))], p, c) for p in inside for c in outside), key=lambda t: (t[0], t[2], t[1]))
        order.append((best[2], best[1]))
        inside.append(best[2])
        outside.remove(best[2])
    return order


def bayesian_network(df: DataFrame, columns: Sequence[str], n: int, seed: int | str = 42, bins: int = 20) -> DataFrame:
    """n rows from a tree-structured network: each column is drawn given its parent's value.

    Numeric columns with many values are cut into equal-width bins for the tree and
    drawn as the bin's observed mean.
    """
    spark = df.sparkSession
    counts = distinct_counts(df, columns)
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")
               or f.dataType.typeName().startswith("decimal")}
    work = df.select(*columns)
    for c in columns:
        if c in numeric and counts[c] > bins:
            lo, hi = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
            cut = F.least(F.floor((F.col(c) - lo) / F.lit((hi - lo) / bins)), F.lit(bins - 1))
            means = df.groupBy(cut.alias("_bin")).agg(F.avg(c).alias("_mean"))
            work = null_safe_join(work.withColumn("_bin", cut), F.broadcast(means), ["_bin"]).withColumn(c, F.col("_mean")).drop("_bin", "_mean")
    work = materialise(work)
    mi = [(r["col_a"], r["col_b"], r["mi"]) for r in mutual_information(work, columns).collect()] if len(columns) > 1 else []
    out = spark.range(n).select(F.col("id").alias("gen_id"))
    for child, parent in chow_liu_tree(mi, list(columns)):
        keys = [parent] if parent else []
        if not parent:
            out = out.join(sample_marginal(work, child, n, seed), "gen_id")
            continue
        u = seeded_uniform(f"{seed}|{child}", F.col("gen_id"))
        out = _draw(out.withColumn("_u", u), _steps(work, keys, child), keys, child, buckets=64)
    return out.select("gen_id", *columns)
