"""Imputation, category codes and decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.ranking import number_rows
from tabsieve.session import broadcast_if, materialise, spread_lookup

NULL_CATEGORY = "nan"
#: One-hot output has one column per category, so their number must stay small.
MAX_ONE_HOT = 10_000


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """``categorical`` (string, boolean) or ``numeric`` columns, from the schema alone."""
    kinds = {"categorical": (T.StringType, T.BooleanType), "numeric": (T.NumericType,)}[kind]
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def cast_columns(df: DataFrame, columns: Sequence[str], dtype: str) -> DataFrame:
    return df.select(*[F.col(c).cast(dtype).alias(c) if c in set(columns) else F.col(c) for c in df.columns])


def project_like(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.select(*other.columns)


def most_frequent(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, object]:
    """Most frequent non-null value per column, smallest on ties.

    Counting runs as a grouped aggregate over (column, value), so neither a hot
    value nor a column of mostly distinct values builds up in one buffer.
    """
    wanted = list(columns or df.columns)
    by_type: dict[str, list[str]] = {}
    for f in df.schema:
        if f.name in wanted:
            by_type.setdefault(f.dataType.simpleString(), []).append(f.name)
    best: dict[str, object] = {}
    for names in by_type.values():
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names]))
        counted = (df.select(pairs.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())
                   .groupBy("column", "value").count())
        rows = counted.groupBy("column").agg(
            F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value")).collect()
        best.update({r["column"]: r["value"] for r in rows})
    return best


def impute_most_frequent(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    fill = most_frequent(df, columns)
    return df.select(*[F.coalesce(F.col(c), F.lit(fill[c]).cast(df.schema[c].dataType)).alias(c)
                       if fill.get(c) is not None else F.col(c) for c in df.columns])


def _as_category(column: str, null_as_category: bool):
    text = F.col(column).cast("string")
    return F.coalesce(text, F.lit(NULL_CATEGORY)) if null_as_category else text


def category_mapping(df: DataFrame, columns: Sequence[str] | None = None, null_as_category: bool = False) -> DataFrame:
    """(column, code, category): categories in ascending order, codes from 0."""
    columns = list(columns) if columns is not None else columns_of_type(df, "categorical")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _as_category(c, null_as_category).alias("category"))
                                for c in columns]))
    seen = (df.select(pairs.alias("p")).select("p.column", "p.category")
            .where(F.col("category").isNotNull()).distinct())
    return materialise(number_rows(seen, ["category"], ["column"], "rn")
                       .select("column", (F.col("rn") - 1).cast("int").alias("code"), "category"))


def _mapping_sizes(mapping: DataFrame) -> dict[str, tuple[int, int]]:
    """Per column the number of codes and the bytes of its entries."""
    rows = mapping.groupBy("column").agg((F.max("code") + 1).alias("codes"), F.sum(F.octet_length("category") + 48).alias("bytes")).collect()
    return {r["column"]: (r["codes"], r["bytes"]) for r in rows}


def _lookup(df: DataFrame, table: DataFrame, key: str, n_bytes: int) -> DataFrame:
    small = broadcast_if(table, n_bytes)
    if small is not table:
        return df.join(small, key, "left")
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return spread_lookup(df, table, [key], counts, df.count(), how="left")


def ordinal_encode(df: DataFrame, mapping: DataFrame, columns: Sequence[str] | None = None,
                   unknown: float | None = None, null_as_category: bool = False) -> DataFrame:
    """Replace categories by their code as double; ``unknown`` fills unseen and null values."""
    sizes = _mapping_sizes(mapping)
    columns = list(columns) if columns is not None else [c for c in df.columns if c in sizes]
    order, out = df.columns, df
    for c in columns:
        table = mapping.where(F.col("column") == c).select(F.col("category").alias("_cat"),
                                                           F.col("code").cast("double").alias("_code"))
        out = _lookup(out.withColumn("_cat", _as_category(c, null_as_category)), table, "_cat", sizes.get(c, (0, 0))[1])
        code = F.col("_code") if unknown is None else F.coalesce("_code", F.lit(float(unknown)))
        out = out.withColumn(c, code).drop("_cat", "_code")
    return out.select(*order)


def ordinal_decode(df: DataFrame, mapping: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Codes back to categories; null and unknown codes give null."""
    sizes = _mapping_sizes(mapping)
    columns = list(columns) if columns is not None else [c for c in df.columns if c in sizes]
    order, out = df.columns, df
    for c in columns:
        table = mapping.where(F.col("column") == c).select(F.col("code").alias("_key"),
                                                           F.col("category").alias("_cat"))
        out = _lookup(out.withColumn("_key", F.col(c).cast("int")), table, "_key", sizes.get(c, (0, 0))[1])
        out = out.withColumn(c, F.col("_cat")).drop("_key", "_cat")
    return out.select(*order)


def encode_against(df: DataFrame, reference: DataFrame) -> DataFrame:
    """All columns as double, categories coded by ``reference``; unseen and null become -1."""
    cats = [c for c in columns_of_type(reference, "categorical") if c in df.columns]
    out = df
    if cats:
        out = ordinal_encode(out, category_mapping(reference, cats, null_as_category=True), cats, unknown=-1.0,
                             null_as_category=True)
    return out.select(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in df.columns])


def shared_label_codes(labels_from: DataFrame, df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Code ``column`` of ``df`` by the labels of another table; unseen labels become -1."""
    mapping = category_mapping(labels_from, [column], null_as_category=True)
    coded = df.withColumn("_label", F.col(column))
    return (ordinal_encode(coded, mapping.withColumn("column", F.lit("_label")), ["_label"], unknown=-1.0,
                           null_as_category=True).withColumnRenamed("_label", name))


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ordinal codes of the string form of any column."""
    return ordinal_encode(df, category_mapping(df, columns, null_as_category=True), columns, null_as_category=True)


def _one_hot_entries(mapping: DataFrame) -> list[tuple[str, str]]:
    rows = mapping.orderBy("column", "code").limit(MAX_ONE_HOT + 1).collect()
    if len(rows) > MAX_ONE_HOT:
        raise ValueError(f"more than {MAX_ONE_HOT} categories: use one_hot_slots or ordinal codes")
    return [(r["column"], r["category"]) for r in rows]


def one_hot_encode(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Columns ``<column>_<category>`` of 0.0 / 1.0 in place of the originals."""
    entries = _one_hot_entries(mapping)
    gone = {c for c, _ in entries}
    return df.select(*[c for c in df.columns if c not in gone],
                     *[F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c, v in entries])


def one_hot_decode(df: DataFrame, mapping: DataFrame) -> DataFrame:
    entries = _one_hot_entries(mapping)
    hot = {f"{c}_{v}" for c, v in entries}
    back = []
    for c in dict.fromkeys(c for c, _ in entries):
        back.append(F.coalesce(*[F.when(F.col(f"`{c}_{v}`") == 1.0, F.lit(v)) for cc, v in entries if cc == c]).alias(c))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in hot], *back)


def _first_slots(mapping: DataFrame) -> tuple[dict[str, int], int]:
    """The first slot of each column, by column name, and the number of all slots."""
    first, total = {}, 0
    for c, (codes, _) in sorted(_mapping_sizes(mapping).items()):
        first[c], total = total, total + codes
    return first, total


def one_hot_slots(df: DataFrame, mapping: DataFrame, name: str = "one_hot") -> DataFrame:
    """Sparse one-hot form for any number of categories: ``name`` in place of the originals.

    ``name`` is a struct of ``size``, the number of all categories, and ``slots``, the places of the ones in
    ascending order: those of ``one_hot_encode`` counted from 0. Null and unseen categories have no slot.
    """
    first, total = _first_slots(mapping)
    coded = ordinal_encode(df, mapping, list(first))
    slots = F.array(*[F.col(c).cast("long") + F.lit(at) for c, at in first.items()]).cast("array<long>")
    return coded.select(*[c for c in df.columns if c not in first],
                        F.struct(F.lit(total).cast("long").alias("size"), F.filter(slots, lambda s: s.isNotNull()).alias("slots")).alias(name))


def one_hot_slots_decode(df: DataFrame, mapping: DataFrame, name: str = "one_hot") -> DataFrame:
    """The columns of ``mapping`` back from ``name``; no slot gives null."""
    first, total = _first_slots(mapping)
    ends = [*first.values(), total][1:]

    def code(low, high):
        return F.get(F.filter(F.col(name)["slots"], lambda s: (s >= low) & (s < high)), F.lit(0)) - low

    codes = df.select(*[c for c in df.columns if c != name], *[code(low, high).alias(c) for (c, low), high in zip(first.items(), ends)])
    return ordinal_decode(codes, mapping, list(first))


def row_key(df: DataFrame, columns: Sequence[str], name: str = "row_key", digits: int = 6) -> DataFrame:
    """All columns joined by a pipe, fractional numbers rounded first."""
    def text(c):
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            return F.format_string(f"%.{digits}f", F.round(F.col(c), digits).cast("double"))
        return F.col(c).cast("string")
    return df.withColumn(name, F.concat_ws("|", *[F.coalesce(text(c), F.lit(NULL_CATEGORY)) for c in columns]))


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)
