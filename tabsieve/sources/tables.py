"""Table readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsieve.functions.ranking import number_rows

# Integer attributes of the headerless credit table; the rest are text.
CREDIT_INTEGERS = (2, 5, 8, 11, 13, 16, 18)
CREDIT_COLUMNS = tuple(f"Attribute{i}" for i in range(1, 21)) + ("class",)


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             null_value: str | None = None) -> DataFrame:
    """Header CSV, plain or gzipped. Give a schema for anything large: inference reads the file twice."""
    reader = spark.read.option("header", True)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_credit(spark: SparkSession, path: str) -> DataFrame:
    """Space-delimited, headerless table of 20 attributes and a class."""
    schema = T.StructType([
        T.StructField(c, T.IntegerType() if c == "class" or i in CREDIT_INTEGERS else T.StringType())
        for i, c in enumerate(CREDIT_COLUMNS, start=1)])
    return spark.read.option("sep", " ").schema(schema).csv(path)


def read_number_lines(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Headerless lines of numbers separated by runs of blanks."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(*[parts[i].cast("double").alias(c) for i, c in enumerate(columns)])


def read_result_files(spark: SparkSession, pattern: str, schema: T.StructType | str | None = None,
                      separator: str = "_") -> DataFrame:
    """Many CSVs at once; dataset and synthesizer come from the name ``<dataset>_<synthesizer>.csv``.

    The name may be that of a file or of a folder of part files.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.csv(\.gz)?(/|$)", 1)
    cut = F.instr(F.col("_n"), separator)
    return (read_csv(spark, pattern, schema).withColumn("_n", F.url_decode(name))
            .withColumn("dataset_name", F.substring("_n", F.lit(1), cut - 1))
            .withColumn("synthesizer", F.expr(f"substring(_n, instr(_n, '{separator}') + {len(separator)})"))
            .drop("_n"))


def with_row_id(df: DataFrame, natural_key: str | None = None, name: str = "row_id") -> DataFrame:
    """A stable id: the natural key if given, else the position in the order of all columns.

    Equal rows are told apart by a copy number, so positions never change between runs.
    """
    if natural_key:
        return df.withColumn(name, F.col(natural_key).cast("long"))
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    # copies are spread in steps, so a row repeated very often never becomes one huge array
    step = 10_000
    steps = counted.withColumn("_s", F.explode(F.sequence(F.lit(0), ((F.col("_copies") - 1) / step).cast("int"))))
    last = F.least(F.lit(step), F.col("_copies") - F.col("_s") * step).cast("int")
    spread = (steps.withColumn("_i", F.explode(F.sequence(F.lit(1), last)))
              .select(*df.columns, (F.col("_s").cast("long") * step + F.col("_i")).alias("_copy")))
    return number_rows(spread, [*df.columns, "_copy"], name=name).drop("_copy")
