"""Stage folders, category mappings, configurations and the resumable result matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabsieve.session import materialise

# Stage number -> stage name.
STAGES = {1: "encoded_data", 2: "cleaned_by_DBSCAN", 3: "outliers_by_DBSCAN", 4: "weighted_distances",
          5: "final_cleaned", 6: "outliers_by_distance", 7: "before_decoding", 8: "decoded_data"}


class StageStore:
    """One Parquet folder per (dataset, stage), with a CSV export on request."""

    def __init__(self, spark: SparkSession, base: str, dataset: str):
        self.spark, self.base, self.dataset = spark, base.rstrip("/"), dataset

    def path(self, stage: int, kind: str = "parquet") -> str:
        return f"{self.base}/{self.dataset}_{stage}_{STAGES[stage]}.{kind}"

    def write(self, df: DataFrame, stage: int, csv: bool = False, compression: str | None = None) -> str:
        df.write.mode("overwrite").parquet(self.path(stage))
        if csv:
            out = df.write.mode("overwrite").option("header", True)
            (out.option("compression", compression) if compression else out).csv(self.path(stage, "csv"))
        return self.path(stage)

    def read(self, stage: int) -> DataFrame:
        return self.spark.read.parquet(self.path(stage))

    def write_mapping(self, mapping: DataFrame) -> None:
        mapping.write.mode("overwrite").parquet(f"{self.base}/{self.dataset}_mappings.parquet")

    def read_mapping(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{self.dataset}_mappings.parquet")

    def write_config(self, config: DataFrame) -> None:
        config.coalesce(1).write.mode("overwrite").json(f"{self.base}/{self.dataset}_chosen.json")

    def read_config(self) -> DataFrame:
        return self.spark.read.json(f"{self.base}/{self.dataset}_chosen.json")


def config_json(config: DataFrame, name: str = "config") -> DataFrame:
    return config.select(F.to_json(F.struct(*config.columns)).alias(name))


def write_sample(df: DataFrame, path: str) -> None:
    """Gzip CSV cache of a generated table."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def open_jobs(jobs: DataFrame, done: DataFrame, keys: Sequence[str] = ("dataset", "arm", "synth")) -> DataFrame:
    """Jobs without a finished result."""
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_results(df: DataFrame, path: str, keys: Sequence[str] = ("dataset", "arm", "synth")) -> None:
    """Write the results of some jobs; results that these jobs left before are replaced, those of other jobs stay.

    A job that is run again after a crash, before or after its commit, leaves one copy.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def run_jobs(jobs: DataFrame, work: Callable[[Row], DataFrame], path: str | None = None,
             keys: Sequence[str] = ("dataset", "arm", "synth")) -> list[DataFrame]:
    """Run ``work`` per job row; a failing job yields a row with its error instead of vanishing.

    The job list is a short grid of names. Each job is itself a distributed computation.
    """
    spark, out = jobs.sparkSession, []
    for job in jobs.orderBy(*keys).collect():
        tags = [F.lit(job[k]).alias(k) for k in keys]
        try:
            got = work(job)
            # Stored here, so that a failure inside the data is caught too.
            got = materialise(got.select("*", *tags, F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")))
            if path:
                append_results(got, path, keys)
            out.append(got)
        except Exception as e:  # noqa: BLE001 - any failure becomes a status row
            text = f"{type(e).__name__}: {e}"
            out.append(spark.range(1).select(*tags, F.lit("failed").alias("status"), F.lit(text).alias("error")))
    return out
