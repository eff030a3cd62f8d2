"""The attribute-inference sweep over a grid of jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tabsieve.operators.attack import RESULT, attribute_inference
from tabsieve.operators.compare import union_all
from tabsieve.sources.stages import open_jobs, run_jobs


def attack_sweep(jobs: DataFrame, load: Callable[[Row], tuple[DataFrame, DataFrame, Sequence[str]]],
                 models: Sequence[str] = ("logreg", "rf"), done: DataFrame | None = None, path: str | None = None,
                 **sizes) -> DataFrame:
    """Attack every sensitive column of every (dataset, arm, synth) job that has no result yet.

    ``load`` returns (real, synthetic, sensitive columns) of a job. The grid of names
    is short; every fit is a distributed MLlib job of its own.
    """
    todo = jobs if done is None else open_jobs(jobs, done)

    def work(job: Row) -> DataFrame:
        real, syn, columns = load(job)
        return union_all([attribute_inference(real, syn, c, models, **sizes).withColumnRenamed("error", "fit_error")
                          for c in columns if c in syn.columns])

    parts = run_jobs(todo, work, path)
    if not parts:
        keys = jobs.select("dataset", "arm", "synth").where(F.lit(False))
        none = jobs.sparkSession.createDataFrame([], RESULT).withColumnRenamed("error", "fit_error")
        return none.join(keys, F.lit(True), "left").withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
    return union_all(parts)
