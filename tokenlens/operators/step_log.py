"""K6 + P21: a computation over steps that commits by step.

Results are a folder by step; beside it stands a log with one entry for each attempt at a step:
``done`` with its number of rows, which may be 0, or ``failed`` with the error. A step is pending
until its last entry says ``done``, so a finished step without rows is not computed again and a
failed one is, and only rows of finished steps are read.

Pending steps are computed together in one job, up to ``steps_per_commit`` of them. Where that job
fails, its steps are halved until those that fail stand alone; all others are written. Rows are
committed before the log, and a step's folder is replaced as a whole, so a driver that is lost in
between leaves steps that are computed once more, never rows twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists
from .facts import write_step_results

LOG = "step int, status string, n_rows long, error string, attempt long"


def log_path(out_path: str) -> str:
    return out_path.rstrip("/") + ".log"


def read_log(spark: SparkSession, out_path: str) -> DataFrame:
    """The last entry of each step."""
    path = log_path(out_path)
    if not path_exists(spark, path):
        return spark.createDataFrame([], LOG)
    last = F.max(F.struct("attempt", "status", "n_rows", "error")).alias("e")
    return spark.read.schema(LOG).json(path).groupBy("step").agg(last).select("step", "e.status", "e.n_rows", "e.error", "e.attempt")


def read_finished(spark: SparkSession, out_path: str, schema: str) -> DataFrame:
    """The rows of finished steps."""
    if not path_exists(spark, out_path):
        return spark.createDataFrame([], schema)
    done = read_log(spark, out_path).where("status = 'done' and n_rows > 0").select("step")   # a row per step
    return spark.read.schema(schema).json(out_path).join(F.broadcast(done), "step", "left_semi")


def run_steps(steps: DataFrame, compute: Callable[[DataFrame], DataFrame], out_path: str, schema: str,
              steps_per_commit: int = 64) -> DataFrame:
    """Compute the pending ones of ``steps`` (column ``step``); return the rows of all finished steps.
    ``compute`` takes a table of steps and returns rows with a column ``step``. The list of steps is
    the grid's and comes to the driver; rows don't."""
    spark = steps.sparkSession
    log = read_log(spark, out_path)
    done = {r.step for r in log.where("status = 'done'").select("step").collect()}
    attempt = (log.agg(F.max("attempt")).first()[0] or 0) + 1
    pending = sorted({r.step for r in steps.select("step").collect()} - done)
    work = [pending[i:i + steps_per_commit] for i in range(0, len(pending), steps_per_commit)]
    while work:
        group = work.pop(0)
        try:
            rows = compute(spark.createDataFrame([(s,) for s in group], "step int"))
            write_step_results(rows, out_path)
        except Exception as e:  # noqa: BLE001 - a step that fails is recorded, the others go on
            if len(group) > 1:
                work[:0] = [group[:len(group) // 2], group[len(group) // 2:]]
            else:
                _append(spark, out_path, [(group[0], "failed", 0, _reason(e), attempt)])
            continue
        counts = {}
        if path_exists(spark, out_path):
            written = spark.read.schema(schema).json(out_path).where(F.col("step").isin(group))
            counts = {r["step"]: r["count"] for r in written.groupBy("step").count().collect()}
        _append(spark, out_path, [(s, "done", counts.get(s, 0), None, attempt) for s in group])
    return read_finished(spark, out_path, schema)


def _reason(e: Exception) -> str:
    """The last line of the innermost Python error, or the first line of any other."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()] or [type(e).__name__]
    raised = [x for x in lines if x.split(":")[0].endswith(("Error", "Exception")) and " " not in x.split(":")[0]]
    return (raised[-1] if raised else lines[0])[:500]


def _append(spark: SparkSession, out_path: str, entries: list[tuple]) -> None:
    spark.createDataFrame(entries, LOG).coalesce(1).write.mode("append").json(log_path(out_path))
