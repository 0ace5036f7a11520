"""Forecasts on a stream of curve points.

Points arrive late and twice.  The last W points of a curve are keyed state of the query: a micro-batch
reads and writes the state of the curves that it touches, whatever the number of curves, and the state of a curve that
has been silent for its time to live is dropped.  Whatever changes a tail gives one row, from which the
simple forecasts are projections.  State and offsets are in the checkpoint, so a restart goes on where it ended.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tailcast.operators.curves import assumed_limit, summarise
from tailcast.operators.forecast import forecast
from tailcast.settings import WINDOW_LEN

# executors need not have this package installed: functions that run there travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

POINTS = "curve_id string, step int, value double, ts timestamp"
STATE = "steps array<int>, vals array<double>, seen bigint"
TAIL = "curve_id string, steps array<int>, vals array<double>, seen bigint"
METHODS = ("linear", "log_linear", "window_mean", "window_min", "last_value")


def points_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merge(steps, vals, new_steps, new_vals, window_len: int) -> tuple[list, list]:
    """Tail after new points: each step once (the larger value where it comes twice), the last ``window_len`` steps."""
    at = dict(zip(steps, vals))
    for step, value in zip(new_steps, new_vals):
        at[step] = max(value, at[step]) if step in at else value
    kept = sorted(at)[-window_len:]
    return [int(s) for s in kept], [float(at[s]) for s in kept]


def _keep_tail(window_len: int, ttl_ms: int):
    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old_steps, old_vals, seen = state.get if state.exists else ([], [], 0)
        steps, vals = [*old_steps], [*old_vals]
        before, newest = (steps, vals), 0
        for frame in frames:
            frame = frame.dropna(subset=["step", "value"])
            steps, vals = merge(steps, vals, frame["step"].tolist(), frame["value"].tolist(), window_len)
            if len(frame):
                newest = max(newest, int(frame["ts"].max().timestamp() * 1000))
        changed = (steps, vals) != before
        state.update((steps, vals, seen + int(changed)))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + ttl_ms)
        if changed:
            yield pd.DataFrame({"curve_id": [key[0]], "steps": [steps], "vals": [vals], "seen": [seen + 1]})
    return update


def tail_stream(points: DataFrame, window_len: int = WINDOW_LEN, delay: str = "1 hour", ttl_hours: float = 24.0) -> DataFrame:
    """A row with the new tail for every curve that a micro-batch changes.  Points later than the
    watermark may still change a tail while its state lives; NULL steps and values are passed over."""
    rows = points.filter(F.col("curve_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    return rows.groupBy("curve_id").applyInPandasWithState(
        _keep_tail(window_len, int(ttl_hours * 3_600_000)), TAIL, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def tails(points: DataFrame, window_len: int = WINDOW_LEN) -> DataFrame:
    """The tails of a table of points, as the stream has them at its end.  Duplicates and the last
    step are found by partial aggregation, so only the few points near the end
    of a curve are ever gathered (steps of a curve are dense)."""
    once = points.filter("curve_id IS NOT NULL AND step IS NOT NULL AND value IS NOT NULL").groupBy("curve_id", "step").agg(F.max("value").alias("value"))
    last = once.groupBy("curve_id").agg(F.max("step").alias("_last"))
    near = once.join(last, "curve_id").filter(F.col("step") > F.col("_last") - window_len)
    rows = near.groupBy("curve_id").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("p"))
    return rows.select("curve_id", F.col("p.step").alias("steps"), F.col("p.value").alias("vals"))


def live_forecasts(tail_rows: DataFrame, targets, methods=METHODS) -> DataFrame:
    """Forecasts at the next steps of every tail; ``targets`` are steps ahead of its end.  Projections only, on a table or a stream."""
    w = tail_rows.withColumns({"xs": F.transform("steps", lambda s: s.cast("double")), "ys": F.col("vals")}).drop("steps", "vals")
    w = summarise(w).withColumns({"L_true": F.lit(None).cast("double"), "depth": F.get("xs", F.size("xs") - 1).cast("int")})
    w = w.withColumn("L_hat", assumed_limit("winmin", F.col("min_v")))
    ahead = F.array(*[F.struct((F.col("depth") + int(t)).alias("n_f"), F.lit(None).cast("double").alias("true_val")) for t in targets])
    rows = forecast(w.withColumn("targets", ahead), methods)
    return rows.select(
        *[c for c in ("curve_id", "depth", "seen", "n_f", "method") if c in rows.columns], F.col("estimate_raw").alias("estimate"))


def start(points: DataFrame, root: str, targets=(10, 50), window_len: int = WINDOW_LEN, delay: str = "1 hour", ttl_hours: float = 24.0, methods=METHODS):
    """Write the forecasts of every changed curve to ``root``/forecasts until the input is used up."""
    rows = live_forecasts(tail_stream(points, window_len, delay, ttl_hours), targets, methods)
    return (rows.writeStream.format("parquet").option("path", f"{root}/forecasts").option("checkpointLocation", f"{root}/checkpoint")
            .outputMode("append").trigger(availableNow=True).start())


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest forecast of each (curve, steps ahead, method): that of the tail's last change."""
    rows = spark.read.parquet(f"{root}/forecasts").withColumn("ahead", F.col("n_f") - F.col("depth"))
    return rows.groupBy("curve_id", "ahead", "method").agg(F.max_by(F.struct("depth", "estimate"), "seen").alias("r")).select("curve_id", "ahead", "method", "r.*")
