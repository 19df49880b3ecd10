"""Structured Streaming forms of the operators that keep something between batches.

Stateless operators (confidence filter, boxes, labels, bearings, message readers, points of point_in_zone against
fixed zones) take a streaming DataFrame as they are; aggregate_metrics does too, in complete or update mode. Those here keep state per camera in Spark's
state store, or fold each batch into a small stored table (`fold_into`).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.common import keys_of, shared_path
from ..operators.detection import detect_chain
from ..operators.health import STALL
from ..operators.timeline import ALPHA, FPS_WINDOW, HISTORY, frame_history, latest_frame

#: Tables of earlier batches that a folding sink leaves (a reader may be at one of them).
KEPT_BATCHES = 3


def _typed(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _one_frame(pdfs, order: list[str]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values(order, kind="stable")


def numbered_frames(frames: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """frames: camera_id (and run_id), event_id, ts_ms. Adds frame_number, interval_s and fps, as the batch forms do.

    The state of a camera is its count, last time and rate. Frames have to arrive in order between batches.
    """
    keys = keys_of(frames)
    columns = [*keys, "event_id", "ts_ms"]

    def step(key, pdfs, state):
        n, last, fps = state.get if state.exists else (0, None, 0.0)
        pdf = _one_frame(pdfs, ["ts_ms", "event_id"])
        out = []
        for event, ts in zip(pdf.event_id, pdf.ts_ms):
            dt = (ts - last) / 1000.0 if last is not None else 0.0
            if dt > 0:
                fps = 1 / dt if fps == 0 else (1 - alpha) * fps + alpha / dt
            n, last = n + 1, int(ts)
            out.append((*key, event, ts, n, dt if dt > 0 else None, fps))
        state.update((n, last, fps))
        yield pd.DataFrame(out, columns=[*columns, "frame_number", "interval_s", "fps"]).astype({"interval_s": "float64"})

    schema = f"{_typed(frames, columns)}, frame_number long, interval_s double, fps double"
    return frames.select(*columns).groupBy(*keys).applyInPandasWithState(step, schema, "n long, last long, fps double", "append", GroupStateTimeout.NoTimeout)


def stall_alerts(beats: DataFrame, threshold: int = STALL, delay: str = "10 seconds") -> DataFrame:
    """beats: keys, component, ts_ms. Rows (keys, component, ts_ms, gap_ms): every beat that is followed by more than `threshold` ms of silence.

    gap_ms is null in an alert: no beat had come when the watermark passed the threshold. Once one comes, its row with the gap follows.
    """
    keys = [*keys_of(beats), "component"]

    def alarm(state, last: int) -> None:
        state.setTimeoutTimestamp(max(last + threshold + 1, state.getCurrentWatermarkMs() + 1))

    def step(key, pdfs, state):
        out = []
        if state.hasTimedOut:
            (last,) = state.get
            out.append((*key, last, None))
        else:
            (last,) = state.get if state.exists else (None,)
            for ts in map(int, _one_frame(pdfs, ["ts_ms"]).ts_ms):
                if last is not None and ts - last > threshold:
                    out.append((*key, last, ts - last))
                last = ts if last is None else max(last, ts)
            alarm(state, last)
        state.update((last,))
        yield pd.DataFrame(out, columns=[*keys, "ts_ms", "gap_ms"]).astype({"ts_ms": "int64", "gap_ms": "Int64"})

    rows = beats.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", delay).select(*keys, "ts_ms", "_at")
    schema = f"{_typed(beats, keys)}, ts_ms long, gap_ms long"
    return rows.groupBy(*keys).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def inflight_stream(dispatch: DataFrame, done: DataFrame, within: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """As inflight; open and unknown frames come out once the watermarks of both sides have passed `within`."""
    keys = keys_of(dispatch, "frame_number")

    def side(df: DataFrame, prefix: str) -> DataFrame:
        named = [F.col(k).alias(f"{prefix}_{k}") for k in keys]
        return df.select(*named, F.col("ts_ms").alias(f"{prefix}_ms"), F.timestamp_millis("ts_ms").alias(f"{prefix}_at")).withWatermark(f"{prefix}_at", delay)

    a, b = side(dispatch, "sent"), side(done, "done")
    on = F.expr(" and ".join(f"sent_{k} = done_{k}" for k in keys) + f" and done_at >= sent_at and done_at <= sent_at + interval {within}")
    status = F.when(F.col("done_ms").isNull(), "open").when(F.col("sent_ms").isNull(), "unknown").otherwise("done")
    both = [F.coalesce(f"sent_{k}", f"done_{k}").alias(k) for k in keys]
    return a.join(b, on, "full_outer").select(*both, status.alias("status"), (F.col("done_ms") - F.col("sent_ms")).alias("latency_ms"))


def window_rates(frames: DataFrame, window_ms: int = FPS_WINDOW) -> DataFrame:
    """As window_fps: rows (keys, ts_ms, fps), one for each window that a frame closes. A camera's state is its window's start and count."""
    keys = keys_of(frames)

    def step(key, pdfs, state):
        start, n = state.get if state.exists else (None, 0)
        out = []
        for ts in map(int, _one_frame(pdfs, ["ts_ms", "frame_number"]).ts_ms):
            start, n = ts if start is None else start, n + 1
            if ts - start > window_ms:
                out.append((*key, ts, n * 1000 / (ts - start)))
                start, n = ts, 0
        state.update((start, n))
        yield pd.DataFrame(out, columns=[*keys, "ts_ms", "fps"])

    rows = frames.select(*keys, "ts_ms", "frame_number").groupBy(*keys)
    return rows.applyInPandasWithState(step, f"{_typed(frames, keys)}, ts_ms long, fps double", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def lost_frames(captured: DataFrame, dispatched: DataFrame) -> DataFrame:
    """As dropped_frames: rows (keys, frame_number, dropped_total) once a later frame of the camera is dispatched.

    Frames are dispatched in the order of their numbers. A camera's state is its total, the highest number
    dispatched, and the numbers that only one of the two streams has told yet; dropped_total counts in the order found.
    """
    keys = keys_of(captured)

    def step(key, pdfs, state):
        total, high, waiting, early = state.get if state.exists else (0, -1, [], [])
        pdf = pd.concat(list(pdfs))
        sent = {int(n) for n in pdf.frame_number[pdf["sent"]]} | set(early)
        seen = {int(n) for n in pdf.frame_number[~pdf["sent"]]} | set(waiting)
        high = max([high, *sent])
        lost = sorted(n for n in seen - sent if n < high)
        out = [(*key, n, total + k) for k, n in enumerate(lost, 1)]
        state.update((total + len(lost), high, sorted(n for n in seen - sent if n > high), sorted(sent - seen)))
        yield pd.DataFrame(out, columns=[*keys, "frame_number", "dropped_total"])

    told = lambda df, sent: df.select(*keys, "frame_number", F.lit(sent).alias("sent"))
    rows = told(captured, False).unionByName(told(dispatched, True)).groupBy(*keys)
    state = "total long, high long, waiting array<long>, early array<long>"
    return rows.applyInPandasWithState(step, f"{_typed(captured, keys)}, frame_number long, dropped_total long", state, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream over all that is there, into files of the shared folder, and reads them."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def fold_into(path: str, fold: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the table of batch n is fold(table of batch n - 1 and batch n), written to path/batch=n.

    A batch that runs again after a failure reads the same table before it and overwrites its own; tables older than
    KEPT_BATCHES go. fold must give the columns of the batch and be small (latest packets, a history, the overlays that exist).
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}").unionByName(batch)
        fold(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        _remove(spark, f"{path}/batch={number - KEPT_BATCHES}")

    return run


def _remove(spark, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def latest_sink(path: str, done: str = "done_seq") -> Callable[[DataFrame, int], None]:
    """Keeps the packet completed last of each stream."""
    return fold_into(path, lambda rows: latest_frame(rows, done))


def history_sink(path: str, n: int = HISTORY, done: str = "done_seq") -> Callable[[DataFrame, int], None]:
    """Keeps the n packets completed last of each stream."""
    return fold_into(path, lambda rows: frame_history(rows, n, done))


def overlay_log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps the last operation on each overlay and the last clear: overlay_state of it is that of the whole log."""

    def compact(log: DataFrame) -> DataFrame:
        whose = [F.col("op") == "clear", F.when(F.col("op") != "clear", F.col("overlay_id"))]
        last = Window.partitionBy(*whose).orderBy(F.col("op_id").desc())
        return log.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

    return fold_into(path, compact)


def detection_sink(path: str, **chain) -> Callable[[DataFrame, int], None]:
    """Raw predictions to numbered detections in path/detections; track ids go on from batch to batch, per run.

    A frame's predictions have to be in one batch. Only the next id of each run is kept between batches.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = [k for k in ("run_id",) if k in batch.columns] or ["_run"]
        rows = detect_chain(batch, **chain).withColumn("_run", F.lit(0))
        if number > 0:
            before = spark.read.parquet(f"{path}/next/batch={number - 1}")  # a row per run
            rows = rows.join(before, keys, "left").withColumn("track_id", F.col("track_id") + F.coalesce("next_id", F.lit(0))).drop("next_id")
        out = f"{path}/detections/batch={number}"
        rows.drop("_run").write.mode("overwrite").parquet(out)
        ids = spark.read.parquet(out).withColumn("_run", F.lit(0)).groupBy(*keys).agg((F.max("track_id") + 1).alias("next_id"))
        if number > 0:
            ids = ids.unionByName(before).groupBy(*keys).agg(F.max("next_id").alias("next_id"))
        ids.write.mode("overwrite").parquet(f"{path}/next/batch={number}")

    return run
