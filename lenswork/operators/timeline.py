"""Frame timelines: numbers, intervals, smoothed rates, drops, history and snapshots at ticks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import BUCKET, RANGE_MS, as_of, exclusive_sum, following, kept, keys_of, numbered, previous

#: Weight of the newest rate, depth of the history, tick lengths in ms.
ALPHA, HISTORY, MJPEG_TICK, SSE_TICK, FPS_WINDOW = 0.1, 64, 33, 250, 1000
CHUNK, TICKS = 10_000, 16_384


def number_frames(df: DataFrame, order: tuple[str, ...] = ("ts_ms", "event_id")) -> DataFrame:
    """1, 2, ... per run and camera in order of arrival; frames that are dropped later keep their numbers.

    The first column of the order is a time in ms; ranges of it are sorted apart, so a camera is many tasks.
    """
    return numbered(df, keys_of(df), list(order), RANGE_MS, "frame_number")


def frame_interval(df: DataFrame, start_ms: str | None = None) -> DataFrame:
    """Seconds since the frame before, null unless above 0; the first one counts from start_ms, if there is such a column."""
    rows = previous(df, keys_of(df), "frame_number", "ts_ms", BUCKET, "_before")
    before = F.coalesce(F.col("_before"), F.col(start_ms)) if start_ms else F.col("_before")
    dt = (F.col("ts_ms") - before) / F.lit(1000.0)
    return rows.withColumn("interval_s", F.when(dt > 0, dt)).drop("_before")


def smoothed_fps(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds fps: the first rate as it is, then alpha of the new rate; frames without an interval leave it unchanged.

    The fold is linear, so chunks of frames are folded apart: each chunk's decay and sum first, then
    the state at every chunk's start (a row per chunk), then the frames. A camera is never one task.
    """
    keys = keys_of(df)
    rows = frame_interval(df).withColumn("chunk", F.floor(F.col("frame_number") / CHUNK))

    def fold(dt, state):
        out = []
        for x in dt:
            if x == x and x is not None:
                state = 1 / x if state == 0 else (1 - alpha) * state + alpha / x
            out.append(state)
        return out

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_number")
        dt = pdf.interval_s.dropna()
        moved = 0.0
        for x in dt:
            moved = (1 - alpha) * moved + alpha / x
        last = fold(dt, 0.0)
        return pd.DataFrame([[*pdf.iloc[0][keys], int(pdf.chunk.iloc[0]), len(dt), moved, last[-1] if last else 0.0]], columns=[*keys, "chunk", "n", "moved", "fresh"])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, at = 0.0, []
        for n, moved, fresh in zip(pdf.n, pdf.moved, pdf.fresh):
            at.append(state)
            state = fresh if state == 0 else (1 - alpha) ** n * state + moved
        return pdf[[*keys, "chunk"]].assign(state=at)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_number")
        return pdf.assign(fps=fold(pdf.interval_s, pdf.state.iloc[0])).drop(columns=["state", "chunk"])

    typed = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    typed = typed + ", " if typed else ""
    summary = rows.groupBy(*keys, "chunk").applyInPandas(ends, f"{typed}chunk long, n long, moved double, fresh double")
    start = summary.groupBy(*keys).applyInPandas(states, f"{typed}chunk long, state double")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("chunk").schema)
    return rows.join(start, [*keys, "chunk"]).groupBy(*keys, "chunk").applyInPandas(each, f"{schema}, fps double")


def dropped_frames(captured: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Captured frames that were never dispatched, with the running total per run and camera."""
    keys = keys_of(captured)
    lost = captured.join(dispatched.select(*keys, "frame_number"), [*keys, "frame_number"], "left_anti")
    lost = lost.withColumn("_one", F.lit(1))
    return exclusive_sum(lost, keys, "frame_number", "_one", "_before").withColumn("dropped_total", F.col("_before") + 1).drop("_one", "_before")


def gaps(dispatched: DataFrame) -> DataFrame:
    """Missing numbers after each frame that is followed by a gap; ranges of numbers are looked at apart."""
    rows = following(dispatched, keys_of(dispatched), "frame_number", "frame_number", BUCKET, "_next")
    return rows.withColumn("missing", F.col("_next") - F.col("frame_number") - 1).filter("missing > 0").drop("_next")


def inflight(dispatch: DataFrame, done: DataFrame) -> DataFrame:
    """Rows (keys, frame_number, status, latency_ms): done, open, or completed without having been open."""
    keys = keys_of(dispatch, "frame_number")
    a = dispatch.select(*keys, F.col("ts_ms").alias("sent_ms"))
    b = done.select(*keys, F.col("ts_ms").alias("done_ms"))
    status = F.when(F.col("done_ms").isNull(), "open").when(F.col("sent_ms").isNull(), "unknown").otherwise("done")
    return a.join(b, keys, "full").select(*keys, status.alias("status"), (F.col("done_ms") - F.col("sent_ms")).alias("latency_ms"))


def queue_delay(df: DataFrame, enqueued: str = "enqueued_ms", dequeued: str = "dequeued_ms") -> DataFrame:
    return df.withColumn("queue_delay_s", (F.col(dequeued) - F.col(enqueued)) / F.lit(1000.0))


def latest_frame(df: DataFrame, done: str = "done_seq") -> DataFrame:
    """The packet completed last, which need not have the highest number."""
    keys, rest = keys_of(df), [c for c in df.columns if c not in keys_of(df)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), done).alias("p")).select(*keys, "p.*")


def frame_history(df: DataFrame, n: int = HISTORY, done: str = "done_seq") -> DataFrame:
    """The n packets completed last."""
    w = Window.partitionBy(*keys_of(df)).orderBy(F.col(done).desc())
    return df.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def frame_lookup(requests: DataFrame, df: DataFrame, n: int = HISTORY, done: str = "done_seq") -> DataFrame:
    """requests: request_id, keys, frame_number. From the history; else the latest with a warning (200); without frames 204."""
    keys = keys_of(df)
    history = frame_history(df, n, done)
    first = history.groupBy(*keys, "frame_number").agg(F.min(done).alias("done_seq"))  # of equal numbers the oldest
    latest = latest_frame(df, done).select(*keys, F.col("frame_number").alias("latest_frame"), F.lit(True).alias("any"))
    rows = requests.join(first, [*keys, "frame_number"], "left")
    rows = rows.join(latest, keys, "left") if keys else rows.join(F.broadcast(latest), F.lit(True), "left")  # one row
    hit = F.col("done_seq").isNotNull()
    warning = F.when(F.col("any") & ~hit, F.concat(F.lit('299 vision "frame '), F.col("frame_number").cast("string"), F.lit(" not buffered; returning latest "), F.col("latest_frame").cast("string"), F.lit('"')))
    return rows.select("request_id", *keys, "frame_number", F.when(F.col("any"), 200).otherwise(204).alias("status"), F.when(hit, F.col("frame_number")).otherwise(F.col("latest_frame")).alias("sent_frame"), warning.alias("warning"))


def ticks(span: DataFrame, step_ms: int) -> DataFrame:
    """span: keys, lo, hi. Rows (keys, ts_ms): the multiples of step_ms from the one at or before lo to hi; ranges of TICKS ticks are made apart, so no array and no task has a whole timeline."""
    keys = [c for c in span.columns if c not in ("lo", "hi")]
    first, last = (F.floor(F.col(c) / F.lit(step_ms)).cast("long") for c in ("lo", "hi"))
    ranges = span.select(*keys, last.alias("_last"), F.explode(F.sequence(first, last, F.lit(TICKS).cast("long"))).alias("_first"))
    ranges = ranges.repartition(*keys, "_first")
    n = F.explode(F.sequence("_first", F.least(F.col("_first") + (TICKS - 1), "_last")))
    return ranges.select(*keys, n.alias("_n")).select(*keys, (F.col("_n") * step_ms).alias("ts_ms"))


def tick_snapshots(df: DataFrame, step_ms: int = SSE_TICK, keep_alive: bool = True) -> DataFrame:
    """At each tick from the first second on the most recent frame; before the first one a null frame (keep_alive) or nothing."""
    keys = keys_of(df)
    span = df.groupBy(*keys).agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")).filter("lo is not null")
    found = as_of(ticks(span, step_ms), df, keys, "ts_ms", ["frame_number"], ["frame_number"])
    return found if keep_alive else found.filter(F.col("frame_number").isNotNull())


def window_fps(df: DataFrame, window_ms: int = FPS_WINDOW) -> DataFrame:
    """Rate over drifting windows: a window closes on the first frame more than window_ms after the last close.

    Each close depends on the one before, so the closes are a path of pointers: every time points to the first one
    more than window_ms later. Ranges of a camera's timeline follow the pointers inside them, each by itself, up to
    the time from which the path leaves the range (its exit). Only exits point on to other ranges; pointer doubling
    over their small table, a round for each power of two, marks the exits that the path from the first frame
    meets. A last pass lists the closes in every range from the time at which the path enters it. So a camera that
    is never silent is as many tasks as it has ranges. Frames without a time are left out.
    """
    keys = keys_of(df)
    width = max(RANGE_MS, window_ms + 1)
    rows = numbered(df.filter("ts_ms is not null").select(*keys, "ts_ms", "frame_number"), keys, ["ts_ms", "frame_number"], width, "_nth")
    times = rows.groupBy(*keys, "ts_ms").agg(F.min("_nth").alias("nth")).withColumn("range", F.floor(F.col("ts_ms") / width))
    typed = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def inner_path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms", ignore_index=True)
        ts = pdf.ts_ms.to_numpy(np.int64)
        after = np.searchsorted(ts, ts + window_ms, "right")
        leave = np.arange(len(ts))
        for i in range(len(ts) - 1, -1, -1):
            if after[i] < len(ts):
                leave[i] = leave[after[i]]
        return pdf.assign(exit=ts[leave], exit_nth=pdf.nth.to_numpy()[leave])

    times = kept(times.groupBy(*keys, "range").applyInPandas(inner_path, f"{typed}ts_ms long, nth long, range long, exit long, exit_nth long"), "window-pointers")
    exits = times.select(*keys, F.col("exit").alias("ts_ms")).distinct()
    # the first time after an exit's window: looked up backwards on the negative axis
    beyond = exits.select(*keys, (-(F.col("ts_ms") + window_ms + 1)).alias("_at"))
    found = as_of(beyond, times.withColumn("_at", -F.col("ts_ms")), keys, "_at", ["nth"], ["ts_ms", "exit"], width).filter("ts_ms is not null")
    hops = kept(found.select(*keys, (-F.col("_at") - (window_ms + 1)).alias("here"), F.col("ts_ms").alias("enter"), F.col("exit").alias("there")), "window-hops")

    first = times.groupBy(*keys).agg(F.min_by(F.struct("ts_ms", "exit"), "ts_ms").alias("f"))
    reached = kept(first.select(*keys, F.col("f.exit").alias("here")), "window-exits")
    leaps = hops.select(*keys, "here", "there")
    while True:
        new = kept(reached.join(leaps, [*keys, "here"]).select(*keys, F.col("there").alias("here")), "window-exits")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        onward = leaps.select(*keys, F.col("here").alias("there"), F.col("there").alias("_far"))
        leaps = kept(leaps.join(onward, [*keys, "there"]).select(*keys, "here", F.col("_far").alias("there")), "window-leaps")

    entered = hops.join(reached, [*keys, "here"]).select(*keys, F.col("enter").alias("entry"), F.col("here").alias("before"))
    starts = first.select(*keys, F.col("f.ts_ms").alias("entry"), F.lit(None).cast("long").alias("before"))
    entries = entered.unionByName(starts).withColumn("range", F.floor(F.col("entry") / width))
    numbers = times.select(*keys, F.col("ts_ms").alias("before"), F.col("nth").alias("before_nth"))
    entries = entries.join(numbers, [*keys, "before"], "left")

    def closes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ms", ignore_index=True)
        ts, nth, row = pdf.ts_ms.to_numpy(np.int64), pdf.nth.to_numpy(np.int64), pdf.iloc[0]
        i = int(np.searchsorted(ts, int(row.entry)))
        begins = pd.isna(row.before)  # the path's first time closes nothing
        # the frame with which a camera begins counts in its window; any other that begins one is counted before
        out = [] if begins else [(int(ts[i]), (nth[i] - int(row.before_nth) + (row.before_nth == 1)) * 1000 / (ts[i] - int(row.before)))]
        extra = 1 if begins else 0
        while (j := int(np.searchsorted(ts, ts[i] + window_ms, "right"))) < len(ts):
            out.append((int(ts[j]), (nth[j] - nth[i] + extra) * 1000 / (ts[j] - ts[i])))
            i, extra = j, 0
        return pd.DataFrame(out, columns=["ts_ms", "fps"]).astype({"ts_ms": "int64", "fps": "float64"}).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "ts_ms", "fps"]]

    here = times.select(*keys, "range", "ts_ms", "nth").join(entries, [*keys, "range"])
    return here.groupBy(*keys, "range").applyInPandas(closes, f"{typed}ts_ms long, fps double")


def tumbling_fps(df: DataFrame, window: str = "1 second") -> DataFrame:
    """The usual fixed windows instead: a single partial aggregation."""
    at = F.timestamp_millis("ts_ms")
    return df.groupBy(*keys_of(df), F.window(at, window).alias("w")).agg(F.count(F.lit(1)).alias("frames")).select(*keys_of(df), F.col("w.start").alias("start"), "frames")


def micro_batches(df: DataFrame, size: int) -> DataFrame:
    """Groups of at most `size` frames in order."""
    rows = numbered(df, keys_of(df), ["frame_number"], BUCKET, "_nth")
    return rows.withColumn("batch", F.floor((F.col("_nth") - 1) / size)).drop("_nth")
