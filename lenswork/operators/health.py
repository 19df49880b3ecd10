"""Heartbeats: stalls, the watchdog and restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import RANGE_MS, following, keys_of, running_sum

#: Fixed values in ms, and the components in the order in which they are blamed.
STALL, POLL, GRACE = 1500, 500, 5000
COMPONENTS = ["capture", "processing", "encoding"]


def stalls(beats: DataFrame, threshold: int = STALL) -> DataFrame:
    """Beats that are followed by more than `threshold` ms of silence (keys, component, ts_ms, gap_ms); ranges of time are looked at apart."""
    keys = [*keys_of(beats), "component"]
    rows = following(beats.select(*keys, "ts_ms"), keys, "ts_ms", "ts_ms", RANGE_MS, "_next").withColumn("gap_ms", F.col("_next") - F.col("ts_ms"))
    return rows.filter(F.col("gap_ms") > threshold).select(*keys, "ts_ms", "gap_ms")


def watchdog_trigger(beats: DataFrame, runs: DataFrame, threshold: int = STALL, poll: int = POLL, grace: int = GRACE) -> DataFrame:
    """runs: keys, start_ms, end_ms. The first poll of each run that finds a component stale, and that component.

    Until its first beat a component's last beat is the start plus the grace time. No polls are listed: a stamp is
    stale at the first poll that is more than the threshold after it, if that poll comes before the next beat.
    """
    keys = keys_of(runs)
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(c).alias("component")) for i, c in enumerate(COMPONENTS)]))
    each = runs.select(*keys, "start_ms", "end_ms", names.alias("c")).select(*keys, "start_ms", "end_ms", "c.rank", "c.component")
    by = [*keys, "component"]
    known = beats.filter(F.col("component").isin(COMPONENTS) & F.col("ts_ms").isNotNull()).select(*by, "ts_ms")
    stamps = following(known, by, "ts_ms", "ts_ms", RANGE_MS, "next_ms").join(each, by).select(*keys, "start_ms", "end_ms", "rank", "component", F.col("ts_ms").alias("stamp"), "next_ms")
    first = known.groupBy(*by).agg(F.min("ts_ms").alias("next_ms"))
    graces = each.join(first, by, "left").select(*keys, "start_ms", "end_ms", "rank", "component", (F.col("start_ms") + grace).alias("stamp"), "next_ms")
    nth = F.greatest(F.lit(1).cast("long"), F.floor((F.col("stamp") + threshold - F.col("start_ms")) / F.lit(poll)) + 1)
    rows = stamps.unionByName(graces).withColumn("ts_ms", F.col("start_ms") + nth * poll)
    rows = rows.filter((F.col("ts_ms") <= F.col("end_ms")) & (F.col("next_ms").isNull() | (F.col("ts_ms") < F.col("next_ms"))))
    return rows.groupBy(*keys).agg(F.min(F.struct("ts_ms", "rank", "component")).alias("m")).select(*keys, F.col("m.ts_ms").alias("trigger_ms"), F.col("m.component").alias("component"))


def restart_runs(events: DataFrame, restart: str = "is_restart") -> DataFrame:
    """Adds run_id: how many restarts came up to each event; ranges of time are summed apart."""
    rows = events.drop("run_id").withColumn("_restart", F.coalesce(F.col(restart).cast("long"), F.lit(0)))
    return running_sum(rows, keys_of(rows), ["ts_ms", "event_id"], "_restart", RANGE_MS, "run_id").drop("_restart")


def restarts_by_reason(events: DataFrame, restart: str = "is_restart", reason: str = "reason") -> DataFrame:
    return events.filter(restart).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
