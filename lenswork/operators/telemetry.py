"""Metrics and trace spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import exact_quantiles, kept

#: Range of idx in which an id's events are paired by themselves.
SEGMENT = 16_384
#: Rates of the histograms' quantiles.
QUANTILES = (0.5, 0.95, 0.99)
#: Metric of the stage latencies, its stages, and the metric of encode errors.
STAGE_METRIC, STAGES, ERROR_METRIC = "vision_stage_latency_seconds", ["capture", "processing", "encoding"], "vision_encoding_errors_total"


def aggregate_metrics(df: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """metrics (name, kind, label_key, label_val, value, ts, seq): counters' sums, gauges' last values, histograms' count, sum and quantiles.

    Quantiles are exact and selected from counts of ranges, so a series' values never meet in one task. A stream
    has no second look at its rows; there the distinct values of a series are kept.
    """
    series = ["name", "kind", "label_key", "label_val"]
    sums = [F.count(F.lit(1)).alias("count"), F.sum("value").alias("_sum"), F.max_by("value", F.struct("ts", "seq")).alias("_last")]
    if df.isStreaming:
        at = F.percentile(F.when(F.col("kind") == "histogram", F.col("value")), F.array(*map(F.lit, quantiles)))
        rows = df.groupBy(*series).agg(*sums, at.alias("_q"))
    else:
        q = exact_quantiles(df.filter("kind = 'histogram'"), series, "value", quantiles, "_q")
        rows = df.groupBy(*series).agg(*sums).alias("m").join(q.alias("q"), _all_equal(series), "left").select("m.*", "q._q")
    out = rows.withColumn("value", F.when(F.col("kind") == "gauge", F.col("_last")).otherwise(F.col("_sum")))
    q = [F.when(F.col("kind") == "histogram", F.col("_q")[i]).alias(f"p{round(100 * x)}") for i, x in enumerate(quantiles)]
    return out.select("name", "kind", "label_key", "label_val", "count", "value", *q)


def _all_equal(columns: list[str]):
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"m.{c}").eqNullSafe(F.col(f"q.{c}"))
    return on


def stage_latency(df: DataFrame) -> DataFrame:
    """Exact quantiles of the latency of each stage (rows stage, value)."""
    counts = df.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(df, ["stage"], "value", QUANTILES, "_q")
    rows = counts.alias("m").join(q.alias("q"), _all_equal(["stage"]), "left")
    return rows.select("m.stage", "m.n", *[F.col("_q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(QUANTILES)])


def _paired(events: DataFrame) -> DataFrame:
    """What pair_spans gives, with the partner's thread and time.

    Brackets are matched in segments: each range of SEGMENT idx of an id pairs what it can by windows and is left
    with some ends and, after them, some begins. Sums over the segments (a row each) give the depth of the open
    begins between segments, and so the level that every such end takes from and every such begin adds. A segment
    adds to and takes from a level once, so a level's events are few, and a begin belongs to the next event there.
    """
    rows = events.filter("ph in ('b', 'e')").withColumn("tid", F.coalesce("tid", F.lit(0)))
    partner = {"pair": F.lit(None).cast("long"), "other_tid": F.lit(None).cast("int"), "other_ts": F.lit(None).cast(events.schema["ts"].dataType)}
    columns = ["idx", "ph", "id", "tid", "ts", "name", *partner]
    alone = rows.filter("id is null").withColumns(partner).select(*columns)
    rows = rows.filter("id is not null").withColumn("segment", F.floor(F.col("idx") / SEGMENT))

    by = Window.partitionBy("id", "segment").orderBy("idx")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("raw", F.sum(F.when(F.col("ph") == "b", 1).otherwise(-1)).over(upto))
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("raw").over(upto)))
    lone = (F.col("ph") == "e") & (F.col("floor") < F.coalesce(F.lag("floor").over(by), F.lit(0)))
    rows = rows.withColumn("lone", lone).withColumn("depth", F.col("raw") - F.col("floor") + F.when(F.col("ph") == "e", 1).otherwise(0))

    def matched(rows: DataFrame, place: Window) -> DataFrame:
        after, before = F.lead("ph").over(place), F.lag("ph").over(place)
        of = lambda c: F.when((F.col("ph") == "b") & (after == "e"), F.lead(c).over(place)).when((F.col("ph") == "e") & (before == "b"), F.lag(c).over(place))
        return rows.withColumns({"pair": of("idx"), "other_tid": of("tid"), "other_ts": of("ts")})

    inner = matched(rows, Window.partitionBy("id", "segment", "lone", "depth").orderBy("idx"))
    inner = kept(inner.withColumn("open", F.col("lone") | F.col("pair").isNull()).select(*columns, "segment", "lone", "floor", "open"), "paired-in-segments")
    left = inner.filter("open").drop(*partner)

    # how many begins are open before each segment: it takes `ends` at most, then adds `begins`
    sums = left.groupBy("id", "segment").agg(F.sum(F.col("lone").cast("long")).alias("ends"), F.sum((~F.col("lone")).cast("long")).alias("begins"))
    line = Window.partitionBy("id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("taken", F.sum(F.col("begins") - F.col("ends")).over(line) - F.col("begins"))  # after its ends
    sums = sums.withColumn("low", F.least(F.lit(0), F.min("taken").over(line)))
    before = F.coalesce(F.lag(F.col("taken") + F.col("begins") - F.col("low")).over(Window.partitionBy("id").orderBy("segment")), F.lit(0))
    sums = sums.select("id", "segment", before.alias("height"), (F.col("taken") - F.col("low")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("id", "segment", "lone").orderBy("idx"))
    level = F.when(F.col("lone"), F.col("height") + F.col("floor") + 1).otherwise(F.col("base") + nth)
    outer = left.join(sums, ["id", "segment"]).withColumn("level", level).filter("level >= 1")  # ends below the lowest are orphans
    outer = matched(outer, Window.partitionBy("id", "level").orderBy("idx"))
    return inner.filter("not open").select(*columns).unionByName(outer.select(*columns)).unionByName(alone)


def pair_spans(events: DataFrame) -> DataFrame:
    """Last-in-first-out pairs of begins (`b`) and ends (`e`) of an id, matched in segments of idx.

    An end that no open begin precedes is an orphan and goes. Events without an id stay alone. Adds pair (idx of the partner).
    """
    return _paired(events).drop("other_tid", "other_ts")


def normalise_trace(events: DataFrame) -> DataFrame:
    """Metadata first, then spans by time: pairs on one thread as B and E without an id, others as b and e; begins before ends at equal times."""
    rows = _paired(events)
    sync = F.col("tid") == F.col("other_tid")
    span = F.when(F.col("pair").isNotNull(), F.least("idx", "pair")).when(F.col("ph") == "b", F.col("idx"))
    spans = rows.select("idx", F.when(sync, F.upper("ph")).otherwise(F.col("ph")).alias("ph"), F.when(~F.coalesce(sync, F.lit(False)), span).alias("id"), "tid", F.coalesce("ts", F.lit(0)).alias("ts"), "name")
    meta = events.filter("ph not in ('b', 'e')").select("idx", "ph", "id", "tid", F.coalesce("ts", F.lit(0)).alias("ts"), "name")
    rank = F.when(F.col("ph") == "B", 0).when(F.col("ph") == "E", 1).otherwise(2)
    both = meta.unionByName(spans).withColumns({"is_meta": F.col("ph") == "M", "phase_rank": rank})
    return both


def trace_order() -> list:
    """The order of a trace file."""
    return [F.col("is_meta").desc(), F.when(F.col("is_meta"), F.lit(0)).otherwise(F.col("ts")), F.when(F.col("is_meta"), F.lit(0)).otherwise(F.col("phase_rank")), F.col("idx")]


def span_durations(events: DataFrame) -> DataFrame:
    """Count, mean and longest duration of the paired spans by name of the begin."""
    rows = _paired(events).filter("ph = 'b' and pair is not null").withColumn("d", F.col("other_ts") - F.col("ts"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total"), F.max("d").alias("longest"))


def encode_errors(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("name") == ERROR_METRIC).groupBy(F.col("label_val").alias("path")).agg(F.sum("value").alias("errors"))
