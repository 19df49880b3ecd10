"""Column helpers and small relational building blocks that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames that one task sums up in the two-level running sums, and milliseconds of one camera that one task sorts.
BUCKET, RANGE_MS = 4096, 600_000


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def keys_of(df: DataFrame, *more: str) -> list[str]:
    """The optional run and camera keys that df has, and more; without them df is one run of one camera."""
    return [c for c in ("run_id", "camera_id") if c in df.columns] + list(more)


def exclusive_sum(df: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over all rows of the group with a smaller order (a whole number).

    Two levels: sums inside buckets of BUCKET orders, and over the buckets' totals, so no task sorts a whole group.
    """
    bucket = F.floor(F.col(order) / F.lit(BUCKET))
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*group, "_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    rows = rows.alias("r").join(totals.alias("t"), [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*group, "_bucket"]])
    return rows.select("r.*", F.col("t._start")).withColumn(name, (F.col("_inside") + F.col("_start")).cast("long")).drop("_inside", "_start", "_bucket")


def _with_range_row(rows: DataFrame, ranges: DataFrame, group: list[str], *columns: str) -> DataFrame:
    """rows with the columns of their range's row (one for each group and _bucket)."""
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*group, "_bucket"]]
    return rows.alias("r").join(ranges.alias("t"), on).select("r.*", *[f"t.{c}" for c in columns])


def numbered(df: DataFrame, group: list[str], order: list[str], width: int, name: str) -> DataFrame:
    """Adds 1, 2, ... per group by `order`, as row_number does, but sorts ranges of `width` of its first column apart."""
    rows = df.withColumn("_bucket", F.floor(F.col(order[0]) / F.lit(width)))
    ranges = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    rows = _with_range_row(rows, ranges, group, "_start")
    return rows.withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_start", "_place", "_bucket")


def previous(df: DataFrame, group: list[str], order: str, value: str, width: int, name: str) -> DataFrame:
    """Adds `value` of the group's row before, as lag does; a range of `width` orders gets one row of the range before."""
    rows, held = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width))), F.struct(F.col(value).alias("v"))
    ranges = rows.groupBy(*group, "_bucket").agg(F.max_by(held, order).alias("_end"))
    ranges = ranges.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*group).orderBy("_bucket")))
    rows = rows.withColumn("_inside", F.lag(held).over(Window.partitionBy(*group, "_bucket").orderBy(order)))
    rows = _with_range_row(rows, ranges, group, "_carried")
    return rows.withColumn(name, F.coalesce("_inside", "_carried")["v"]).drop("_inside", "_carried", "_bucket")


def following(df: DataFrame, group: list[str], order: str, value: str, width: int, name: str) -> DataFrame:
    """Adds `value` of the group's row after, as lead does, by the same ranges as `previous`."""
    rows = previous(df.withColumn("_down", -F.col(order)), group, "_down", value, width, name)
    return rows.drop("_down")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, width: int, name: str) -> DataFrame:
    """Adds the sum of value over the group's rows up to each, in order; ranges of `width` of the first column are summed apart."""
    rows = df.withColumn("_bucket", F.floor(F.col(order[0]) / F.lit(width)))
    ranges = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_range_row(rows.withColumn("_inside", F.sum(value).over(inside)), ranges, group, "_start")
    return rows.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_start", "_inside", "_bucket")


def as_of(ticks: DataFrame, events: DataFrame, group: list[str], at: str, order: list[str], packet: list[str], width: int = RANGE_MS) -> DataFrame:
    """Each tick with the columns `packet` of the last event at or before it (nulls before the first).

    Ranges of `width` are sorted apart; each gets the last event before it, of which there is one.
    """
    e = events.select(*group, F.col(at).alias("_at"), F.lit(0).alias("_kind"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*packet).alias("_packet"))
    t = ticks.select(*group, F.col(at).alias("_at"), F.lit(1).alias("_kind"))
    both = e.unionByName(t, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / F.lit(width))).repartition(*group, "_bucket")
    place = [f"_o{i}" for i in range(len(order))]
    ranges = both.groupBy(*group, "_bucket").agg(F.max_by("_packet", F.when(F.col("_kind") == 0, F.struct("_at", *place))).alias("_end"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier))
    w = Window.partitionBy(*group, "_bucket").orderBy("_at", "_kind", *place).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_packet", F.last("_packet", ignorenulls=True).over(w)).filter("_kind = 1")
    found = _with_range_row(found, ranges, group, "_carried").withColumn("_packet", F.coalesce("_packet", "_carried"))
    return found.select(*group, F.col("_at").alias(at), *[F.col(f"_packet.{c}").alias(c) for c in packet])


def open_file(path: str):
    """A file that a task reads piece by piece, through pyarrow's file systems."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(inner)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only in one process without such a setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lenswork-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage; every round of an iteration ends so."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Intervals that a range of values is cut into in a round of the selection, values from which on an interval is
#: read out, and open intervals up to which their table is broadcast (some 50 bytes each).
CUTS, FEW, FEW_INTERVALS = 1024, 4096, 20_000


def _same(left: str, right: str, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def exact_quantiles(df: DataFrame, keys: list[str], value: str, rates: tuple[float, ...], name: str = "quantiles") -> DataFrame:
    """Rows (keys, name): the array of exact quantiles of each key's values, interpolated as percentile does; nulls don't count.

    A distributed selection: each wanted rank has an interval of values that holds it. A round counts the values
    of all open intervals in CUTS parts and goes on with the part that has the rank, bounded by its own least and
    greatest value, until it holds FEW values or equal ones. So no task holds the values of a key, however many
    differ, and what is shuffled are counts. NaN is the greatest value.
    """
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(*keys, v.alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.array(*[f(place(q)).cast("long") for q in rates for f in (F.floor, F.ceil)]))
    found = kept(sizes.select(*keys, "_n", "_low", "_high", F.col("_n").alias("_held"), F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_before")), "ranks")
    open_ = (F.col("_low") != F.col("_high")) & (F.col("_held") > FEW)
    span = [*keys, "_low", "_high"]

    def within(intervals: DataFrame) -> DataFrame:
        few = intervals.limit(FEW_INTERVALS + 1).count() <= FEW_INTERVALS
        i = (F.broadcast(intervals) if few else intervals).alias("i")
        return rows.alias("r").join(i, _same("r", "i", keys) & F.col("_v").between(F.col("_low"), F.col("_high"))).select(*[F.col(f"i.{c}").alias(c) for c in span], "_v")

    while not found.filter(open_).isEmpty():
        width = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * CUTS
        endless = F.when(F.isnan("_v"), CUTS + 2).when(F.col("_v") == float("inf"), CUTS + 1).when(F.col("_v") == float("-inf"), -1)
        # bounds that are not finite, or whose distance isn't, are cut by sign and size instead
        size = F.signum("_v") * F.log1p(F.abs("_v"))
        part = F.coalesce(endless, F.when(F.abs(F.col("_high") - F.col("_low")) < float("inf"), F.floor(width)), F.floor(size)).cast("long")
        counts = within(found.filter(open_).select(*span).distinct()).withColumn("_part", part)
        counts = counts.groupBy(*span, "_part").agg(F.count(F.lit(1)).alias("_count"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = Window.partitionBy(*span).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_count").over(upto))
        held = found.filter(open_).alias("f").join(counts.alias("c"), _same("f", "c", span))
        inside = (F.col("_rank") < F.col("_before") + F.col("_upto")) & (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_count"))
        new = held.filter(inside).select(*[f"f.{k}" for k in keys], "_n", F.col("_least").alias("_low"), F.col("_most").alias("_high"), F.col("_count").alias("_held"), "_rank", (F.col("_before") + F.col("_upto") - F.col("_count")).alias("_before"))
        found = kept(new.unionByName(found.filter(~open_)), "ranks")
    narrow = found.filter("_low <> _high")
    values = within(narrow.select(*span).distinct()).groupBy(*span, "_v").agg(F.count(F.lit(1)).alias("_count"))
    values = values.withColumn("_upto", F.sum("_count").over(Window.partitionBy(*span).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = narrow.alias("f").join(values.alias("c"), _same("f", "c", span)).filter((F.col("_rank") < F.col("_before") + F.col("_upto")) & (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_count")))
    hit = hit.select(*[f"f.{k}" for k in keys], "_n", "_rank", "_v").unionByName(found.filter("_low = _high").select(*keys, "_n", "_rank", F.col("_low").alias("_v")))
    sums = hit.groupBy(*keys).agg(F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_of"))
    at = lambda q, f: F.col("_of")[f(place(q)).cast("long")]
    mixed = lambda q: F.when(F.floor(place(q)) == F.ceil(place(q)), at(q, F.floor)).otherwise((F.ceil(place(q)) - place(q)) * at(q, F.floor) + (place(q) - F.floor(place(q))) * at(q, F.ceil))
    return sums.select(*keys, F.array(*map(mixed, rates)).alias(name))
