"""What only larger tables show: the queries on sf0.001 with keys and values far up."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lenswork.operators import detection as D
from lenswork.plans import fixtures
from lenswork.plans.queries import ORACLE_SQL, QUERIES
from lenswork.sources import records
from tests.conftest import compare


def copy_of(sf, folder, **replaced):
    """The tables of sf with those that `replaced` has as SQL over {t}."""
    for f in os.listdir(sf):
        name = f.removesuffix(".parquet")
        if name in replaced:
            duckdb.sql(f"copy ({replaced[name].format(t=f"'{sf}/{f}'")}) to '{folder}/{f}' (format parquet)")
        else:
            os.symlink(f"{sf}/{f}", f"{folder}/{f}")
    return str(folder)


def test_overlays_at_broadcasts_neither_markers_nor_their_order(spark, sf):
    """By its file's size a table of 900,000 markers is small (4 MB); only the shapes in cells may be sent to all tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = QUERIES["overlays_at"](spark, sf)
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan
    assert all("level" in keys for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)), plan


def test_draw_list_of_frames_beyond_a_million(spark, sf, tmp_path):
    far = copy_of(sf, tmp_path, lineitem="select * replace (l_orderkey + 9000000 as l_orderkey) from {t}")
    compare(spark, far, QUERIES["draw_list"], ORACLE_SQL["draw_list"])


def test_frame_info_text_of_frames_beyond_a_million(spark, sf, monkeypatch):
    near, far = "event_id) frame_number", "event_id) + 999990 frame_number"
    assert near in fixtures.VIEWS["frames"] and near in ORACLE_SQL["frame_info_text"]
    monkeypatch.setitem(fixtures.VIEWS, "frames", fixtures.VIEWS["frames"].replace(near, far))
    compare(spark, sf, QUERIES["frame_info_text"], ORACLE_SQL["frame_info_text"].replace(near, far))


def test_the_operator_writes_all_digits_of_a_frame(spark):
    rows = spark.createDataFrame([(n, 0.0, 640, 480) for n in (7, 1_000_000)], "frame_number long, fps double, width int, height int")
    assert [r.info_text for r in D.frame_info_text(rows).orderBy("frame_number").collect()] == ["FRAME 000007  FPS  0.0", "FRAME 1000000  FPS  0.0"]


def test_metric_lines_of_large_sums(spark, sf, monkeypatch):
    """Sums from ten million on, which Spark writes with an exponent."""
    near, far = "/ 8 value", "* 100000 / 8 value"
    assert near in fixtures.VIEWS["metrics"] and near in ORACLE_SQL["metric_lines"]
    monkeypatch.setitem(fixtures.VIEWS, "metrics", fixtures.VIEWS["metrics"].replace(near, far))
    compare(spark, sf, QUERIES["metric_lines"], ORACLE_SQL["metric_lines"].replace(near, far))


@pytest.mark.parametrize("sign", [1, -1])
def test_numbers_as_duckdb_writes_them(spark, sign):
    numbers = [0.0, 1.0, 0.1, 0.001, 0.00099, 0.0001, 0.00012345678901234567, 0.00001, 1.5e-5, 2e-300, 9999999.5, 1e7, 12345678.125, 9007199254740992.0, 9.9e15, 1e16, 1.5e17, 1e100, float("inf")]
    numbers = [sign * x for x in numbers]
    wanted = [duckdb.execute("select cast(?::double as varchar)", [x]).fetchone()[0] for x in numbers]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*numbers, None, float("nan")])], "k int, x double")
    got = [r.t for r in rows.select("k", records.plain_number(F.col("x")).alias("t")).orderBy("k").collect()]
    assert got == [*wanted, None, "nan"]
