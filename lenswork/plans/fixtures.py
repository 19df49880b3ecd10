"""Frames, heartbeats, predictions, overlays and so on, derived from the given tables.

The same text states a view for Spark and for DuckDB; only the words in `SPARK` and `DUCK` differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "frames": """select camera_id, event_id, ts_ms, row_number() over (partition by camera_id order by ts_ms, event_id) frame_number, 640 width, 480 height
        from (select user_id % 4 camera_id, event_id, {us} {div} 5000000 - 340813440 ts_ms from events) q""",
    "heartbeats": """select user_id % 4 camera_id, event_id, {us} {div} 5000000 - 340813440 ts_ms,
        case event_type when 'click' then 'capture' when 'view' then 'processing' else 'encoding' end component
        from events where event_type in ('click', 'view', 'purchase')""",
    "trace_events": """select event_id idx, case when event_type in ('click', 'view') then 'b' when event_type = 'signup' then 'M' else 'e' end ph,
        user_id id, cast({k} as int) % 4 tid, {us} ts, event_type name from events""",
    "metrics": """select case when event_type in ('click', 'view') then 'vision_stage_latency_seconds' when event_type = 'error' then 'vision_encoding_errors_total'
            when event_type = 'signup' then 'vision_pipeline_fps' else 'vision_queue_depth' end name,
        case when event_type in ('click', 'view') then 'histogram' when event_type = 'error' then 'counter' else 'gauge' end kind,
        case when event_type in ('click', 'view') then 'stage' when event_type = 'error' then 'path' when event_type = 'signup' then 'none' else 'queue' end label_key,
        case user_id % 3 when 0 then 'capture' when 1 then 'processing' else 'encoding' end label_val,
        cast((event_id * 7919 + user_id * 31) % 1000 as double) / 8 value, {us} ts, event_id seq from events""",
    "raw_preds": """select l_orderkey {div} 8 frame_number,
        row_number() over (partition by l_orderkey {div} 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) pred_idx,
        cast(80 + (l_partkey % 12) * 40 as double) x, cast(80 + (l_suppkey % 10) * 48 as double) y, 60 + l_quantity * 3 w, 60 + (l_quantity % 17) * 9 h,
        cast((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000 as double) / 1000 score, (l_linenumber - 1) % 4 class_id from lineitem""",
    "markers": """select c_custkey marker_id, (c_custkey * 37 % 12000 - 6000) / cast(100 as double) lat, (c_custkey * 91 % 36000 - 18000) / cast(100 as double) lng from customer""",
    "zone_vertices": """select n_nationkey zone_id, ring, vtx, cast(-50 + n_nationkey * 4 + dlat as double) lat, cast(-170 + n_nationkey * 13 + dlng as double) lng
        from nation cross join (values (0,0,0,0),(0,1,0,20),(0,2,8,20),(0,3,4,10),(0,4,8,0),(1,0,1,2),(1,1,1,5),(1,2,3,5),(1,3,3,2)) v(ring, vtx, dlat, dlng)
        where ring = 0 or n_nationkey % 2 = 0""",
    "plots": """select c_custkey zone_id, ring, vtx, cast(-50 + c_custkey % 25 * 4 + dlat * (1 + c_custkey % 7) / cast(7 as double) as double) lat, cast(-170 + c_custkey % 25 * 13 + dlng as double) lng
        from customer cross join (values (0,0,0,0),(0,1,0,20),(0,2,8,20),(0,3,4,10),(0,4,8,0)) v(ring, vtx, dlat, dlng)""",
    "routes": """select o_custkey route_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) seq,
        (o_orderkey * 37 % 12000 - 6000) / cast(100 as double) lat, (o_orderkey * 91 % 36000 - 18000) / cast(100 as double) lng from orders""",
    "overlay_log": """select event_id op_id, user_id % 50 overlay_id, case when event_type = 'error' then 'delete' else 'upsert' end op,
        case cast({k} as int) % 4 when 0 then 'marker' when 1 then 'polyline' when 2 then 'polygon' else 'rectangle' end type, {us} ts from events""",
    "overlays": """select c_custkey overlay_id, case c_custkey % 5 when 0 then 'marker' when 1 then 'polyline' when 2 then 'polygon' when 3 then 'rectangle' else 'connector' end type,
        c_custkey * 7919 % 10007 created, c_name label, case when c_custkey % 5 = 4 then c_custkey - 4 end start_id, case when c_custkey % 5 = 4 then c_custkey - 2 end end_id from customer""",
    "pixels": """select vec_id frame_number, pos px, cast(least(255, greatest(0, round(128 + cast(v as double) * 400))) as int) g from ({exp}) q""",
}
SPARK = {
    "us": "unix_micros(cast(ts as timestamp))", "div": "div", "k": "get_json_object(props, '$.k')",
    "exp": "select vec_id, pos, v from embeddings lateral view posexplode(embedding) p as pos, v",
}
DUCK = {
    "us": "epoch_us(ts)", "div": "//", "k": "json_extract_string(props, '$.k')",
    "exp": "select vec_id, generate_subscripts(embedding, 1) - 1 pos, unnest(embedding) v from embeddings",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _fill(text: str, words: dict[str, str]) -> str:
    for name, value in words.items():
        text = text.replace("{" + name + "}", value)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a given table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _fill(VIEWS[name], SPARK)
    used = [t for t in TABLES if re.search(rf"\b(from|join)\s+{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def duck(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL with the named views in front; a statement that has its own `with` goes on after a comma."""
    views = ",\n".join(f"{n} as ({_fill(VIEWS[n], DUCK)})" for n in names)
    body = sql.strip()
    body = ",\n" + body[5:] if body.startswith("with ") else "\n" + body
    return f"with {'recursive ' if recursive else ''}{views}{body}"
