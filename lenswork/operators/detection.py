"""Detections: from raw prediction rows to suppressed, scaled, labelled and numbered boxes.

Raw predictions are rows (frame_number, pred_idx, x, y, w, h, score, class_id), with optional
run_id and camera_id. Everything but numbering is stateless per frame, so all but `nms`,
`topk_per_frame` and `assign_track_ids` are plain projections and also work on streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import clamp, exclusive_sum, keys_of

#: Thresholds, sizes and names that results depend on.
CONFIDENCE, IOU, TOP_K = 0.25, 0.45, 512
LABELS = {0: "FACE", 1: "PERSON"}
OTHER_LABEL = "OBJECT"
LABEL_RISE, GLYPH_WIDTH, GLYPH_HEIGHT = 12, 6, 8
LABEL_COLOR, BACKGROUND, INFO_COLOR = "0,255,0,255", "0,0,0,180", "255,255,255,255"
EPSILON = 1e-6
BOX = ["x1", "y1", "x2", "y2"]
#: Cells along a side of a frame at most, where pairs of its boxes are looked for.
GRID = 32


def explode_predictions(df: DataFrame, tensor: str = "tensor") -> DataFrame:
    """Channels-by-predictions arrays to rows; at least five channels, the class is the sixth, cut to a whole number."""
    t = F.col(tensor)
    checked = df.withColumn(tensor, F.when(F.assert_true(F.size(t) >= 5, F.lit("a prediction needs at least 5 channels")).isNull(), t))
    rest = [c for c in df.columns if c != tensor]
    rows = checked.select(*rest, tensor, F.posexplode(t[0]).alias("pos", "x"))
    at = lambda k: F.col(tensor)[k][F.col("pos")]
    class_id = F.when(F.size(tensor) > 5, F.get(F.get(F.col(tensor), F.lit(5)), F.col("pos")).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select(*rest, (F.col("pos") + 1).alias("pred_idx"), F.col("x").cast("double").alias("x"), *[at(k).cast("double").alias(n) for k, n in ((1, "y"), (2, "w"), (3, "h"), (4, "score"))], class_id.alias("class_id"))


def filter_confidence(df: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Rows with at least the score; NaN and null scores go (Spark holds NaN for larger than any number)."""
    return df.filter((F.col("score") >= threshold) & ~F.isnan("score"))


def topk_per_frame(df: DataFrame, k: int = TOP_K, mode: str = "by_score") -> DataFrame:
    """The k best (by_score) or the first k (by_order) rows of each frame; ties go by pred_idx."""
    order = [F.col("score").desc(), F.col("pred_idx")] if mode == "by_score" else [F.col("pred_idx")]
    w = Window.partitionBy(*keys_of(df, "frame_number")).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def xywh_to_corners(df: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Centre and size to corners, clamped to [0, side - 1] where a size is given."""
    c = {"x1": F.col("x") - F.col("w") / 2, "y1": F.col("y") - F.col("h") / 2, "x2": F.col("x") + F.col("w") / 2, "y2": F.col("y") + F.col("h") / 2}
    return clamp_boxes(df.withColumns(c).drop("x", "y", "w", "h"), width, height)


def clamp_boxes(df: DataFrame, width: int | None, height: int | None) -> DataFrame:
    if width is None or height is None:
        return df
    side = {"x": width - 1.0, "y": height - 1.0}
    return df.withColumns({c: clamp(F.col(c), 0.0, side[c[0]]) for c in BOX})


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (structs of x1, y1, x2, y2) over their union; negative sides count as zero."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    inter = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    area = lambda s: side(s["x1"], s["x2"]) * side(s["y1"], s["y2"])
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / (area(a) + area(b) - inter + EPSILON))


def nms(df: DataFrame, threshold: float = IOU) -> DataFrame:
    """Greedy suppression per frame, over all classes: best score first (ties by pred_idx), a box goes if it overlaps a kept one by more.

    One shuffle on the frame. A frame's boxes are an array; after `topk_per_frame` at most TOP_K long.
    """
    keys = keys_of(df, "frame_number")
    box = F.struct((-F.col("score")).alias("rank"), "pred_idx", *BOX, "class_id")
    boxes = df.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    keep = lambda kept, d: F.when(F.exists(kept, lambda k: iou(k, d) > threshold), kept).otherwise(F.concat(kept, F.array(d)))
    kept = boxes.select(*keys, F.aggregate("boxes", F.slice("boxes", 1, 0), keep).alias("kept"))
    rows = kept.select(*keys, F.posexplode("kept").alias("det_idx", "d"))
    return rows.select(*keys, "det_idx", "d.pred_idx", *[f"d.{c}" for c in BOX], (-F.col("d.rank")).alias("score"), "d.class_id")


def iou_pairs(df: DataFrame, least: float = IOU) -> DataFrame:
    """Pairs of boxes of one frame that overlap by more than `least`.

    A frame is cut into cells of twice its boxes' mean sides (its extent has GRID cells a side at most). Boxes meet
    in the cells that they touch, and a pair counts in the one that has its overlap's first corner, so a crowded
    frame is not all pairs of its boxes. Boxes without an area overlap nothing.
    """
    keys = keys_of(df, "frame_number")
    boxes = df.filter("x2 > x1 and y2 > y1").select(*keys, "pred_idx", *BOX)
    sides = boxes.groupBy(*keys).agg(*[F.greatest(F.avg(F.col(f"{c}2") - F.col(f"{c}1")) * 2, (F.max(f"{c}2") - F.min(f"{c}1")) / GRID).alias(f"_side_{c}") for c in "xy"])
    rows = boxes.join(sides, keys)
    cell = lambda c, at: F.floor(at / F.col(f"_side_{c}"))
    for c in "xy":
        rows = rows.withColumn(f"_cell_{c}", F.explode(F.sequence(cell(c, F.col(f"{c}1")), cell(c, F.col(f"{c}2")))))
    place = [*keys, "_cell_x", "_cell_y"]
    other = rows.select(*place, *[F.col(c).alias(f"{c}_b") for c in ("pred_idx", *BOX)])
    rows = rows.join(other, place).filter("pred_idx < pred_idx_b and x1 < x2_b and x1_b < x2 and y1 < y2_b and y1_b < y2")
    first = [F.col(f"_cell_{c}") == cell(c, F.greatest(f"{c}1", f"{c}1_b")) for c in "xy"]
    of = lambda end: F.struct(*[F.col(f"{c}{end}").alias(c) for c in BOX])
    rows = rows.filter(first[0] & first[1]).withColumn("iou", iou(of(""), of("_b"))).filter(F.col("iou") > least)
    return rows.select(*keys, F.col("pred_idx").alias("pred_a"), F.col("pred_idx_b").alias("pred_b"), "iou")


def rescale_boxes(df: DataFrame, src_w, src_h, det_w, det_h) -> DataFrame:
    """From detector to source pixels; a detector side of 0 or less scales by 1. Sizes are numbers or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    scale = lambda s, d: F.when(d > 0, s / d).otherwise(F.lit(1.0))
    sw, sh, dw, dh = map(lit, (src_w, src_h, det_w, det_h))
    return df.withColumns({c: clamp(F.col(c) * (scale(sw, dw) if c[0] == "x" else scale(sh, dh)), F.lit(0.0), F.greatest(F.lit(0.0), (sw if c[0] == "x" else sh) - 1)) for c in BOX})


def boxes_px(df: DataFrame) -> DataFrame:
    """Whole pixels, halves away from zero."""
    return df.withColumns({c: F.round(c).cast("int") for c in BOX})


def class_label(df: DataFrame) -> DataFrame:
    label = F.lit(OTHER_LABEL)
    for k, name in LABELS.items():
        label = F.when(F.col("class_id") == k, name).otherwise(label)
    return df.withColumn("class", label)


def assign_track_ids(df: DataFrame) -> DataFrame:
    """A running number from 0 over a run's detections, by frame and then detection order.

    Counts per frame, a two-level running sum of these, then numbers inside the frame: no sort of all detections.
    """
    run = [c for c in ("run_id",) if c in df.columns]
    within = keys_of(df, "frame_number")
    frames = df.groupBy(*run, "frame_number").agg(F.count(F.lit(1)).alias("_n"))
    base = exclusive_sum(frames, run, "frame_number", "_n", "_base").drop("_n")
    order = [c for c in within if c not in (*run, "frame_number")] + ["det_idx"]
    place = F.row_number().over(Window.partitionBy(*run, "frame_number").orderBy(*order)) - 1
    return df.withColumn("_place", place).join(base, [*run, "frame_number"]).withColumn("track_id", F.col("_base") + F.col("_place")).drop("_base", "_place")


def label_text(df: DataFrame) -> DataFrame:
    """`class track score%`; an exact half of a percent goes to the even number."""
    percent = F.bround(F.col("score") * 100).cast("long").cast("string")
    return df.withColumn("label_text", F.concat(F.concat_ws(" ", "class", F.col("track_id").cast("string"), percent), F.lit("%")))


def label_layout(df: DataFrame) -> DataFrame:
    """The label's corner and background: above the box, inside the picture."""
    return df.withColumns({"label_x": F.round("x1").cast("int"), "label_y": F.greatest(F.lit(0), F.round("y1").cast("int") - LABEL_RISE), "label_w": F.length("label_text") * GLYPH_WIDTH, "label_h": F.lit(GLYPH_HEIGHT)})


def frame_info_text(df: DataFrame, width: str = "width", height: str = "height", number: Column | None = None) -> DataFrame:
    """The frame's own line, its corner at the lower right and its width; a rate half-way between two tenths goes to the even one.

    number: how the frame's number is written; without it in six digits, or more where it has more.
    """
    half_way = F.col("fps") * 4 % 2 == 1  # only quarters are exactly half-way
    number = F.format_string("%06d", "frame_number") if number is None else number
    text = F.format_string("FRAME %s  FPS %4.1f", number, F.when(half_way, F.bround("fps", 1)).otherwise(F.col("fps")))
    rows = df.withColumn("info_text", text).withColumn("info_w", F.least(F.length("info_text") * GLYPH_WIDTH, F.col(width)))
    return rows.withColumns({"info_x": F.greatest(F.lit(0), F.col(width) - F.col("info_w") - 4), "info_y": F.greatest(F.lit(0), F.col(height) - LABEL_RISE)})


def _item(kind: str, x, y, w, h, text, color: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"), text.alias("text"), F.lit(color).alias("color"))


def draw_list(df: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """What annotation draws, as rows (keys, track_id, kind, x, y, w, h, text, color as red, green, blue, opacity).

    frames: rows of frame_info_text, whose lines are drawn too (without a track).
    """
    none, c = F.lit(None).cast("string"), F.col
    items = F.array(
        _item("rect", F.round("x1"), F.round("y1"), F.round("x2").cast("int") - F.round("x1").cast("int"), F.round("y2").cast("int") - F.round("y1").cast("int"), none, LABEL_COLOR),
        _item("label_bg", c("label_x"), c("label_y"), c("label_w"), c("label_h"), none, BACKGROUND),
        _item("text", c("label_x"), c("label_y"), c("label_w"), c("label_h"), c("label_text"), LABEL_COLOR),
    )
    out = df.select(*keys_of(df, "frame_number", "track_id"), F.inline(items))
    if frames is None:
        return out
    high = F.lit(GLYPH_HEIGHT)
    info = F.array(_item("info_bg", c("info_x"), c("info_y"), c("info_w") + 4, high, none, BACKGROUND), _item("info", c("info_x") + 2, c("info_y"), c("info_w"), high, c("info_text"), INFO_COLOR))
    return out.unionByName(frames.select(*keys_of(frames, "frame_number"), F.lit(None).cast("long").alias("track_id"), F.inline(info)))


def detect(frames: DataFrame, model_fn: Callable, schema: str, columns: list[str], batch_size: int = 8, made: bool = False) -> DataFrame:
    """Scores frames in batches: a model takes a pandas frame of `columns` and returns a list with one item (a dict of `schema`) per row.

    model_fn is the model or, with made, makes it: once for each Python worker, which then serves many batches and
    tasks. A wrong number of results is an error, as a frame without its result would be lost.
    """
    import pandas as pd
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import _parse_datatype_string

    def make():
        model = model_fn() if made else model_fn

        def run(*arrays) -> list[dict]:
            part = pd.DataFrame(dict(zip(columns, arrays)))
            out = list(model(part))
            if len(out) != len(part):
                raise ValueError(f"the model gave {len(out)} results for {len(part)} frames")
            return out

        return run

    score = predict_batch_udf(make, return_type=_parse_datatype_string(schema), batch_size=batch_size)
    return frames.select(*columns, score(*columns).alias("_found")).select(*columns, "_found.*")


def filter_class(df: DataFrame, name: str = "FACE") -> DataFrame:
    """Rows of the class; a row without one counts as FACE."""
    there = [F.col(c) for c in ("class", "label") if c in df.columns]
    return df.filter(F.coalesce(*there, F.lit("FACE")) == name)


def detections_per_frame(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Every frame with its number of detections, zero included."""
    keys = keys_of(frames, "frame_number")
    keys = [k for k in keys if k in detections.columns]
    n = detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return frames.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def detect_chain(preds: DataFrame, det: int = 640, src: tuple[int, int] = (1280, 720), mode: str = "gpu") -> DataFrame:
    """Raw predictions to numbered detections. gpu: best 512, suppression on unclamped boxes; cpu: first 512, on clamped ones."""
    rows = filter_confidence(preds)
    rows = topk_per_frame(rows, mode="by_score" if mode == "gpu" else "by_order")
    rows = xywh_to_corners(rows, *((None, None) if mode == "gpu" else (det, det)))
    rows = clamp_boxes(nms(rows), det, det)
    return assign_track_ids(class_label(rescale_boxes(rows, *src, det, det)))
