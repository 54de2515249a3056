"""Error metrics between a predicted and a true segment, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadledger.functions.numeric import metres_to_miles


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def endpoint_error(pred: tuple[Column, ...], true: tuple[Column, ...]) -> Column:
    """Sum of end-point distances in miles, the better of both pairings; inputs x1,y1,x2,y2 in metres."""
    px1, py1, px2, py2 = pred
    tx1, ty1, tx2, ty2 = true
    same = point_distance(px1, py1, tx1, ty1) + point_distance(px2, py2, tx2, ty2)
    swapped = point_distance(px1, py1, tx2, ty2) + point_distance(px2, py2, tx1, ty1)
    return metres_to_miles(F.least(same, swapped))


def along_route_error(pred: tuple[Column, Column], true: tuple[Column, Column]) -> Column:
    """Sum of along-route end differences of two intervals, orientation ignored."""
    p1, p2 = F.least(*pred), F.greatest(*pred)
    t1, t2 = F.least(*true), F.greatest(*true)
    return F.least(F.abs(p1 - t1) + F.abs(p2 - t2), F.abs(p1 - t2) + F.abs(p2 - t1))


def length_errors(pred_len: Column, true_len: Column) -> dict[str, Column]:
    signed = pred_len - true_len
    return {"len_signed": signed, "len_abs": F.abs(signed),
            "len_ratio": F.when(true_len != 0, pred_len / true_len)}


def interval_iou(pred: tuple[Column, Column], true: tuple[Column, Column]) -> Column:
    """Overlap over union of two sorted intervals; two points score 1 only when equal."""
    (p1, p2), (t1, t2) = pred, true
    overlap = F.greatest(F.lit(0.0), F.least(p2, t2) - F.greatest(p1, t1))
    union = F.greatest(p2, t2) - F.least(p1, t1)
    points = (p1 == p2) & (t1 == t2)
    ratio = F.when(union == 0, F.lit(0.0)).otherwise(overlap / union)
    return F.when(points, F.when(p1 == t1, 1.0).otherwise(0.0)).otherwise(ratio)


def iou_penalty(iou: Column) -> Column:
    return F.when(iou == 0, F.lit(float("inf"))).otherwise(1 / iou - 1)


def temporal_penalty(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b)).cast("double")


def combined_penalty(spatial: Column, temporal: Column, weight: float = 0.5) -> Column:
    """Weighted geometric mean; 0 when either part is 0, an error when one is negative."""
    bad = (spatial < 0) | (temporal < 0)
    mean = F.pow(spatial, F.lit(weight)) * F.pow(temporal, F.lit(1 - weight))
    return (F.when(spatial.isNull() | temporal.isNull(), F.lit(None).cast("double"))
            .when(bad, F.raise_error(F.lit("penalties must be >= 0")).cast("double"))
            .when((spatial == 0) | (temporal == 0), F.lit(0.0)).otherwise(mean))
