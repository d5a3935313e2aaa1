"""Polygons and regions around a code: rectangles, areas, corner order, regions of interest, scale-back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.runtime import let


def _xs(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: p[0])


def _ys(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: p[1])


def bounding_rect(polygon: Column) -> Column:
    """``left, top, width, height`` of an array of points; null for null and empty polygons."""
    left, top = F.array_min(_xs(polygon)), F.array_min(_ys(polygon))
    rect = F.struct(left.alias("left"), top.alias("top"), (F.array_max(_xs(polygon)) - left).alias("width"), (F.array_max(_ys(polygon)) - top).alias("height"))
    return F.when(F.size(polygon) > 0, rect)


def extents(polygon: Column) -> Column:
    """``top, bottom, left, right, center_x, center_y`` of a four-point polygon; the centre is the floor of a quarter of the sums."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return F.when(
        F.size(polygon) >= 4,
        F.struct(
            F.array_min(_ys(polygon)).alias("top"),
            F.array_max(_ys(polygon)).alias("bottom"),
            F.array_min(_xs(polygon)).alias("left"),
            F.array_max(_xs(polygon)).alias("right"),
            F.floor(total(_xs(polygon)) / 4).alias("center_x"),
            F.floor(total(_ys(polygon)) / 4).alias("center_y"),
        ),
    )


def area(polygon: Column) -> Column:
    """Shoelace area of an array of points; 0 below three points, null for null."""
    turned = F.concat(F.slice(polygon, 2, 1_000_000), F.slice(polygon, 1, 1))
    cross = F.zip_with(polygon, turned, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.when(F.size(polygon) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def ordered_corners(polygon: Column) -> Column:
    """Corners by angle about their centroid, turned so that the one with the least ``x + y`` comes first."""
    total = lambda p: F.aggregate(p, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, q: F.struct((s["x"] + q[0]).alias("x"), (s["y"] + q[1]).alias("y")))

    def ring(centre: Column) -> Column:
        n = F.size(polygon)
        angle = lambda p, i: F.struct(F.atan2(p[1] - centre["y"] / n, p[0] - centre["x"] / n).alias("a"), i.alias("i"), p.alias("p"))
        return F.transform(F.array_sort(F.transform(polygon, angle)), lambda c: c["p"])

    def turned(corners: Column) -> Column:
        least = F.array_min(F.transform(corners, lambda p, i: F.struct((p[0] + p[1]).alias("s"), i.alias("i"))))
        return let(least["i"], lambda first: F.concat(F.slice(corners, first + 1, F.size(corners)), F.slice(corners, F.lit(1), first)))

    return F.when(F.size(polygon) > 0, let(let(total(polygon), ring), turned))


def largest(polygons: Column) -> Column:
    """The polygon with the greatest area, the first of equals."""
    ranked = F.transform(polygons, lambda p, i: F.struct(area(p).alias("a"), (-i).alias("i"), p.alias("p")))
    return F.array_max(ranked)["p"]


def scale_back(polygon: Column, factor: Column) -> Column:
    """Coordinates of a scaled image in the original: divided by the factor, cut towards zero."""
    return F.transform(polygon, lambda p: F.transform(p, lambda v: (v / factor).cast("int")))


@dataclass(frozen=True)
class Regions:
    """Shares of the image that make up the regions above and beside a code."""

    above_width: float = 0.35
    above_height: float = 0.18
    below_height: float = 0.55
    padding: int = 5
    above_scale: float = 2.0


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def region_above(rect: Column, width: Column, height: Column, r: Regions = Regions()) -> Column:
    """Region above the code, centred on its right edge and clipped; 60 by 40 pixels to either side where that is empty."""
    top, right = rect["top"], rect["left"] + rect["width"]
    half = F.floor((width * r.above_width).cast("int") / 2).cast("int")
    a = _box(F.greatest(F.lit(0), right - half), F.greatest(F.lit(0), top - (height * r.above_height).cast("int")), F.least(width, right + half), top)
    b = _box(F.greatest(F.lit(0), right - 60), F.greatest(F.lit(0), top - 40), F.least(width, right + 60), top)
    return F.when((a["y1"] >= a["y2"]) | (a["x1"] >= a["x2"]), b).otherwise(a)


def region_below(rect: Column, width: Column, height: Column, r: Regions = Regions()) -> Column:
    """Region left of the code from two fifths of its height downwards, clipped; all below its top where that is empty."""
    top, left = rect["top"], rect["left"]
    y1 = top + (rect["height"] * 0.4).cast("int")
    a = _box(F.lit(0), y1, F.greatest(F.lit(1), left - r.padding), F.least(height, y1 + (height * r.below_height).cast("int")))
    b = _box(F.lit(0), top, F.greatest(F.lit(1), left), height)
    return F.when((a["y1"] >= a["y2"]) | (a["x1"] >= a["x2"]), b).otherwise(a)


def merged_shape(above: Column, below: Column, r: Regions = Regions()) -> Column:
    """Shape of both regions stacked: the upper one scaled, a separator of three lines, padded to the wider one."""
    w = lambda b: b["x2"] - b["x1"]
    h = lambda b: b["y2"] - b["y1"]
    aw, ah = (w(above) * r.above_scale).cast("int"), (h(above) * r.above_scale).cast("int")
    return F.struct(F.greatest(aw, w(below)).alias("width"), (ah + 3 + h(below)).alias("height"))
