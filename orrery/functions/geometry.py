"""Where faces are: the transform that puts landmarks in their places, and boxes that the edge of a tile cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where five landmarks are in a picture of 112 pixels (x, y of each), and pixels at an edge that count as it.
TEMPLATE, TEMPLATE_SIZE = (38.2946, 51.6963, 73.5318, 51.5014, 56.0252, 71.7366, 41.5493, 92.3655, 70.7299, 92.2041), 112
EDGE_SLACK = 2
#: How much of a tile its neighbour also has, and how long a side has to be to be cut into three.
OVERLAP, LONG_SIDE = 0.2, 1.8


def alignment(landmarks: Column, size: int = TEMPLATE_SIZE) -> Column:
    """(a, b, tx, ty): x' = a x - b y + tx and y' = b x + a y + ty bring five points nearest to the template's, by least squares.

    landmarks: array of 10 numbers, x and y in turns; null for another length.  Five equal points are only moved.
    """
    goal = F.array(*(F.lit(v * size / TEMPLATE_SIZE) for v in TEMPLATE))
    gx, gy = (sum(TEMPLATE[k::2]) / 5 * size / TEMPLATE_SIZE for k in (0, 1))

    # A variable of a lambda is computed once, where a column would be for each use.
    def sums(p: Column) -> Column:
        zero = F.lit(0.0)
        start = F.struct(zero.alias("x"), zero.alias("y"), zero.alias("along"), zero.alias("across"), zero.alias("norm"))

        def add(s: Column, i: Column) -> Column:
            x, y, u, v = F.get(p, 2 * i).cast("double"), F.get(p, 2 * i + 1).cast("double"), F.get(goal, 2 * i), F.get(goal, 2 * i + 1)
            return F.struct((s["x"] + x).alias("x"), (s["y"] + y).alias("y"), (s["along"] + x * u + y * v).alias("along"), (s["across"] + x * v - y * u).alias("across"), (s["norm"] + x * x + y * y).alias("norm"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(4)), start, add)

    def turn(s: Column) -> Column:
        mx, my = s["x"] / 5, s["y"] / 5
        norm = s["norm"] - 5 * (mx * mx + my * my)
        a = F.when(norm > 1e-9, (s["along"] - 5 * (mx * gx + my * gy)) / norm).otherwise(1.0)
        b = F.when(norm > 1e-9, (s["across"] - 5 * (mx * gy - my * gx)) / norm).otherwise(0.0)
        return F.struct(a.alias("a"), b.alias("b"), mx.alias("mx"), my.alias("my"))

    def moved(t: Column) -> Column:
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), (gx - (t["a"] * t["mx"] - t["b"] * t["my"])).alias("tx"), (gy - (t["b"] * t["mx"] + t["a"] * t["my"])).alias("ty"))

    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    return F.when(F.size(landmarks) == 10, once(landmarks, lambda p: once(once(sums(p), turn), moved)))


def tiles(width: Column, height: Column) -> Column:
    """array of (x, y, w, h): two tiles a side, three on a long one, that overlap by OVERLAP of a tile."""
    half_up = lambda v: F.floor(v + 0.5).cast("int")
    n = lambda own, other: F.when(own >= other * LONG_SIDE, 3).otherwise(2)
    cols, rows = n(width, height), n(height, width)
    w, h = half_up(width / (cols - (cols - 1) * OVERLAP)), half_up(height / (rows - (rows - 1) * OVERLAP))
    each = lambda k: F.sequence(F.lit(0), k - 1)
    at = lambda whole, tile, i, k: half_up((whole - tile) * i / (k - 1))
    tile = lambda r, c: F.struct(at(width, w, c, cols).alias("x"), at(height, h, r, rows).alias("y"), w.alias("w"), h.alias("h"))
    return F.flatten(F.transform(each(rows), lambda r: F.transform(each(cols), lambda c: tile(r, c))))


def cut_by_tile(box: Column, tile: Column, width: Column, height: Column) -> Column:
    """Whether a box (l, t, r, b) that was found in a tile touches an edge of it that isn't the picture's."""
    low = lambda edge, start: (start > 0) & (edge <= start + EDGE_SLACK)
    high = lambda edge, end, whole: (end < whole) & (edge >= end - EDGE_SLACK)
    x, y = tile["x"], tile["y"]
    return low(box["l"], x) | low(box["t"], y) | high(box["r"], x + tile["w"], width) | high(box["b"], y + tile["h"], height)
