"""Points in boxes: a range join through the cells of a grid, so that no point meets boxes elsewhere on its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("int")


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], cell: int = 256) -> DataFrame:
    """points (keys, px, py and more) with each box (keys, x0, y0, x1, y1 and more) of their key that they lie in: x0 <= px < x1 and
    y0 <= py < y1. The two sides' other columns have different names. Boxes that are empty hold nothing.

    A box is listed in every cell of `cell` x `cell` that it touches, a point in its own only, so that each pair meets once; the
    number of cells is bounded by the page, whatever its points. Neither side is broadcast."""
    real = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    last = lambda c: _cell(F.ceil(c) - 1, cell)
    columns = real.withColumn("__cx", F.explode(F.sequence(_cell(F.col("x0"), cell), F.greatest(last(F.col("x1")), _cell(F.col("x0"), cell)))))
    cells = columns.withColumn("__cy", F.explode(F.sequence(_cell(F.col("y0"), cell), F.greatest(last(F.col("y1")), _cell(F.col("y0"), cell)))))
    own = points.withColumn("__cx", _cell(F.col("px"), cell)).withColumn("__cy", _cell(F.col("py"), cell))
    inside = (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1"))
    return own.join(cells.hint("merge"), [*keys, "__cx", "__cy"]).where(inside).drop("__cx", "__cy")
