"""Raster layers as tables of cells, sampled by an equi-join on row and column."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import STEP

BROADCAST_CELLS = 2_000_000  # layers of up to so many cells (24 bytes each) are sent to all executors


@dataclass(frozen=True)
class Layer:
    """cells(row, col, value), value null where there is no data; the grid's upper left corner and cell sizes (cell_y < 0)."""

    cells: DataFrame
    origin_x: float
    origin_y: float
    cell_x: float
    cell_y: float
    width: int
    height: int
    key = ()

    def at(self, points: DataFrame) -> DataFrame:
        """points with what row() and col() need."""
        return points

    def without_grid(self, points: DataFrame) -> DataFrame:
        return points

    def row(self, y: Column) -> Column:
        return F.floor((y - self.origin_y) / self.cell_y)

    def col(self, x: Column) -> Column:
        return F.floor((x - self.origin_x) / self.cell_x)

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.origin_x + (col + 0.5) * self.cell_x, self.origin_y + (row + 0.5) * self.cell_y

    def reach(self, radius: float) -> tuple[Column, Column]:
        """Rows and columns that a radius may touch, and one more."""
        return F.lit(math.ceil(radius / abs(self.cell_y)) + 1).cast("long"), F.lit(math.ceil(radius / abs(self.cell_x)) + 1).cast("long")

    def inside(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (col >= 0) & (row < self.height) & (col < self.width)

    def joinable(self) -> DataFrame:
        return F.broadcast(self.cells) if self.width * self.height <= BROADCAST_CELLS else self.cells

    def mapped(self, value: Column) -> Layer:
        return replace(self, cells=self.cells.withColumn("value", value))


@dataclass(frozen=True)
class MapLayer:
    """A raster per map: cells(big_map, row, col, value) and grids(big_map, origin_x, origin_y, cell_x, cell_y, width,
    height), one row per map. Points name their map in the column big_map; a map without a grid has no data."""

    cells: DataFrame
    grids: DataFrame
    key = ("big_map",)

    def at(self, points: DataFrame) -> DataFrame:
        if "__origin_x" in points.columns:
            return points
        grids = self.grids.select("big_map", *[F.col(c).alias("__" + c) for c in _GRID])
        return points.join(grids, "big_map", "left")

    def without_grid(self, points: DataFrame) -> DataFrame:
        return points.drop(*["__" + c for c in _GRID])

    def row(self, y: Column) -> Column:
        return F.floor((y - F.col("__origin_y")) / F.col("__cell_y"))

    def col(self, x: Column) -> Column:
        return F.floor((x - F.col("__origin_x")) / F.col("__cell_x"))

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.col("__origin_x") + (col + 0.5) * F.col("__cell_x"), F.col("__origin_y") + (row + 0.5) * F.col("__cell_y")

    def reach(self, radius: float) -> tuple[Column, Column]:
        return tuple((F.ceil(radius / F.abs(F.col("__cell_" + d))) + 1).cast("long") for d in "yx")

    def inside(self, row: Column, col: Column) -> Column:
        return F.coalesce((row >= 0) & (col >= 0) & (row < F.col("__height")) & (col < F.col("__width")), F.lit(False))

    def joinable(self) -> DataFrame:
        return self.cells

    def mapped(self, value: Column) -> MapLayer:
        return replace(self, cells=self.cells.withColumn("value", value))


_GRID = ("origin_x", "origin_y", "cell_x", "cell_y", "width", "height")


def sample(points: DataFrame, layer: Layer | MapLayer, name: str, x: str = "x", y: str = "y") -> DataFrame:
    """points with the layer's value at (x, y) as `name`; null outside and where there is no data."""
    cells = layer.joinable().select(*[F.col(k).alias("__" + k) for k in layer.key], F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("value").alias(name))
    located = layer.at(points)
    at = located.withColumns({"__r": layer.row(F.col(y)), "__c": layer.col(F.col(x))})
    on = [F.col("__r") == F.col("__row"), F.col("__c") == F.col("__col"), *[F.col(k) == F.col("__" + k) for k in layer.key]]
    found = at.join(cells, reduce(and_, on), "left").drop("__r", "__c", "__row", "__col", *["__" + k for k in layer.key])
    return found if located is points else layer.without_grid(found)


def where_data(points: DataFrame, layer: Layer | MapLayer | None) -> DataFrame:
    """Points on a cell with data; all of them without a layer."""
    return points if layer is None else sample(points, layer, "__value").where("__value is not null").drop("__value")


def with_slope(moves: DataFrame, dtm: Layer | MapLayer, length: str = "length_m") -> DataFrame:
    """moves(px, py, x, y, and their length) with start_alt_m, end_alt_m, alt_change_m, ground_slope_deg and ground_slope_pct.

    Null where either altitude is missing or the move has no length."""
    both = sample(sample(moves, dtm, "start_alt_m", "px", "py"), dtm, "end_alt_m")
    change = F.col("end_alt_m") - F.col("start_alt_m")
    share = change / F.when(F.col(length) > 0, F.col(length))
    return both.withColumns({"alt_change_m": change, "ground_slope_deg": F.degrees(F.atan(share)), "ground_slope_pct": 100 * share})


def with_ground_class(points: DataFrame, layer: Layer, names: dict[int, str] | None = None) -> DataFrame:
    """points with ground_class, -1 where missing, and with ground_class_name from names if given."""
    found = sample(points, layer, "__class").withColumn("ground_class", F.coalesce(F.col("__class"), F.lit(-1)).cast("long")).drop("__class")
    if names is None:
        return found
    known = F.create_map(*[F.lit(v) for k in names.items() for v in k])
    return found.withColumn("ground_class_name", F.try_element_at(known, F.col("ground_class").cast("int")))


def road_flag(points: DataFrame, layer: Layer) -> DataFrame:
    """points with road: 1 where the layer has 255, else its value; null outside."""
    return sample(points, layer, "road").withColumn("road", F.when(F.col("road") == 255, 1).otherwise(F.col("road")).cast("long"))


def downsampled(layer: Layer, factor: int) -> DataFrame:
    """row, col, value: the mean of the valid cells in blocks of factor x factor."""
    return layer.cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("value").alias("value"))


SAME_CELL = 0.05  # a target size this close to the layer's own leaves the layer as it is


def resampled(layer: Layer, cell: float, how: str = "bilinear") -> Layer:
    """The layer with square cells of this size, from the same corner; the layer itself if its cells are that size
    within SAME_CELL on both axes.

    bilinear: a cell is the mean of the source cells with data, weighted by a triangle that reaches to the next target
    centre (to the next source centre where the target is finer); average: the mean of the source cells whose centre
    lies in it; nearest: the source cell that holds its centre."""
    if all(abs(abs(s) - cell) / abs(s) < SAME_CELL for s in (layer.cell_x, layer.cell_y)):
        return layer
    if how not in ("bilinear", "average", "nearest"):
        raise ValueError("how is bilinear, average or nearest")
    size = {"row": math.ceil(layer.height * abs(layer.cell_y) / cell), "col": math.ceil(layer.width * abs(layer.cell_x) / cell)}
    ratio = {"row": cell / abs(layer.cell_y), "col": cell / abs(layer.cell_x)}
    made = layer.cells.where("value is not null")
    weight = F.lit(1.0)
    for axis in ("row", "col"):
        k, centre = ratio[axis], (F.col(axis) + 0.5) / ratio[axis]  # the source centre in target cells
        to = "__" + axis
        if how == "average":
            made = made.withColumn(to, F.floor(centre).cast("long"))
            continue
        half = max(1.0, 1 / k) if how == "bilinear" else 0.5 + 0.5 / k
        low, high = F.greatest(F.floor(centre - half - 0.5).cast("long"), F.lit(0).cast("long")), F.least(F.ceil(centre + half - 0.5).cast("long"), F.lit(size[axis] - 1).cast("long"))
        made = made.withColumn(to, F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
        if how == "nearest":
            made = made.where(F.floor((F.col(to) + 0.5) * k) == F.col(axis))
        else:
            apart = F.abs(F.col(to) + 0.5 - centre) / half
            made = made.where(apart < 1)
            weight = weight * (1 - apart)
    cells = made.groupBy(F.col("__row").alias("row"), F.col("__col").alias("col")).agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))
    sign = lambda x: math.copysign(cell, x)
    return Layer(cells, layer.origin_x, layer.origin_y, sign(layer.cell_x), sign(layer.cell_y), size["col"], size["row"])


def binned(cells: DataFrame, size: int, row: str = "drow", col: str = "dcol", value: str = "visible", key: tuple[str, ...] = tuple(STEP) + ("step_idx",)) -> DataFrame:
    """Means of values in square bins around each key, as rows bin_row, bin_col, mean."""
    return cells.groupBy(*key, F.floor(F.col(row) / size).alias("bin_row"), F.floor(F.col(col) / size).alias("bin_col")).agg(F.avg(value).alias("mean"))
