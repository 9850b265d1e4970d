"""Tracks, rasters and metadata derived from the driver's tables, which have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.raster import Layer, MapLayer

WIDTH, HEIGHT = 130, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random walk per user in whole millimetres, 15 tracks an observation, with gaps."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    cents = F.round(F.col("value") * 100).cast("long")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moved = events.select(
        "user_id",
        "event_type",
        (F.row_number().over(w) - 1).cast("long").alias("frame"),
        ((F.col("event_id") * 7919 + cents) % 2001 - 1000).alias("dx"),
        ((F.col("event_id") * 104729 + cents * 31) % 2001 - 1000).alias("dy"),
    )
    so_far = Window.partitionBy("user_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda d, k: (F.sum(d).over(so_far) + (F.col("user_id") % k) * 2000).cast("double") / 1000
    gap = (F.col("event_type") == "error") & (F.col("frame") % 3 == 0)
    place = moved.select("user_id", "frame", gap.alias("gap"), at("dx", 15).alias("x"), at("dy", 7).alias("y"))
    return place.select(F.floor(F.col("user_id") / 15).cast("long").alias("observation"), (F.col("user_id") % 15).cast("long").alias("track"), "frame", F.when(~F.col("gap"), F.col("x")).alias("x"), F.when(~F.col("gap"), F.col("y")).alias("y"))


def dsm(spark: SparkSession) -> Layer:
    """A surface by formula with holes."""
    cells = spark.range(HEIGHT).select(F.col("id").alias("row")).crossJoin(spark.range(WIDTH).select(F.col("id").alias("col")))
    hole = (F.col("row") * 13 + F.col("col") * 7) % 41 == 0
    return Layer(cells.withColumn("value", F.when(~hole, ((F.col("row") * 37 + F.col("col") * 91) % 5000).cast("double") / 1000)), -20.0, 30.0, 0.5, -0.5, WIDTH, HEIGHT)


def layer(spark: SparkSession, name: str) -> Layer:
    """dsm, dtm, heights, ground or road."""
    value = {
        "dsm": F.col("value"),
        "dtm": F.col("value") / 2,
        "heights": 1.5 - F.col("value") / 10,
        "ground": (F.col("row") + F.col("col")) % 5,
        "road": F.when(F.col("row") % 25 == 0, 255).otherwise(0),
    }[name]
    return dsm(spark).mapped(value)


def map_layer(spark: SparkSession, sf_dir: str, name: str = "dsm") -> MapLayer:
    """A layer() per region: the k-th lies k metres further right and lower, and is k higher."""
    maps = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("big_map"))
    one = layer(spark, name)
    cells = one.cells.crossJoin(F.broadcast(maps)).select("big_map", "row", "col", (F.col("value") + F.col("k")).alias("value"))
    grid = {"origin_x": one.origin_x + F.col("k"), "origin_y": one.origin_y - F.col("k"), "cell_x": F.lit(one.cell_x), "cell_y": F.lit(one.cell_y), "width": F.lit(one.width), "height": F.lit(one.height)}
    return MapLayer(cells, maps.select("big_map", *[v.alias(k) for k, v in grid.items()]))


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observation, easting, northing, big_map."""
    known = fixes(spark, sf_dir).select("observation").distinct()
    maps = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("big_map"))
    place = known.select("observation", (10.0 + F.col("observation") % 5).alias("easting"), (5.0 + F.col("observation") % 3).alias("northing"), (F.col("observation") % 5).alias("k"))
    return place.join(F.broadcast(maps), "k").drop("k")


def track_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observation, track, individual_ID, species, age; some tracks have none, some no age."""
    users = fixes(spark, sf_dir).select("observation", "track", (F.col("observation") * 15 + F.col("track")).alias("user_id")).distinct()
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("individual_ID"), F.col("c_mktsegment").alias("species"))
    age = F.when(F.col("user_id") % 11 != 0, F.element_at(F.array(F.lit("adult"), F.lit("juvenile"), F.lit("subadult")), (F.col("user_id") % 3 + 1).cast("int")))
    return users.where("user_id % 13 <> 0").join(who, "user_id").select("observation", "track", "individual_ID", "species", age.alias("age"))
