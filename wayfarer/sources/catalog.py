"""Reading tracks and their metadata, writing tables, and looking into them."""

from __future__ import annotations

import io
import math
import re
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import TRACK, require_columns

RESERVED = ("track", "track_index", "frame", "location", "position")


def label(name: Column) -> Column:
    """ob12 and observation12, in any case, as observation12; other names as they are, without blanks around them."""
    name = F.trim(name)
    return F.when(name.rlike(r"(?i)^(ob|observation)\d+$"), F.concat(F.lit("observation"), F.regexp_extract(name, r"(\d+)$", 1))).otherwise(name)


def wanted_labels(names: Iterable[str | int]) -> set[str]:
    """Requested observations as labels; bare numbers are taken too, and what is no observation raises."""
    out = set()
    for n in names:
        if not (m := re.fullmatch(r"(?i)(?:ob|observation)?(\d+)", str(n).strip())):
            raise ValueError(f"{n!r} names no observation")
        out.add("observation" + m[1])
    return out


def observation_of(path: Column, pattern: str) -> Column:
    """The observation's name from a file name, by a pattern with one group, or one named obs; null if it doesn't match."""
    compiled = re.compile(pattern)
    if compiled.groups != 1 and "obs" not in compiled.groupindex:
        raise ValueError("the pattern needs one group, or one named obs")
    name = F.element_at(F.split(path, "/"), -1)
    spark_pattern = pattern.replace("(?P<", "(?<")
    return F.when(name.rlike(spark_pattern), F.regexp_extract(name, spark_pattern, compiled.groupindex.get("obs", 1)))


def observations_of_files(paths: DataFrame) -> DataFrame:
    """observation: the distinct beginnings of the file names in paths(path), up to the first '_'; how older files are found."""
    name = F.element_at(F.split("path", "/"), -1)
    return paths.select(F.split_part(name, F.lit("_"), F.lit(1)).alias("observation")).distinct()


def safe_name(name: str) -> str:
    """A metadata column's name that doesn't collide with the engine's own."""
    return name + "_meta" if name in RESERVED else name


def text(column: Column) -> Column:
    """A string, '' where missing."""
    return F.coalesce(column.cast("string"), F.lit(""))


def attributes(row: DataFrame, *columns: str) -> Column:
    """Free-form attributes as a JSON object of the columns that have a value: NaN has none, dates are in ISO form."""
    require_columns(row, *columns)
    kinds = dict(row.dtypes)
    number = lambda c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    value = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kinds[c].startswith("timestamp") else F.date_format(c, "yyyy-MM-dd") if kinds[c] == "date" else number(c)
    return F.to_json(F.struct(*[value(c).alias(c) for c in columns]))


def described(rows: DataFrame, about: dict[str, dict[str, str]]) -> DataFrame:
    """rows, whose columns in `about` carry its units and descriptions as metadata; they go along into Parquet files."""
    require_columns(rows, *about)
    return rows.select(*[F.col(c).alias(c, metadata={**rows.schema[c].metadata, **about[c]}) if c in about else F.col(c) for c in rows.columns])


#: Units and descriptions of the columns that the engine adds.
ABOUT = {
    "step_length_m": {"units": "m", "description": "straight length of the step"},
    "step_duration_s": {"units": "s", "description": "time between the step's frames"},
    "step_speed_mps": {"units": "m/s", "description": "length by time"},
    "dist_to_observer": {"units": "m", "description": "from the step's end to the observer"},
    "delta_observer_dist": {"units": "m", "description": "by how much the distance to the observer grows"},
    "angle_to_observer": {"units": "deg", "description": "between the step and the way to the observer"},
    "heading_deg": {"units": "deg", "description": "from the x axis, counter-clockwise"},
    "observer_height": {"units": "m", "description": "of the animal's head above the surface"},
    "ground_slope_deg": {"units": "deg", "description": "rise of the ground along the step"},
    "viewshed_vis": {"units": "1", "description": "share of the cells around that can be seen"},
    "nn_distance_m": {"units": "m", "description": "to the nearest other animal"},
    "social_density": {"units": "count", "description": "other animals within the radius"},
}


def read_tracks(spark: SparkSession, folder: str, pattern: str = r"^(.*?)[_.].*npy$", normalise: Callable[[Column], Column] = label) -> DataFrame:
    """fixes(observation, track, frame, x, y) from .npy files of shape (tracks, frames, 2) or (frames, 2); NaN is null.

    normalise makes labels of the names found. Files whose name doesn't match are left out; a folder without any that
    does, or a file of another shape, raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).withColumn("observation", normalise(observation_of(F.col("path"), pattern))).where("observation is not null")
    if files.select("path").isEmpty():
        raise ValueError(f"no .npy file in {folder} has a name like {pattern}")

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch["observation"], batch["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a[None] if a.ndim == 2 else a
                if a.ndim != 3 or a.shape[2] != 2:
                    raise ValueError(f"{name}: shape {a.shape} is not (tracks, frames, 2)")
                track, frame = np.indices(a.shape[:2]).reshape(2, -1)
                flat = a.reshape(-1, 2).astype(float)
                yield pd.DataFrame({"observation": name, "track": track, "frame": frame, "x": flat[:, 0], "y": flat[:, 1]})

    fixes = files.select("observation", "content").mapInPandas(rows, "observation string, track bigint, frame bigint, x double, y double")
    return fixes.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})


def read_metadata(spark: SparkSession, path: str, required: list[str], keep: list[str] | None = None) -> DataFrame:
    """A CSV file with a header: the required columns and those in keep (all by default), observations as labels."""
    rows = require_columns(spark.read.csv(path, header=True, inferSchema=True), *required)
    names = [c for c in rows.columns if keep is None or c in required or c in keep]
    kept = {"observation": lambda c: label(c.cast("string")), "track": lambda c: c.cast("long")}
    own = lambda c: kept[c](F.col(c)) if c in required and c in kept else F.col(c)
    return rows.select(*[own(c).alias(c if c in required else safe_name(c)) for c in names])


def read_all(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The rows of several Parquet tables, by column name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def write_table(rows: DataFrame, path: str, by: list[str]) -> str:
    """Parquet, zstd, one folder per value of the columns in `by`; what was there is replaced."""
    rows.repartition(*by).write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
    return path


def only(rows: DataFrame, names: Iterable[str | int]) -> DataFrame:
    """Rows of the requested observations; raises if none is there. The filter reaches the partition folders."""
    found = rows.where(F.col("observation").isin(sorted(wanted_labels(names))))
    if found.isEmpty():
        raise ValueError("no requested observation is there")
    return found


def missing(requested: DataFrame, there: DataFrame) -> DataFrame:
    """Requested observations that are not there."""
    return requested.select("observation").exceptAll(there.select("observation").distinct())


def padded_tracks(counts: DataFrame, metadata: DataFrame, order: str) -> DataFrame:
    """A row per track 0 .. n_tracks - 1 of counts(observation, n_tracks) with its first row of metadata by `order`, if any."""
    first = Window.partitionBy(*TRACK).orderBy(order)
    kept = metadata.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    every = counts.withColumn("track", F.explode(F.expr("sequence(0L, n_tracks - 1)"))).drop("n_tracks")
    return every.join(kept, TRACK, "left")


def unique_join(rows: DataFrame, lookup: DataFrame, key: list[str]) -> DataFrame:
    """rows with the columns of lookup, which must have each key once."""
    if not lookup.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"lookup has a key {key} more than once")
    return rows.join(lookup, key)


def observer_position(observers: DataFrame) -> DataFrame:
    """observers with easting and northing: their own, else by UTM from latitude and longitude in degrees."""
    east, north = g.utm(F.col("observer_lat"), F.col("observer_lon"))
    degrees = F.col("observer_lat").between(-90, 90) & F.col("observer_lon").between(-180, 180)
    made = observers.withColumns({"easting": F.coalesce("observer_easting", F.when(degrees, east)), "northing": F.coalesce("observer_northing", F.when(degrees, north))})
    zone, letter = g.utm_zone(F.col("observer_lon")), g.utm_letter(F.col("observer_lat"))
    return made.withColumns({"utm_zone_number": F.when(degrees, zone), "utm_zone_letter": F.when(degrees, letter), "utm_zone": F.when(degrees, F.concat(zone.cast("string"), letter))})


def track_rows(rows: DataFrame, tracks: int | str | list[int | str], labels: DataFrame | None = None) -> DataFrame:
    """Rows of tracks by number, or by label in labels(observation, track, track_label); raises for one that has no rows."""
    wanted = [tracks] if isinstance(tracks, (int, str)) else list(tracks)
    numbers, names = [t for t in wanted if isinstance(t, int)], [t for t in wanted if isinstance(t, str)]
    if names and labels is None:
        raise ValueError("labels are needed to find tracks by name")
    asked = rows.sparkSession.createDataFrame([(str(t), t if isinstance(t, int) else None, t if isinstance(t, str) else None) for t in wanted], "asked string, number long, name string")
    known = rows.select(*TRACK).distinct().withColumn("track_label", F.lit(None).cast("string"))
    if names:
        known = known.drop("track_label").join(labels.select(*TRACK, "track_label"), TRACK, "left")
    met = known.join(asked, (F.col("track") == F.col("number")) | (F.col("track_label") == F.col("name"))).select(*TRACK, "asked")
    there = {r["asked"] for r in met.select("asked").distinct().collect()}  # no more than were asked for
    if lacking := [t for t in wanted if str(t) not in there]:
        raise ValueError(f"no track {lacking}")
    return rows.where(F.col("track").isin(numbers)) if not names else rows.join(met.select(*TRACK).distinct(), TRACK, "left_semi")


def thinned(fixes: DataFrame, most: int, frames: int) -> DataFrame:
    """Every k-th frame, k the least for which at most `most` of the frames are left."""
    return fixes.where(F.col("frame") % max(1, math.ceil(frames / most)) == 0)


def track_extents(rows: DataFrame, *order: str) -> DataFrame:
    """track_start and track_count of each track in a flat table of all rows of its observation."""
    counts = rows.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("track_count"))
    before = Window.partitionBy("observation").orderBy(*(order or ("track",))).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("track_start", F.coalesce(F.sum("track_count").over(before), F.lit(0)))


def summary(fixes: DataFrame) -> DataFrame:
    """Tracks, frames and fixes with a position of each observation."""
    return fixes.groupBy("observation").agg(F.countDistinct("track").alias("n_tracks"), (F.max("frame") + 1).alias("n_frames"), F.count("x").alias("n_fixes"))
