"""The three runs that string the operators together: ingest, preprocess and training examples."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TRACK, step_key
from ..operators import features as ft
from ..operators import raster as ra
from ..operators import simulation as si
from ..operators import social as so
from ..operators import trajectory as tr
from ..operators import viewshed as vs
from ..sources import catalog as ca
from ..sources import store


def ingest(spark: SparkSession, raw: str, out: str, pattern: str = r"^(.*?)[_.].*npy$", observations_csv: str | None = None, tracks_csv: str | None = None, only: list[str | int] | None = None, normalise: Callable[[Column], Column] = ca.label, keep_observation: list[str] | None = None, keep_track: list[str] | None = None) -> list[str]:
    """Tables fixes, tracks and observations in `out` from .npy files and CSV metadata; returns the observations' names.

    Every track has a row in tracks, its metadata null where the file has none. Observations whose place is known in
    degrees only get easting and northing. normalise turns names into labels; raises where nothing is to be read."""
    fixes = ca.read_tracks(spark, raw, pattern, normalise)
    if only is not None:
        fixes = ca.only(fixes, only)
    ca.write_table(fixes, f"{out}/fixes", ["observation"])
    fixes = spark.read.parquet(f"{out}/fixes")
    counts = fixes.groupBy("observation").agg((F.max("track") + 1).alias("n_tracks"))
    tracks = ca.read_metadata(spark, tracks_csv, TRACK, keep_track) if tracks_csv else fixes.select(*TRACK).distinct()
    order = next((c for c in tracks.columns if c not in TRACK), "track")
    padded = ca.padded_tracks(counts, tracks, order)
    names = [c for c, kind in padded.dtypes if kind == "string" and c != "observation"]
    padded.withColumns({c: ca.text(F.col(c)) for c in names}).write.mode("overwrite").parquet(f"{out}/tracks")
    about = counts.select("observation")
    if observations_csv:
        known = ca.read_metadata(spark, observations_csv, ["observation"], keep_observation)
        for c in ("observer_lat", "observer_lon", "observer_easting", "observer_northing"):
            if c not in known.columns:
                known = known.withColumn(c, F.lit(None).cast("double"))
        about = about.join(ft.each_once(ca.observer_position(known), "observation"), "observation", "left")
    about.write.mode("overwrite").parquet(f"{out}/observations")
    return [n.removeprefix("observation=") for n in store.report(spark, f"{out}/fixes")]


@dataclass(frozen=True)
class Settings:
    """How tracks are cut into steps and what is added to them."""

    offsets: dict[float, list[float]] = field(default_factory=lambda: {5.0: [0.0, 1.0, 2.0, 3.0, 4.0]})
    least_points: int = 5
    alternatives: int = 40
    angles: str = "uniform"
    social_radius: float = 10.0
    sight_range: float | None = None
    sight_most: int | None = None
    viewshed_radius: float = 30.0
    curvature: float = vs.CURVATURE
    fps: float = ft.FPS


@dataclass(frozen=True)
class Rasters:
    """Surface, ground and head heights, ground classes; each a Layer or a MapLayer."""

    dsm: ra.Layer | ra.MapLayer
    dtm: ra.Layer | ra.MapLayer
    heights: ra.Layer | ra.MapLayer
    ground: ra.Layer | ra.MapLayer


def preprocess(fixes: DataFrame, observers: DataFrame, tracks: DataFrame, rasters: Rasters, out: str, settings: Settings = Settings(), ground_names: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(observed, simulated): annotated steps, written to `out` and read back. observers(observation, easting, northing,
    big_map), tracks(observation, track, individual_ID, species, age).

    Tracks are cut at all lengths and offsets; steps off the surface and walks with too few points are left out;
    alternatives end on the surface. Both tables get the observer's features, head height, slope, ground class and
    viewshed share; observed steps also other animals and their tracks' metadata."""
    spark = fixes.sparkSession
    maps = ft.each_once(observers, "observation").select("observation", "big_map")
    walked = tr.walk_lengths(fixes, settings.offsets).join(maps, "observation")
    walked = tr.at_least(ra.where_data(walked, rasters.dsm), settings.least_points)
    walked.write.mode("overwrite").parquet(f"{out}/steps")
    steps = spark.read.parquet(f"{out}/steps")
    si.simulate(steps, settings.alternatives, settings.angles, rasters.dsm).write.mode("overwrite").parquet(f"{out}/alternatives")
    simulated = spark.read.parquet(f"{out}/alternatives")
    place = observers.select("observation", "easting", "northing")

    key = [*step_key(steps), "step_idx"]
    seen = ft.observed_features(steps, place, settings.fps).join(steps.select(*key, "big_map"), key)
    other = ft.simulated_features(simulated, steps, place, settings.fps)

    def on_ground(rows: DataFrame) -> DataFrame:
        rows = ra.sample(rows, rasters.heights, "observer_height")
        rows = ra.with_slope(rows, rasters.dtm, "step_length_m")
        rows = ra.with_ground_class(rows, rasters.ground, ground_names)
        return vs.annotate(spark, rows, f"{out}/viewsheds", rasters.dsm, rasters.heights, settings.viewshed_radius, curvature=settings.curvature)

    social = so.annotated(seen, fixes, tracks, rasters.dsm, rasters.heights, settings.social_radius, settings.sight_range, settings.sight_most)
    observed = on_ground(social.join(tracks, TRACK, "left"))
    about = lambda rows: ca.described(rows, {c: a for c, a in ca.ABOUT.items() if c in rows.columns})
    about(observed).write.mode("overwrite").parquet(f"{out}/observed")
    about(on_ground(other)).write.mode("overwrite").parquet(f"{out}/simulated")
    return spark.read.parquet(f"{out}/observed"), spark.read.parquet(f"{out}/simulated")


def examples(observed: DataFrame, simulated: DataFrame, numeric: list[str], categorical: list[str], context: int, most: int) -> DataFrame:
    """Training examples: normalised numbers and one-hot categories of the observed move, the context and the alternatives.

    Statistics and vocabularies are those of the observed steps; columns that alternatives lack are 0 there."""
    stats, known = ft.numeric_stats(observed, numeric), ft.vocabulary(observed, categorical)

    def ready(rows: DataFrame) -> DataFrame:
        for c in (c for c in [*numeric, *categorical] if c not in rows.columns):
            rows = rows.withColumn(c, F.lit(None).cast("double" if c in numeric else "string"))
        rows = ft.normalised(rows, numeric, stats)
        for c in categorical:
            rows = ft.one_hot(rows, c, known)
        absent = [c for c in numeric if c not in simulated.columns]
        return rows.withColumn("vector", ft.feature_vector(numeric, categorical, absent if "target_step_index" in rows.columns else []))

    return ft.training_examples(ready(observed), ready(simulated), context, most, "vector")


def main(arguments: list[str] | None = None) -> None:
    """python -m wayfarer.plans.lifecycle RAW OUT [--pattern P] [--observations CSV] [--tracks CSV] [--only NAME ...]"""
    parser = argparse.ArgumentParser(description="Ingest .npy tracks and their metadata.")
    parser.add_argument("raw")
    parser.add_argument("out")
    parser.add_argument("--pattern", default=r"^(.*?)[_.].*npy$")
    parser.add_argument("--observations")
    parser.add_argument("--tracks")
    parser.add_argument("--only", nargs="*")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    print("\n".join(ingest(spark, given.raw, given.out, given.pattern, given.observations, given.tracks, given.only)))


if __name__ == "__main__":
    main()
