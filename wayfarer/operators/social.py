"""Other animals at the end of each step, and what can be seen of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import STEP, step_key
from .raster import Layer, MapLayer, sample

POINT = [*STEP, "step_idx"]


def _point(steps: DataFrame) -> list[str]:
    return [*step_key(steps), "step_idx"]


def frame_of(frame: Column) -> Column:
    """The whole frame, half to even."""
    return F.rint(frame).cast("long")


def neighbours(steps: DataFrame, fixes: DataFrame) -> DataFrame:
    """A row for each other animal with a fix in the frame of each step's end: the step's key, x, y, neighbor_track, nx, ny, distance_m."""
    others = fixes.where("x is not null and y is not null").select(F.col("observation").alias("__o"), F.col("frame").cast("long").alias("__f"), F.col("track").alias("neighbor_track"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    met = steps.withColumn("frame_int", frame_of(F.col("frame"))).join(others, (F.col("observation") == F.col("__o")) & (F.col("frame_int") == F.col("__f")) & (F.col("track") != F.col("neighbor_track")))
    return met.drop("__o", "__f").withColumn("distance_m", g.length(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))


def density(steps: DataFrame, fixes: DataFrame, radius: float = 10.0) -> DataFrame:
    """steps with social_density, the others nearer than radius (0 if there are none), nn_distance_m and nn_track (-1)."""
    nearest = F.min_by(F.struct("distance_m", "neighbor_track"), F.struct("distance_m", "neighbor_track"))
    found = neighbours(steps, fixes).groupBy(*_point(steps)).agg(F.count_if(F.col("distance_m") < radius).alias("social_density"), nearest.alias("nn"))
    joined = steps.join(found, _point(steps), "left")
    return joined.withColumns({"social_density": F.coalesce("social_density", F.lit(0)).cast("long"), "nn_distance_m": F.col("nn.distance_m"), "nn_track": F.coalesce("nn.neighbor_track", F.lit(-1)).cast("long")}).drop("nn")


def nearest(steps: DataFrame, fixes: DataFrame, tracks: DataFrame) -> DataFrame:
    """density() with nn_individual_ID, nn_species and nn_age from tracks(observation, track, individual_ID, species, age)."""
    named = tracks.select(F.col("observation").alias("__o"), F.col("track").alias("__t"), *[F.col(c).alias("nn_" + c) for c in ("individual_ID", "species", "age")])
    return density(steps, fixes).join(named, (F.col("observation") == F.col("__o")) & (F.col("nn_track") == F.col("__t")), "left").drop("__o", "__t")


def neighbour_table(steps: DataFrame, fixes: DataFrame) -> DataFrame:
    """Each step with its neighbours in track order as an array of (track, distance_m, x, y)."""
    item = F.struct(F.col("neighbor_track").alias("track"), "distance_m", F.col("nx").alias("x"), F.col("ny").alias("y"))
    return neighbours(steps, fixes).groupBy(*_point(steps)).agg(F.array_sort(F.collect_list(item)).alias("neighbors"))


def with_missing(steps: DataFrame, fixes: DataFrame) -> DataFrame:
    """The older variant: a row for each other track of the observation, without distance where it has no fix in the frame."""
    tracks = fixes.select("observation", F.col("track").alias("neighbor_track")).distinct()
    every = steps.join(tracks, "observation").where("track <> neighbor_track").select(*_point(steps), "neighbor_track")
    found = neighbours(steps, fixes).select(*_point(steps), "neighbor_track", "distance_m")
    return every.join(found, [*_point(steps), "neighbor_track"], "left")


def sightline(rows: DataFrame, dsm: Layer | MapLayer, key: list[str], a: tuple[str, str, str], b: tuple[str, str, str], cell: tuple[str, str] | None = None) -> DataFrame:
    """key, visible: whether the line from a (x, y, z columns) to b passes above every cell between theirs.

    The cells are those nearest to equal parts of the line, as many as rows or columns are crossed; cells without data
    hide nothing; an end without height sees nothing. cell: columns of b's row and col, where b is a cell.
    """
    rows, key = dsm.at(rows), [*key, *[k for k in dsm.key if k not in key]]
    r0, c0 = dsm.row(F.col(a[1])), dsm.col(F.col(a[0]))
    r1, c1 = (F.col(cell[0]), F.col(cell[1])) if cell else (dsm.row(F.col(b[1])), dsm.col(F.col(b[0])))
    lines = rows.select(*key, r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"), F.col(a[2]).alias("z0"), F.col(b[2]).alias("z1"))
    lines = lines.withColumn("n", F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0"))))
    inner = lines.where("n > 1 and z0 is not null and z1 is not null").withColumn("k", F.explode(F.expr("sequence(1, n - 1)")))
    at = lambda p, q: F.col(p) + F.floor((2 * F.col("k") * (F.col(q) - F.col(p)) + F.col("n")) / (2 * F.col("n")))
    inner = inner.withColumns({"__row": at("r0", "r1"), "__col": at("c0", "c1"), "z": F.col("z0") + (F.col("z1") - F.col("z0")) * F.col("k") / F.col("n")})
    cells = dsm.joinable().select(*dsm.key, F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("value").alias("__v"))
    hidden = inner.join(cells, [*dsm.key, "__row", "__col"]).where("z <= __v").select(*key).distinct().withColumn("__hidden", F.lit(True))
    seen = lines.select(*key, "z0", "z1").join(hidden, key, "left")
    return seen.select(*key, (F.col("__hidden").isNull() & F.col("z0").isNotNull() & F.col("z1").isNotNull()).alias("visible"))


def visible_neighbours(steps: DataFrame, fixes: DataFrame, dsm: Layer | MapLayer, heights: Layer | MapLayer, within: float | None = None, nearest_only: int | None = None) -> DataFrame:
    """Neighbours with visible: seen from the step's end, both at head height above the surface.

    Neighbours beyond `within` metres, or not among the nearest_only nearest, are not tested and count as not visible."""
    met = neighbours(steps, fixes)
    place = Window.partitionBy(*_point(steps)).orderBy("distance_m", "neighbor_track")
    tested = met if within is None else met.where(F.col("distance_m") <= within)
    if nearest_only is not None:
        tested = tested.withColumn("place", F.row_number().over(place)).where(F.col("place") <= nearest_only).drop("place")
    for name, x, y in (("za", "x", "y"), ("zb", "nx", "ny")):
        tested = sample(sample(tested, dsm, "__s", x, y), heights, "__h", x, y).withColumn(name, F.col("__s") + F.col("__h")).drop("__s", "__h")
    key = [*_point(steps), "neighbor_track"]
    seen = sightline(tested, dsm, key, ("x", "y", "za"), ("nx", "ny", "zb"))
    return met.select(*key, "distance_m").join(seen.drop(*[k for k in dsm.key if k not in key]), key, "left").withColumn("visible", F.coalesce("visible", F.lit(False)))


def annotated(steps: DataFrame, fixes: DataFrame, tracks: DataFrame, dsm: Layer | MapLayer, heights: Layer | MapLayer | None = None, radius: float = 10.0, within: float | None = None, nearest_only: int | None = None) -> DataFrame:
    """A row for each step, with its social_density, social_visible_count, nn_distance_m, nn_track, nn_visible and
    nn_individual_ID, nn_species, nn_age from tracks(observation, track, individual_ID, species, age).

    A step without other animals in its frame, or off the surface's grid, has density 0, none visible, nn_track -1 and
    null for the rest. Without heights nothing is tested for sight: none is visible, nn_visible is null. A nearest
    animal that `within` or nearest_only leave untested is not visible."""
    located = dsm.at(steps)
    row, col = dsm.row(F.col("y")), dsm.col(F.col("x"))
    inside = dsm.without_grid(located.where(dsm.inside(row, col)))
    found = density(inside, fixes, radius).select(*_point(steps), "social_density", "nn_distance_m", "nn_track")
    if heights is None:
        seen = found.select(*_point(steps)).withColumns({"social_visible_count": F.lit(0).cast("long"), "nn_visible": F.lit(None).cast("boolean")})
    else:
        seen = visible_neighbours(inside, fixes, dsm, heights, within, nearest_only).groupBy(*_point(steps))
        seen = seen.agg(F.count_if("visible").alias("social_visible_count"), F.min_by("visible", F.struct("distance_m", "neighbor_track")).alias("nn_visible"))
    named = tracks.select(F.col("observation").alias("__o"), F.col("track").alias("__t"), *[F.col(c).alias("nn_" + c) for c in ("individual_ID", "species", "age")])
    rows = steps.join(found, _point(steps), "left").join(seen, _point(steps), "left")
    rows = rows.withColumns({"social_density": F.coalesce("social_density", F.lit(0)).cast("long"), "social_visible_count": F.coalesce("social_visible_count", F.lit(0)).cast("long"), "nn_track": F.coalesce("nn_track", F.lit(-1)).cast("long")})
    return rows.join(named, (F.col("observation") == F.col("__o")) & (F.col("nn_track") == F.col("__t")), "left").drop("__o", "__t")
