"""Step features: geometry relative to an observer, and the tables that a model is trained from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.draws import uniform
from ..model import step_key
from .trajectory import moves

FPS = 30.0
LEAST = 1e-6


def observer_features(made: DataFrame, fps: float = FPS) -> DataFrame:
    """made(px, py, pframe, x, y, frame, easting, northing) with the seven features of the move to (x, y).

    step_length_m, step_duration_s, step_speed_mps, dist_to_observer (at the end), delta_observer_dist (end less start),
    angle_to_observer (degrees between the move and the way from its start to the observer) and heading_deg. All are null
    where there is no start, the speed also without duration, the angle also without length.
    """
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    away = lambda x, y: g.length(F.col("easting") - F.col(x), F.col("northing") - F.col(y))
    seconds = (F.col("frame") - F.col("pframe")) / fps
    starts = F.col("px").isNotNull()
    return made.withColumns(
        {
            "step_length_m": g.length(dx, dy),
            "step_duration_s": seconds,
            "step_speed_mps": g.length(dx, dy) / F.when(seconds != 0, seconds),
            "dist_to_observer": F.when(starts, away("x", "y")),
            "delta_observer_dist": away("x", "y") - away("px", "py"),
            "angle_to_observer": g.angle_between(dx, dy, F.col("easting") - F.col("px"), F.col("northing") - F.col("py")),
            "heading_deg": F.degrees(g.heading(dx, dy)),
        }
    )


OBSERVER = ["step_length_m", "step_duration_s", "step_speed_mps", "dist_to_observer", "delta_observer_dist", "angle_to_observer", "heading_deg"]


def each_once(lookup: DataFrame, *key: str) -> DataFrame:
    """lookup, whose reading fails if it has a key more than once: a step would come out twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    once = F.when(n == 1, True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("more than one row of"), *[F.col(k).cast("string") for k in key])).cast("boolean"))
    return lookup.withColumn("__once", once).where("__once").drop("__once")


def observed_features(steps: DataFrame, observers: DataFrame, fps: float = FPS) -> DataFrame:
    """Features of observed steps; observers(observation, easting, northing) is one row per observation."""
    return observer_features(moves(steps).select(*step_key(steps), "step_idx", "frame", "x", "y", "px", "py", "pframe").join(each_once(observers, "observation"), "observation"), fps)


def simulated_features(simulated: DataFrame, steps: DataFrame, observers: DataFrame, fps: float = FPS) -> DataFrame:
    """Features of simulated steps, whose start is the observed point target_step_index."""
    begin = steps.select(*step_key(steps), F.col("step_idx").alias("target_step_index"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("frame").alias("pframe"))
    return observer_features(simulated.drop("px", "py").join(begin, [*step_key(steps), "target_step_index"]).join(each_once(observers, "observation"), "observation"), fps)


#: How each feature is transformed before it is normalised.
ANGLES, SHARES, LOGS, LOG1PS = ("angle_to_observer",), ("viewshed_vis", "trail_probability"), ("dist_to_observer", "step_speed_mps"), ("step_speed_mps", "dist_to_observer", "social_density", "social_visible", "nn_distance_m")


def transformed(feature: str) -> Column:
    """Angles in half turns, logit of shares, log of distances and speeds (both at least 1e-6); others as they are."""
    x = F.col(feature)
    if feature in ANGLES:
        return x / 180.0
    if feature in SHARES:
        p = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(LEAST)), F.lit(1 - LEAST)))
        return F.log(p / (1 - p))
    if feature in LOGS:
        return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(LEAST))))
    return x


def transformed_log1p(feature: str) -> Column:
    """The older transform: angles in half turns, log(1 + x) of speeds, distances and counts."""
    x = F.col(feature)
    return x / 180.0 if feature in ANGLES else F.log1p(x) if feature in LOG1PS else x


def numeric_stats(rows: DataFrame, features: list[str], transform=transformed) -> DataFrame:
    """feature, n, mean, std of the transformed features over values that are there.

    With fewer than two values mean 0 and std 1; a std of 0 is 1."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), transform(f).cast("double").alias("value")) for f in features])
    stats = rows.select(F.inline(pairs)).groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    enough = F.col("n") >= 2
    return stats.select("feature", "n", F.when(enough, F.col("m")).otherwise(0.0).alias("mean"), F.when(enough & (F.col("s") > 0), F.col("s")).otherwise(1.0).alias("std"))


def normalised(rows: DataFrame, features: list[str], stats: DataFrame, transform=transformed) -> DataFrame:
    """rows with <feature>_z; features without statistics have mean 0 and std 1."""
    by_name = (stats.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("__stats")))
    z = lambda f: (transform(f) - F.coalesce(F.try_element_at("__stats", F.lit(f))["mean"], F.lit(0.0))) / F.coalesce(F.try_element_at("__stats", F.lit(f))["std"], F.lit(1.0))
    return rows.crossJoin(by_name).withColumns({f + "_z": z(f) for f in features}).drop("__stats")


def vocabulary(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, value, idx: the distinct values of each categorical feature in string order; a missing value is ''."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in features])
    values = rows.select(F.inline(pairs)).distinct()
    return values.withColumn("idx", (F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1).cast("long"))


def one_hot(rows: DataFrame, feature: str, values: DataFrame) -> DataFrame:
    """rows with <feature>_onehot, an array as long as the feature's vocabulary; all zero for an unknown value."""
    known = (values.where(F.col("feature") == feature).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("__known")))
    own = F.coalesce(F.col(feature).cast("string"), F.lit(""))
    return rows.crossJoin(known).withColumn(feature + "_onehot", F.transform("__known", lambda v: F.when(v == own, 1.0).otherwise(0.0))).drop("__known")


GROUND_NAMES = {0: "unclassified", 1: "bare", 2: "grass", 3: "tree", 4: "road"}


def ground_one_hot(rows: DataFrame) -> DataFrame:
    """rows with a column ground_<name> for each of the five ground classes."""
    return rows.withColumns({"ground_" + name: F.when(F.col("ground_class") == code, 1).otherwise(0).cast("long") for code, name in GROUND_NAMES.items()})


#: Categories that a training example may hold.
CATEGORICAL = ("age", "nn_age", "species", "nn_species", "ground_class", "ground_class_name", "nn_visible")


def feature_vector(numeric: list[str], hot: list[str], absent: list[str] | tuple[str, ...] = ()) -> Column:
    """Normalised features in order, then the one-hot arrays; a missing number stays null, one that the table has no
    column for (absent) is 0."""
    return F.concat(F.array(*[F.lit(0.0) if f in absent else F.col(f + "_z") for f in numeric]), *[F.col(f + "_onehot") for f in hot])


def sample_index(steps: DataFrame, simulated: DataFrame, context: int) -> DataFrame:
    """Points with `context` points before them, a next point and at least one alternative: key, step_idx, n_sims."""
    key = step_key(steps)
    sims = simulated.groupBy(*key, F.col("target_step_index").alias("step_idx")).agg(F.count(F.lit(1)).alias("n_sims"))
    return steps.where(F.col("step_idx") >= context).select(*key, "step_idx").join(sims, [*key, "step_idx"])


def context_window(steps: DataFrame, context: int, value: Column) -> DataFrame:
    """steps with context: `value` of the points before, oldest first, at most `context` of them."""
    w = Window.partitionBy(*step_key(steps)).orderBy("step_idx").rowsBetween(-context, -1)
    return steps.withColumn("context", F.collect_list(value).over(w))


def chosen(simulated: DataFrame, most: int, seed: str = "choice") -> DataFrame:
    """At most `most` alternatives for each step, drawn without replacement by a keyed hash."""
    key = [*step_key(simulated), "target_step_index"]
    u = uniform(seed, F.col("observation"), F.col("track"), F.col("offset_m").cast("long"), F.col("target_step_index"), F.col("replicate"))
    order = Window.partitionBy(*key).orderBy(u, "replicate")
    return simulated.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).drop("__k")


def training_examples(observed: DataFrame, simulated: DataFrame, context: int, most: int, fields: list[str] | str) -> DataFrame:
    """One row per sample: its key, observed (vector), context (vectors, oldest first) and simulated (vectors by replicate).

    The observed move is the one to the next point; observed and simulated have the columns in fields, or one column
    that is the vector. meta names the sample: its walk, target and whether all `most` alternatives are there."""
    vector = F.col(fields) if isinstance(fields, str) else F.array(*[F.col(f) for f in fields])
    key = step_key(observed)
    w = Window.partitionBy(*key).orderBy("step_idx")
    points = context_window(observed, context, vector).withColumn("observed", F.lead(vector).over(w)).where((F.col("step_idx") >= context) & F.col("observed").isNotNull())
    own = chosen(simulated, most).groupBy(*key, F.col("target_step_index").alias("step_idx"))
    own = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", vector.alias("v")))), lambda x: x["v"]).alias("simulated"))
    meta = F.struct(*key, F.col("step_idx").alias("target_step_index"), (F.size("simulated") == most).alias("full"))
    return points.select(*key, "step_idx", "observed", "context").join(own, [*key, "step_idx"]).withColumn("meta", meta)


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in all of these columns."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def local_index(rows: DataFrame) -> DataFrame:
    """rows with local_index, their place in the track and offset."""
    return rows.withColumn("local_index", (F.row_number().over(Window.partitionBy(*step_key(rows)).orderBy("step_idx")) - 1).cast("long"))
