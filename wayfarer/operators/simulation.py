"""Alternative steps: from each observed point, end points at the observed length in other directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.draws import uniform
from ..model import TRACK, step_key
from .raster import Layer, MapLayer, where_data
from .trajectory import moves, turns

POOLS = {"track": TRACK, "observation": ["observation"], "global": []}
MOST_TRIALS = 50  # trials per step and wanted alternative


def numbered(rows: DataFrame, key: list[str], order: list[str], levels: list[str]) -> DataFrame:
    """rows with place, from 0 in the order of `order` within each key, and n, the key's rows.

    order begins with key and levels: counts per level are summed up from the widest to the narrowest, so that no
    window holds more than one level's groups or one group's rows, even where the key is empty."""
    sums, last = None, list(key)
    for level in levels:
        group = [*last, level]
        counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*last).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        counts = counts.withColumn("__before", before).drop("__n")
        if sums is not None:
            counts = counts.join(sums.withColumnRenamed("__before", "__outer"), last).withColumn("__before", F.col("__before") + F.col("__outer")).drop("__outer")
        sums, last = counts, group
    own = F.row_number().over(Window.partitionBy(*last).orderBy(*[c for c in order if c not in last])) - 1
    found = rows.withColumn("place", own.cast("long"))
    if sums is not None:
        found = found.join(sums, last).withColumn("place", F.col("place") + F.col("__before")).drop("__before")
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, key) if key else found.crossJoin(F.broadcast(sizes))


def turning_pool(steps: DataFrame, pool: str, offsets: list[float] | None = None, observations: list | None = None) -> DataFrame:
    """Turning angles in each pool, numbered from 0: the pool's key, pool_idx, delta, pool_n. All offsets and
    observations are in it unless some are named."""
    if pool not in POOLS:
        raise ValueError(f"pool is one of {sorted(POOLS)}")
    key = POOLS[pool]
    found = turns(steps)
    if offsets is not None:
        found = found.where(F.col("offset_m").isin([float(x) for x in offsets]))
    if observations is not None:
        found = found.where(F.col("observation").isin(observations))
    order = [*step_key(steps), "step_idx"]
    made = numbered(found, key, order, [c for c in TRACK if c not in key])
    return made.select(*key, F.col("place").alias("pool_idx"), "delta", F.col("n").alias("pool_n"))


def starts(steps: DataFrame) -> DataFrame:
    """Points with a next point: x, y, target_step_index, length_m, frame of the next, and base, the heading the animal
    arrives with (the first point's is that of its own move)."""
    key = step_key(steps)
    w = Window.partitionBy(*key).orderBy("step_idx")
    made = moves(steps).withColumns({"next_length": F.lead("length_m").over(w), "next_frame": F.lead("frame").over(w), "next_heading": F.lead("heading").over(w)})
    made = made.where("next_length is not null")
    return made.select(*key, F.col("step_idx").alias("target_step_index"), "x", "y", *[c for c in ("big_map",) if c in steps.columns], F.col("next_length").alias("length_m"), F.col("next_frame").alias("frame"), F.coalesce("heading", "next_heading").alias("base"))


def _tried(begin: DataFrame, first: int, last: int, seed: str, pool: DataFrame | None, pool_key: list[str]) -> DataFrame:
    tries = begin.withColumn("trial", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    key: list[Column] = [F.col("observation"), F.col("track"), *[F.col(c) for c in step_key(begin) if c == "step_length"], F.col("offset_m").cast("long"), F.col("target_step_index"), F.col("trial")]
    tries = tries.withColumn("u", uniform(seed, *key))
    if pool is None:
        tries = tries.withColumn("theta", F.col("u") * g.TWO_PI)
    else:
        sizes = pool.groupBy(*pool_key).agg(F.first("pool_n").alias("pool_n")) if pool_key else pool.agg(F.first("pool_n").alias("pool_n"))
        tries = tries.join(sizes, pool_key, "left") if pool_key else tries.crossJoin(F.broadcast(sizes))
        tries = tries.withColumn("pool_idx", F.floor(F.col("u") * F.col("pool_n"))).join(pool.drop("pool_n"), [*pool_key, "pool_idx"], "left")
        tries = tries.withColumn("theta", g.wrap(F.col("base") + F.coalesce("delta", F.col("u") * g.TWO_PI - F.pi())))
    end = {"end_x": F.col("x") + F.col("length_m") * F.cos("theta"), "end_y": F.col("y") + F.col("length_m") * F.sin("theta")}
    return tries.withColumns(end).select(*step_key(begin), "target_step_index", *[c for c in ("big_map",) if c in begin.columns], "trial", "theta", F.col("x").alias("px"), F.col("y").alias("py"), "length_m", "frame", F.col("end_x").alias("x"), F.col("end_y").alias("y"))


def simulate(steps: DataFrame, n: int, angles: str = "uniform", layer: Layer | MapLayer | None = None, seed: str = "sim", pool_offsets: list[float] | None = None, pool_observations: list | None = None) -> DataFrame:
    """Up to n alternatives for each observed step, numbered by replicate in the order in which their trials were accepted.

    angles: 'uniform' over all directions, or 'track', 'observation' or 'global': the arriving heading turned by an
    angle drawn from that pool (any turn if the pool is empty). A trial whose end is off the layer or without data is
    rejected: n trials are made without a layer; with one 2n for all steps, and up to MOST_TRIALS * n only for steps
    that are still short. pool_offsets and pool_observations name what the pool is drawn from, by default all steps.
    """
    if angles != "uniform" and angles not in POOLS:
        raise ValueError(f"angles is uniform or one of {sorted(POOLS)}")
    key = [*step_key(steps), "target_step_index"]
    begin = starts(steps)
    pool, pool_key = (None, []) if angles == "uniform" else (turning_pool(steps, angles, pool_offsets, pool_observations), POOLS[angles])
    accepted = where_data(_tried(begin, 0, (2 if layer is not None else 1) * n - 1, seed, pool, pool_key), layer)
    order = Window.partitionBy(*key).orderBy("trial")
    accepted = accepted.withColumn("replicate", (F.row_number().over(order) - 1).cast("long"))
    if layer is not None:
        # both uses of the numbered first round read one shuffle
        short = begin.join(accepted.where(F.col("replicate") == n - 1).select(*key), key, "left_anti")
        more = where_data(_tried(short, 2 * n, MOST_TRIALS * n - 1, seed, pool, pool_key), layer)
        accepted = accepted.drop("replicate").unionByName(more).withColumn("replicate", (F.row_number().over(order) - 1).cast("long"))
    return accepted.where(F.col("replicate") < n)


def simulate_jointly(steps: DataFrame, n: int, seed: str = "joint", angles: str = "observed", layer: Layer | MapLayer | None = None) -> DataFrame:
    """The older variant: each alternative takes the length and the turn of one of the track's own steps together.

    Only lengths from the second step on are in the pool, each with the turn that leads to it (degrees); the new
    direction is the arriving compass heading plus that turn, or, with 'halfplane', plus a whole number of degrees
    from 0 to 179. Trials off the layer or without data are rejected, up to MOST_TRIALS * n for a step."""
    if angles not in ("observed", "halfplane"):
        raise ValueError("angles is observed or halfplane")
    walk = step_key(steps)
    found = moves(steps)
    w = Window.partitionBy(*walk).orderBy("step_idx")
    turned = found.withColumns({"bx": F.lag("dx").over(w), "by": F.lag("dy").over(w)}).where("bx is not null")
    turn = g.turning_degrees(F.col("bx"), F.col("by"), F.col("dx"), F.col("dy"))
    pool = turned.select(*walk, (F.row_number().over(w) - 1).cast("long").alias("pool_idx"), F.col("length_m").alias("pool_length"), turn.alias("turn"), F.count(F.lit(1)).over(Window.partitionBy(*walk)).alias("pool_n"))
    sizes = pool.groupBy(*walk).agg(F.first("pool_n").alias("pool_n"))
    trials = n if layer is None else MOST_TRIALS * n
    tries = starts(steps).join(sizes, walk).withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))))
    draw = lambda s: uniform(s, F.col("observation"), F.col("track"), F.col("offset_m").cast("long"), F.col("target_step_index"), F.col("trial"))
    drawn = tries.withColumn("pool_idx", F.floor(draw(seed) * F.col("pool_n"))).join(pool.drop("pool_n"), [*walk, "pool_idx"])
    if angles == "halfplane":
        drawn = drawn.withColumn("turn", F.floor(draw(seed + "-angle") * 180).cast("double"))
    compass = F.pi() / 2 - F.col("base") + F.radians("turn")
    ends = drawn.withColumns({"x": F.col("x") + F.col("pool_length") * F.sin(compass), "y": F.col("y") + F.col("pool_length") * F.cos(compass)})
    order = Window.partitionBy(*walk, "target_step_index").orderBy("trial")
    kept = where_data(ends, layer).withColumn("replicate", (F.row_number().over(order) - 1).cast("long")).where(F.col("replicate") < n)
    return kept.select(*walk, "target_step_index", "replicate", F.col("pool_length").alias("length_m"), "turn", "x", "y", "frame")


def step_id(frame: str = "frame", replicate: Column | None = None) -> Column:
    """The older tables' name of a step: observation, track and whole frame; _ob for observed, _sim- and a number for others."""
    base = F.concat(F.col("observation").cast("string"), F.lit("_"), F.col("track").cast("string"), F.lit("_f"), F.rint(frame).cast("long").cast("string"))
    return F.concat(base, F.lit("_ob") if replicate is None else F.concat(F.lit("_sim-"), replicate.cast("string")))


def with_ids(steps: DataFrame, simulated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with id; observed steps with prev_step, the id before; simulated ones with target_id, the id of the
    observed step that they stand against (the end of the same move). Only walks of more than two points have simulated steps."""
    w = Window.partitionBy(*step_key(steps)).orderBy("step_idx")
    observed = steps.withColumn("id", step_id()).withColumn("prev_step", F.lag("id").over(w))
    walks = steps.groupBy(*step_key(steps)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 2").drop("__n")
    others = simulated.join(walks, step_key(steps), "left_semi")
    return observed, others.withColumn("id", step_id(replicate=F.col("replicate"))).withColumn("target_id", step_id())
