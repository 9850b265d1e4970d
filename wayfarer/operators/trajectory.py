"""Densifying tracks and cutting them into steps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import STEP, TRACK, require_columns, step_key


def _by_frame() -> Window:
    return Window.partitionBy(*TRACK).orderBy("frame")


def densify(fixes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Points along every segment between consecutive fixes: n = max(int(length / tolerance), 2), both ends included.

    A segment with a missing end gives one row without position, and the last segment of a track another for its end.
    A track of one fix is returned as it is. Columns: observation, track, seg, k, frame, x, y.
    """
    require_columns(fixes, *TRACK, "frame", "x", "y")
    w = _by_frame()
    nx, ny, nf = (F.lead(c).over(w) for c in ("x", "y", "frame"))
    seg = fixes.select(*TRACK, "frame", "x", "y", nx.alias("nx"), ny.alias("ny"), nf.alias("nf"), (F.row_number().over(w) - 1).cast("long").alias("seg"), F.count(F.lit(1)).over(Window.partitionBy(*TRACK)).alias("fixes"))
    seg = seg.withColumn("gap", F.col("x").isNull() | F.col("nx").isNull())
    last = F.col("seg") == F.col("fixes") - 2
    n = F.greatest(F.floor(g.length(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")) / tolerance), F.lit(2)).cast("long")
    n = F.when(F.col("fixes") == 1, 1).when(F.col("gap"), F.when(last, 2).otherwise(1)).otherwise(n)
    rows = seg.where((F.col("seg") < F.col("fixes") - 1) | (F.col("fixes") == 1)).withColumn("n", n).withColumn("k", F.explode(F.expr("sequence(0L, n - 1)")))
    share = F.col("k") / F.greatest(F.col("n") - 1, F.lit(1))
    between = lambda a, b: F.when(F.col("k") == F.col("n") - 1, F.col(b)).otherwise(F.col(a) + share * (F.col(b) - F.col(a)))
    single = F.col("fixes") == 1
    place = lambda a, b: F.when(single, F.col(a)).when(~F.col("gap"), between(a, b))
    frame = F.when(single, F.col("frame")).when(F.col("gap"), F.when(F.col("k") == 0, F.col("frame")).otherwise(F.col("nf"))).otherwise(between("frame", "nf"))
    return rows.select(*TRACK, "seg", "k", frame.cast("double").alias("frame"), place("x", "nx").alias("x"), place("y", "ny").alias("y"))


def densify_distinct(fixes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """densify() without repeated (frame, x, y). Only shared ends of neighbouring segments repeat, so no shuffle is
    needed beyond the track's own: a segment's last point stays only where the next segment doesn't begin with it."""
    dense = densify(fixes, tolerance)
    w = Window.partitionBy(*TRACK).orderBy("seg", "k")
    same = lambda c: F.col(c).eqNullSafe(F.lag(c).over(w))
    repeated = F.row_number().over(w) > 1
    return dense.withColumn("again", repeated & same("frame") & same("x") & same("y")).where(~F.col("again")).drop("again")


def walk_arc(fixes: DataFrame, step_length: float, offsets: list[float]) -> DataFrame:
    """Points at arc lengths offset, offset + L, ... along each track: observation, track, offset_m, step_idx, frame, x, y.

    Missing fixes are bridged. Each segment makes the points that fall in it (the last one also at its end, with 1e-9
    to spare), so no join is needed and offsets cost no shuffle. A track without length gives its first point for
    offset 0. Points of densify() would give the same, as they lie on the same line.
    """
    require_columns(fixes, *TRACK, "frame", "x", "y")
    w = _by_frame()
    points = fixes.where("x is not null and y is not null").select(*TRACK, F.col("frame").cast("double").alias("frame"), "x", "y")
    seg = points.select("*", *[F.lead(c).over(w).alias("n" + c) for c in ("x", "y", "frame")], F.row_number().over(w).alias("k"))
    seg = seg.withColumn("len", F.coalesce(g.length(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")), F.lit(0.0)))
    seg = seg.withColumn("to", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seg = seg.withColumn("total", F.max("to").over(Window.partitionBy(*TRACK))).withColumn("from", F.coalesce(F.lag("to").over(w), F.lit(0.0)))
    seg = seg.withColumn("last", F.lead("nx").over(w).isNull())
    each = seg.where("nx is not null or k = 1").withColumn("offset_m", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    targets = F.expr(f"cast(ceil((total + 1e-9 - offset_m) / {step_length}) as bigint)")
    each = each.withColumn("targets", targets).where("(total > 0 and nx is not null and offset_m <= total) or (total = 0 and k = 1 and offset_m = 0)")
    low = F.greatest(F.floor((F.col("from") - F.col("offset_m")) / step_length) - 1, F.lit(0)).cast("long")
    high = F.least(F.ceil((F.col("to") - F.col("offset_m")) / step_length) + 1, F.col("targets") - 1).cast("long")
    each = each.withColumn("low", low).withColumn("high", F.when(F.col("total") == 0, F.lit(0).cast("long")).otherwise(high)).where("high >= low")
    found = each.withColumn("step_idx", F.explode(F.sequence("low", "high"))).withColumn("t", F.col("offset_m") + F.col("step_idx") * step_length)
    found = found.where(F.when(F.col("total") == 0, F.lit(True)).otherwise((F.col("t") >= F.col("from")) & ((F.col("t") < F.col("to")) | F.col("last"))))
    share = F.when(F.col("len") > 0, (F.col("t") - F.col("from")) / F.col("len")).otherwise(F.lit(0.0))
    at = lambda c: F.coalesce(F.col(c) + share * (F.col("n" + c) - F.col(c)), F.col(c))
    return found.select(*STEP, "step_idx", at("frame").alias("frame"), at("x").alias("x"), at("y").alias("y"))


def walk_lengths(fixes: DataFrame, offsets: dict[float, list[float]]) -> DataFrame:
    """walk_arc() for several step lengths, each with its offsets, in one table with a column step_length. What works on
    steps keeps walks of different lengths apart by it."""
    walks = [walk_arc(fixes, length, own).withColumn("step_length", F.lit(float(length))) for length, own in sorted(offsets.items())]
    return reduce(DataFrame.unionByName, walks)


def walk_chord(fixes: DataFrame, step_length: float, offset: float = 0.0, allowed: Column | None = None) -> DataFrame:
    """Each next point is the first at a straight distance of at least L from the last: observation, track, step_idx, frame, x, y.

    With an offset, the first point at that distance from the track's begin is the first step; if there is none, the
    walk goes on from the begin, which is not a step. Points where `allowed` doesn't hold are passed over. The walk
    needs one point after the other: a task goes along its sorted tracks and holds no more than the last point, with an
    offset also the steps from the begin until it is known whether they count.
    """
    require_columns(fixes, *TRACK, "frame", "x", "y")
    usable = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    points = fixes.where("x is not null and y is not null").select(*TRACK, F.col("frame").cast("double").alias("frame"), "x", "y", usable.alias("ok"))
    ordered = points.repartition(*TRACK).sortWithinPartitions(*TRACK, "frame")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, begin, last, steps, spare = None, None, None, 0, []
        for batch in batches:
            out = []
            for observation, number, frame, x, y, ok in batch.itertuples(index=False):
                if (observation, number) != track:
                    out += spare
                    track, begin, spare = (observation, number), (x, y), []
                    last, steps = begin, 0
                    searching = offset > 0
                    if not searching:
                        out.append((*track, 0, frame, x, y))
                        steps = 1
                    continue
                if searching and ((x - begin[0]) ** 2 + (y - begin[1]) ** 2) ** 0.5 >= offset:
                    # what was walked from the begin doesn't count: the walk starts here
                    searching, spare, last, steps = False, [], (x, y), 1
                    out.append((*track, 0, frame, x, y))
                elif ok and ((x - last[0]) ** 2 + (y - last[1]) ** 2) ** 0.5 >= step_length:
                    (spare if searching else out).append((*track, steps, frame, x, y))
                    last, steps = (x, y), steps + 1
            yield pd.DataFrame(out, columns=[*TRACK, "step_idx", "frame", "x", "y"])
        yield pd.DataFrame(spare, columns=[*TRACK, "step_idx", "frame", "x", "y"])

    kinds = {f.name: f.dataType.simpleString() for f in fixes.schema.fields}
    return ordered.mapInPandas(walk, f"observation {kinds['observation']}, track {kinds['track']}, step_idx bigint, frame double, x double, y double")


def at_least(steps: DataFrame, n: int = 5) -> DataFrame:
    """Steps of tracks (per offset) that have n points or more."""
    return steps.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*step_key(steps)))).where(F.col("__n") >= n).drop("__n")


def moves(steps: DataFrame) -> DataFrame:
    """steps with the move that leads to each point: px, py, pframe, dx, dy, length_m, heading; null for first points."""
    w = Window.partitionBy(*step_key(steps)).orderBy("step_idx")
    found = steps.select("*", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.lag("frame").over(w).alias("pframe"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return found.withColumns({"dx": dx, "dy": dy}).withColumns({"length_m": g.length(F.col("dx"), F.col("dy")), "heading": g.heading(F.col("dx"), F.col("dy"))})


def turns(steps: DataFrame) -> DataFrame:
    """Turning angles, wrapped to [-pi, pi), between consecutive moves: observation, track, offset_m, step_idx, delta."""
    w = Window.partitionBy(*step_key(steps)).orderBy("step_idx")
    found = moves(steps).withColumn("before", F.lag("heading").over(w)).where("before is not null")
    return found.select(*step_key(steps), "step_idx", g.wrap(F.col("heading") - F.col("before")).alias("delta"))
