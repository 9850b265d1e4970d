"""A query for each operator, with its statement in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import STEP, TRACK, rounded
from ..operators import features as ft
from ..operators import loader_v1 as v1
from ..operators import raster as ra
from ..operators import simulation as si
from ..operators import social as so
from ..operators import trajectory as tr
from ..operators import viewshed as vs
from ..sources import catalog as ca
from ..sources import fixtures as fx
from ..sources import store
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
L = o.L
ALL = (0.0, 1.0, 2.0, 3.0, 4.0)
SIMS = 3


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns or df.columns])


def r(*columns: str, digits: int = 6) -> str:
    """SQL for the same rounding."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c.split('.')[-1]}" for c in columns)


def steps(spark, sf, offsets=(0.0,)) -> DataFrame:
    return tr.walk_arc(fx.fixes(spark, sf), L, list(offsets))


K = "observation, track, offset_m"
S = f"{K}, step_idx"

# tracks and metadata


@query("fixes_scan", f"WITH {o.FIXES} SELECT * FROM fixes")
def _(spark, sf):
    return fx.fixes(spark, sf)


@query("obs_filter", f"WITH {o.FIXES} SELECT 'observation' || observation AS observation, track, frame, x, y FROM fixes WHERE observation IN (0, 2)")
def _(spark, sf):
    return ca.only(fx.fixes(spark, sf).withColumn("observation", F.concat(F.lit("observation"), F.col("observation").cast("string"))), ["ob0", 2])


_NAMES = "CASE WHEN c_custkey % 3 = 0 THEN 'ob' || c_custkey WHEN c_custkey % 3 = 1 THEN 'Observation' || c_custkey ELSE c_name END"


def _names(spark, sf):
    n, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    return fx.table(spark, sf, "customer").select("c_custkey", F.when(k == 0, F.concat(F.lit("ob"), n)).when(k == 1, F.concat(F.lit("Observation"), n)).otherwise(F.col("c_name")).alias("name"))


@query("obs_label_normalize", f"SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'observation' || c_custkey ELSE c_name END AS label FROM customer")
def _(spark, sf):
    return _names(spark, sf).select("c_custkey", ca.label(F.col("name")).alias("label"))


@query("obs_id_from_filename", "SELECT c_custkey, 'observation' || c_custkey AS observation FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 3 = 2")
def _(spark, sf):
    path = F.concat(F.lit("/data/raw/"), F.col("name"), F.when(F.col("c_custkey") % 3 < 2, "_utm_tracks.npy").otherwise(".npy"))
    return _names(spark, sf).select("c_custkey", ca.label(ca.observation_of(path, r"^(.*)_utm_tracks\.npy$")).alias("observation"))


@query("track_meta_pad_join", f"""WITH {o.FIXES}, {o.TRACKS}, n AS (SELECT observation, MAX(track) + 1 AS n FROM fixes GROUP BY 1), t AS (SELECT observation, unnest(range(0, n)) AS track FROM n)
    SELECT t.observation, t.track, individual_ID, species, coalesce(age, '') AS age FROM t LEFT JOIN meta m ON m.observation = t.observation AND m.track = t.track""")
def _(spark, sf):
    counts = fx.fixes(spark, sf).groupBy("observation").agg((F.max("track") + 1).alias("n_tracks"))
    found = ca.padded_tracks(counts, fx.track_metadata(spark, sf), "individual_ID")
    return found.select(*TRACK, "individual_ID", "species", ca.text(F.col("age")).alias("age"))


@query("missing_obs_except", f"WITH {o.FIXES} SELECT CAST(s_suppkey AS BIGINT) AS observation FROM supplier WHERE s_suppkey NOT IN (SELECT observation FROM fixes)")
def _(spark, sf):
    return ca.missing(fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("observation")), fx.fixes(spark, sf))


@query("attrs_summary", f"WITH {o.FIXES} SELECT observation, COUNT(DISTINCT track) AS n_tracks, MAX(frame) + 1 AS n_frames, COUNT(x) AS n_fixes FROM fixes GROUP BY 1")
def _(spark, sf):
    return ca.summary(fx.fixes(spark, sf))


@query("attrs_json", f"""WITH {o.FIXES}, {o.OBSERVERS} SELECT observation, '{{"easting":' || CAST(CAST(easting AS BIGINT) AS VARCHAR) || ',"big_map":"' || big_map || '"}}' AS attrs FROM obs""")
def _(spark, sf):
    rows = fx.observers(spark, sf).withColumn("easting", F.col("easting").cast("long"))
    return rows.select("observation", ca.attributes(rows, "easting", "big_map").alias("attrs"))


@query("frame_downsample", f"WITH {o.FIXES} SELECT * FROM fixes WHERE frame % 4 = 0")
def _(spark, sf):
    return ca.thinned(fx.fixes(spark, sf), 20, 80)


@query("track_resolve", f"WITH {o.FIXES} SELECT * FROM fixes WHERE track = 3")
def _(spark, sf):
    return ca.track_rows(fx.fixes(spark, sf), 3)


@query("ragged_starts", f"""WITH {o.FIXES}, c AS (SELECT observation, track, COUNT(*) AS track_count FROM fixes GROUP BY 1, 2)
    SELECT *, CAST(coalesce(SUM(track_count) OVER (PARTITION BY observation ORDER BY track ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS track_start FROM c""")
def _(spark, sf):
    return ca.track_extents(fx.fixes(spark, sf))


# dense tracks

_DENSE = (
    o.FIXES
    + """, w AS (SELECT *, ROW_NUMBER() OVER v - 1 AS seg, LEAD(x) OVER v AS nx, LEAD(y) OVER v AS ny, LEAD(frame) OVER v AS nf, COUNT(*) OVER (PARTITION BY observation, track) AS c
    FROM fixes WINDOW v AS (PARTITION BY observation, track ORDER BY frame)),
g AS (SELECT *, x IS NULL OR nx IS NULL AS gap FROM w WHERE seg < c - 1 OR c = 1),
s AS (SELECT *, CASE WHEN c = 1 THEN 1 WHEN gap THEN CASE WHEN seg = c - 2 THEN 2 ELSE 1 END ELSE greatest(CAST(floor(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) / 0.05) AS BIGINT), 2) END AS n FROM g),
k AS (SELECT *, unnest(range(0, n)) AS k FROM s),
dense AS (SELECT observation, track, seg, k,
    CASE WHEN c = 1 THEN CAST(frame AS DOUBLE) WHEN gap THEN CASE WHEN k = 0 THEN frame ELSE nf END WHEN k = n - 1 THEN nf ELSE frame + k / (n - 1) * (nf - frame) END AS frame,
    CASE WHEN c = 1 THEN x WHEN gap THEN NULL WHEN k = n - 1 THEN nx ELSE x + k / (n - 1) * (nx - x) END AS x,
    CASE WHEN c = 1 THEN y WHEN gap THEN NULL WHEN k = n - 1 THEN ny ELSE y + k / (n - 1) * (ny - y) END AS y FROM k)"""
)


@query("dense_v2", f"WITH {_DENSE} SELECT observation, track, seg, k, {r('frame', 'x', 'y', digits=9)} FROM dense")
def _(spark, sf):
    return shown(tr.densify(fx.fixes(spark, sf)), digits=9)


@query("dense_v1_dedup", f"WITH {_DENSE} SELECT DISTINCT observation, track, {r('frame', 'x', 'y', digits=9)} FROM dense")
def _(spark, sf):
    return shown(tr.densify_distinct(fx.fixes(spark, sf)), *TRACK, "frame", "x", "y", digits=9)


# walks


@query("walk_arc", f"WITH {o.steps()} SELECT {S}, {r('frame', 'x', 'y')} FROM steps")
def _(spark, sf):
    return shown(steps(spark, sf))


@query("walk_arc_multi_offset", f"WITH {o.steps(ALL)} SELECT {S}, {r('frame', 'x', 'y')} FROM steps")
def _(spark, sf):
    return shown(steps(spark, sf, ALL))


def _chord(ok: str, extra: str = "") -> str:
    return f"""WITH RECURSIVE {o.FIXES}{extra}, q AS (SELECT observation, track, frame, x, y, {ok} AS ok FROM fixes WHERE x IS NOT NULL AND y IS NOT NULL),
b AS (SELECT observation, track, MIN(frame) AS frame FROM q GROUP BY 1, 2),
walk AS (SELECT q.observation, q.track, CAST(0 AS BIGINT) AS step_idx, q.frame, q.x, q.y FROM q JOIN b USING (observation, track, frame)
  UNION ALL SELECT observation, track, step_idx, frame, x, y FROM (SELECT w.observation, w.track, w.step_idx + 1 AS step_idx, n.frame, n.x, n.y, ROW_NUMBER() OVER (PARTITION BY w.observation, w.track ORDER BY n.frame) AS k
    FROM walk w JOIN q n ON n.observation = w.observation AND n.track = w.track AND n.frame > w.frame AND n.ok AND sqrt((n.x - w.x) * (n.x - w.x) + (n.y - w.y) * (n.y - w.y)) >= 2.0) WHERE k = 1)
SELECT observation, track, step_idx, CAST(frame AS DOUBLE) AS frame, {r("x", "y")} FROM walk"""


@query("walk_chord", _chord("true"))
def _(spark, sf):
    return shown(tr.walk_chord(fx.fixes(spark, sf), 2.0))


@query("walk_chord_nodata", _chord(f"EXISTS (SELECT 1 FROM dsm c WHERE {o.at('c', 'fixes.x', 'fixes.y')} AND c.value IS NOT NULL)", "," + o.DSM))
def _(spark, sf):
    return shown(tr.walk_chord(ra.sample(fx.fixes(spark, sf), fx.dsm(spark), "v"), 2.0, allowed=F.col("v").isNotNull()))


@query("walk_raster_filter", f"WITH {o.steps()}, {o.DSM} SELECT {S}, {r('s.frame', 's.x', 's.y')} FROM steps s JOIN dsm c ON {o.at('c', 's.x', 's.y')} WHERE c.value IS NOT NULL")
def _(spark, sf):
    return shown(ra.where_data(steps(spark, sf), fx.dsm(spark)))


@query("min_steps_filter", f"WITH {o.steps(ALL)}, c AS (SELECT *, COUNT(*) OVER (PARTITION BY {K}) AS n FROM steps) SELECT {S}, {r('x', 'y')} FROM c WHERE n >= 10")
def _(spark, sf):
    return shown(tr.at_least(steps(spark, sf, ALL), 10), *STEP, "step_idx", "x", "y")


# angles and simulation


@query("headings", f"WITH {o.moves()} SELECT {S}, {r('heading')} FROM moves WHERE heading IS NOT NULL")
def _(spark, sf):
    return shown(tr.moves(steps(spark, sf)).where("heading is not null"), *STEP, "step_idx", "heading")


@query("step_lengths", f"WITH {o.moves()} SELECT {S}, {r('length_m')} FROM moves WHERE px IS NOT NULL")
def _(spark, sf):
    return shown(tr.moves(steps(spark, sf)).where("px is not null"), *STEP, "step_idx", "length_m")


@query("wrap_angle", f"SELECT event_id, round({o.wrap('(value / 7)')}, 6) + 0.0 AS wrapped FROM events")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", rounded(g.wrap(F.col("value") / 7)).alias("wrapped"))


for _pool, _part in (("track", "PARTITION BY observation, track"), ("observation", "PARTITION BY observation"), ("global", "")):
    _key = ", ".join(si.POOLS[_pool])

    @query(f"turning_pool_{_pool}", f"WITH {o.turns(ALL)} SELECT {_key + ', ' if _key else ''}ROW_NUMBER() OVER ({_part} ORDER BY {S}) - 1 AS pool_idx, {r('delta')}, COUNT(*) OVER ({_part}) AS pool_n FROM turns")
    def _(spark, sf, pool=_pool):
        return shown(si.turning_pool(steps(spark, sf, ALL), pool))


@query("turning_pool_named", f"WITH {o.turns(ALL)} SELECT ROW_NUMBER() OVER (ORDER BY {S}) - 1 AS pool_idx, {r('delta')}, COUNT(*) OVER () AS pool_n FROM turns WHERE offset_m IN (0, 2) AND observation <> 1")
def _(spark, sf):
    made = steps(spark, sf, ALL)
    return shown(si.turning_pool(made, "global", [0, 2], [r["observation"] for r in fx.observers(spark, sf).where("observation <> 1").select("observation").collect()]))


@query("walk_lengths", f"WITH {o.steps()}, other AS (WITH {o.steps((0.0, 1.0), 2.5)} SELECT * FROM steps), al AS (SELECT 5.0 AS step_length, * FROM steps UNION ALL SELECT 2.5, * FROM other), mv AS (SELECT *, LAG(x) OVER w AS px FROM al WINDOW w AS (PARTITION BY observation, track, step_length, offset_m ORDER BY step_idx)) SELECT observation, track, CAST(step_length AS DOUBLE) AS step_length, offset_m, step_idx, {r('x', 'y', 'px')} FROM mv")
def _(spark, sf):
    return shown(tr.moves(tr.walk_lengths(fx.fixes(spark, sf), {5.0: [0.0], 2.5: [0.0, 1.0]})), *TRACK, "step_length", "offset_m", "step_idx", "x", "y", "px")


_SIM = f"{K}, target_step_index, replicate, {r('x', 'y', 'length_m')}"
_SIM_COLUMNS = [*STEP, "target_step_index", "replicate", "x", "y", "length_m"]

for _angles in ("uniform", "track", "observation", "global"):

    @query("simulate_uniform" if _angles == "uniform" else f"simulate_observed_{_angles}", f"WITH {o.simulated(SIMS, _angles)} SELECT {_SIM} FROM sims")
    def _(spark, sf, angles=_angles):
        return shown(si.simulate(steps(spark, sf), SIMS, angles), *_SIM_COLUMNS)


@query("simulate_reject_raster", f"WITH {o.simulated(SIMS, 'uniform', True)} SELECT {_SIM} FROM sims")
def _(spark, sf):
    return shown(si.simulate(steps(spark, sf), SIMS, layer=fx.dsm(spark)), *_SIM_COLUMNS)


_TURN = f"CASE WHEN ax * by_ - ay * bx > 0 THEN 1 ELSE -1 END * coalesce({o.angle_between('ax', 'ay', 'bx', 'by_')}, 0)"
_TURNED = f"tv0 AS (SELECT *, LAG(dx) OVER w AS ax, LAG(dy) OVER w AS ay, dx AS bx, dy AS by_ FROM moves WINDOW w AS (PARTITION BY {K} ORDER BY step_idx)), tv AS (SELECT *, {_TURN} AS turn FROM tv0 WHERE ax IS NOT NULL)"


@query("turning_angle_v1", f"WITH {o.moves()}, {_TURNED} SELECT {S}, {r('turn')} FROM tv")
def _(spark, sf):
    w = Window.partitionBy(*STEP).orderBy("step_idx")
    made = tr.moves(steps(spark, sf)).withColumns({"ax": F.lag("dx").over(w), "ay": F.lag("dy").over(w)}).where("ax is not null")
    return shown(made.withColumn("turn", g.turning_degrees(F.col("ax"), F.col("ay"), F.col("dx"), F.col("dy"))), *STEP, "step_idx", "turn")


@query("simulate_v1", f"""WITH {o.simulated(1)}, {_TURNED}, jp AS (SELECT {K}, length_m, turn, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY step_idx) - 1 AS i, COUNT(*) OVER (PARTITION BY {K}) AS n FROM tv),
    jn AS (SELECT DISTINCT {K}, n FROM jp), jt AS (SELECT st.*, jn.n, unnest(range(0, 3)) AS replicate FROM st JOIN jn USING ({K}) WHERE length_m IS NOT NULL),
    ju AS (SELECT *, CAST(floor({o.uniform("joint", "observation", "track", "CAST(offset_m AS BIGINT)", "target_step_index", "replicate")} * n) AS BIGINT) AS i FROM jt)
    SELECT {K}, target_step_index, replicate, round(p.length_m, 6) + 0.0 AS length_m, round(p.turn, 6) + 0.0 AS turn,
        round(u.x + p.length_m * sin(pi() / 2 - base + radians(p.turn)), 6) + 0.0 AS x, round(u.y + p.length_m * cos(pi() / 2 - base + radians(p.turn)), 6) + 0.0 AS y FROM ju u JOIN jp p USING ({K}, i)""")
def _(spark, sf):
    return shown(si.simulate_jointly(steps(spark, sf), 3).drop("frame"))


@query("simulate_v1_halfplane", f"""WITH {o.simulated(1)}, {_TURNED}, {o.DSM}, jp AS (SELECT {K}, length_m, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY step_idx) - 1 AS i, COUNT(*) OVER (PARTITION BY {K}) AS n FROM tv),
    jn AS (SELECT DISTINCT {K}, n FROM jp), jt AS (SELECT st.*, jn.n, unnest(range(0, 150)) AS trial FROM st JOIN jn USING ({K}) WHERE length_m IS NOT NULL),
    ju AS (SELECT *, CAST(floor({o.uniform("joint", "observation", "track", "CAST(offset_m AS BIGINT)", "target_step_index", "trial")} * n) AS BIGINT) AS i, floor({o.uniform("joint-angle", "observation", "track", "CAST(offset_m AS BIGINT)", "target_step_index", "trial")} * 180) AS turn FROM jt),
    je AS (SELECT {K}, target_step_index, trial, p.length_m AS length_m, turn, u.x + p.length_m * sin(pi() / 2 - base + radians(turn)) AS x, u.y + p.length_m * cos(pi() / 2 - base + radians(turn)) AS y FROM ju u JOIN jp p USING ({K}, i)),
    jr AS (SELECT je.*, ROW_NUMBER() OVER (PARTITION BY {K}, target_step_index ORDER BY trial) - 1 AS replicate FROM je JOIN dsm c ON {o.at('c', 'je.x', 'je.y')} AND c.value IS NOT NULL)
    SELECT {K}, target_step_index, replicate, {r('length_m', 'turn', 'x', 'y')} FROM jr WHERE replicate < 3""")
def _(spark, sf):
    return shown(si.simulate_jointly(steps(spark, sf), 3, angles="halfplane", layer=fx.dsm(spark)).drop("frame"))


# features of steps

_OF = "step_length_m, step_duration_s, step_speed_mps, dist_to_observer, delta_observer_dist, angle_to_observer, heading_deg".split(", ")


def _observed(spark, sf, offsets=(0.0,)):
    return ft.observed_features(steps(spark, sf, offsets), fx.observers(spark, sf))


@query("observer_features_obs", f"WITH {o.feat()} SELECT {S}, {r(*_OF)} FROM feat")
def _(spark, sf):
    return shown(_observed(spark, sf), *STEP, "step_idx", *ft.OBSERVER)


@query("observer_features_sim", f"WITH {o.simfeat(SIMS)} SELECT {K}, target_step_index, replicate, {r(*_OF)} FROM simfeat")
def _(spark, sf):
    s = steps(spark, sf)
    return shown(ft.simulated_features(si.simulate(s, SIMS), s, fx.observers(spark, sf)), *STEP, "target_step_index", "replicate", *ft.OBSERVER)


@query("avg_speed_by_track", f"WITH {o.feat(ALL)} SELECT observation, track, COUNT(*) AS n_steps, round(AVG(step_speed_mps), 6) + 0.0 AS avg_speed FROM feat WHERE step_speed_mps IS NOT NULL GROUP BY 1, 2")
def avg_speed(spark, sf):
    moved = _observed(spark, sf, ALL).where("step_speed_mps is not null")
    return moved.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n_steps"), rounded(F.avg("step_speed_mps")).alias("avg_speed"))


@query("angle_v1", f"WITH {o.moves()}, {o.OBSERVERS} SELECT {S}, round({o.angle_between('dx', 'dy', '(easting - px)', '(northing - py)')}, 6) + 0.0 AS angle FROM moves JOIN obs USING (observation) WHERE px IS NOT NULL")
def _(spark, sf):
    made = tr.moves(steps(spark, sf)).where("px is not null").join(fx.observers(spark, sf), "observation")
    return shown(made.withColumn("angle", g.folded_angle(F.col("dx"), F.col("dy"), F.col("easting") - F.col("px"), F.col("northing") - F.col("py"))), *STEP, "step_idx", "angle")


_ID = "observation || '_' || track || '_f' || CAST(round_even(frame, 0) AS BIGINT) || '_ob'"


def _step_id():
    return F.concat(F.col("observation").cast("string"), F.lit("_"), F.col("track").cast("string"), F.lit("_f"), F.rint("frame").cast("long").cast("string"), F.lit("_ob"))


@query("prev_step_v1", f"WITH {o.steps()} SELECT {S}, {_ID} AS id, LAG({_ID}) OVER (PARTITION BY {K} ORDER BY step_idx) AS prev_step FROM steps")
def _(spark, sf):
    w = Window.partitionBy(*STEP).orderBy("step_idx")
    return steps(spark, sf).withColumn("id", _step_id()).select(*STEP, "step_idx", "id", F.lag("id").over(w).alias("prev_step"))


@query("step_ids_v1", f"WITH {o.simulated(SIMS)} SELECT {K}, target_step_index, replicate, observation || '_' || track || '_f' || CAST(round_even(frame, 0) AS BIGINT) || '_sim-' || replicate AS id, observation || '_' || track || '_f' || CAST(round_even(frame, 0) AS BIGINT) || '_ob' AS target_id FROM sims")
def _(spark, sf):
    made = si.simulate(steps(spark, sf), SIMS)
    base = F.concat(F.col("observation").cast("string"), F.lit("_"), F.col("track").cast("string"), F.lit("_f"), F.rint("frame").cast("long").cast("string"))
    return made.select(*STEP, "target_step_index", "replicate", F.concat(base, F.lit("_sim-"), F.col("replicate").cast("string")).alias("id"), F.concat(base, F.lit("_ob")).alias("target_id"))


_A, _E = "6378137.0", "0.00669438"
_UTM = f"""u0 AS (SELECT c_custkey, c_acctbal / 1000 AS lat, 36 + c_custkey / 1e5 AS lon FROM customer),
u1 AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS BIGINT) AS zone, radians(lat) AS f, {_E} AS e, {_E} / (1 - {_E}) AS q FROM u0),
u2 AS (SELECT *, pow(tan(f), 2) AS t, q * pow(cos(f), 2) AS c, cos(f) * radians(lon - (zone * 6 - 183)) AS a, {_A} / sqrt(1 - e * pow(sin(f), 2)) AS n,
    {_A} * ((1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) * f - (3 * e / 8 + 3 * e * e / 32 + 45 * e * e * e / 1024) * sin(2 * f) + (15 * e * e / 256 + 45 * e * e * e / 1024) * sin(4 * f) - 35 * e * e * e / 3072 * sin(6 * f)) AS m FROM u1),
utm AS (SELECT c_custkey, zone, 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * q) * pow(a, 5) / 120) + 500000 AS easting,
    0.9996 * (m + n * tan(f) * (pow(a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * q) * pow(a, 6) / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS northing FROM u2)"""


def _places(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("observer_lat"), (36 + F.col("c_custkey") / 1e5).alias("observer_lon"))


@query("utm_forward", f"WITH {_UTM} SELECT c_custkey, zone, round(easting, 3) + 0.0 AS easting, round(northing, 3) + 0.0 AS northing FROM utm")
def _(spark, sf):
    east, north = g.utm(F.col("observer_lat"), F.col("observer_lon"))
    return _places(spark, sf).select("c_custkey", g.utm_zone(F.col("observer_lon")).alias("zone"), rounded(east, 3).alias("easting"), rounded(north, 3).alias("northing"))


@query("observer_xy", f"WITH {_UTM} SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) ELSE round(easting, 3) + 0.0 END AS easting, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE round(northing, 3) + 0.0 END AS northing FROM utm")
def _(spark, sf):
    own = F.col("c_custkey") % 2 == 0
    rows = _places(spark, sf).withColumns({"observer_easting": F.when(own, F.col("c_custkey").cast("double")), "observer_northing": F.when(own, F.lit(1.0))})
    return ca.observer_position(rows).select("c_custkey", rounded("easting", 3).alias("easting"), rounded("northing", 3).alias("northing"))


@query("bearing", """WITH q AS (SELECT c_custkey, radians(c_acctbal / 1000) AS a, radians(c_acctbal / 2000) AS b, radians(c_custkey / 100.0) AS d FROM customer)
    SELECT c_custkey, round(degrees(atan2(sin(d) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d))), 6) + 0.0 AS bearing FROM q""")
def _(spark, sf):
    lat = F.col("observer_lat")
    return _places(spark, sf).select("c_custkey", rounded(g.initial_bearing(lat, F.lit(0.0), lat / 2, F.col("c_custkey") / 100.0)).alias("bearing"))


# rasters


def _sampled(value: str, name: str) -> str:
    return f"WITH {o.steps()}, {o.DSM} SELECT {S}, round({value}, 6) + 0.0 AS {name} FROM steps s LEFT JOIN dsm c ON {o.at('c', 's.x', 's.y')}"


@query("raster_sample", _sampled("c.value", "value"))
def _(spark, sf):
    return shown(ra.sample(steps(spark, sf), fx.dsm(spark), "value"), *STEP, "step_idx", "value")


@query("head_height", _sampled("1.5 - c.value / 10", "observer_height"))
def _(spark, sf):
    return shown(ra.sample(steps(spark, sf), fx.layer(spark, "heights"), "observer_height"), *STEP, "step_idx", "observer_height")


_SLOPE = "round(a.value / 2, 6) + 0.0 AS start_alt_m, round(b.value / 2, 6) + 0.0 AS end_alt_m, round((b.value - a.value) / 2, 6) + 0.0 AS alt_change_m, round(degrees(atan((b.value - a.value) / 2 / nullif(length_m, 0))), 6) + 0.0 AS ground_slope_deg, round(100 * (b.value - a.value) / 2 / nullif(length_m, 0), 6) + 0.0 AS ground_slope_pct"
_SLOPES = ["start_alt_m", "end_alt_m", "alt_change_m", "ground_slope_deg", "ground_slope_pct"]
_ENDS = f"LEFT JOIN dsm a ON {o.at('a', 'm.px', 'm.py')} LEFT JOIN dsm b ON {o.at('b', 'm.x', 'm.y')}"


@query("ground_slope_obs", f"WITH {o.moves()}, {o.DSM} SELECT {S}, {_SLOPE} FROM moves m {_ENDS}")
def _(spark, sf):
    return shown(ra.with_slope(tr.moves(steps(spark, sf)), fx.layer(spark, "dtm")), *STEP, "step_idx", *_SLOPES)


@query("ground_slope_sim", f"WITH {o.simulated(SIMS)}, {o.DSM} SELECT {K}, target_step_index, replicate, {_SLOPE} FROM sims m {_ENDS}")
def _(spark, sf):
    return shown(ra.with_slope(si.simulate(steps(spark, sf), SIMS), fx.layer(spark, "dtm")), *STEP, "target_step_index", "replicate", *_SLOPES)


_CLASS = 'coalesce((c."row" + c.col) % 5, -1)'
_CELL = f"FROM steps s LEFT JOIN dsm c ON {o.at('c', 's.x', 's.y')}"


@query("ground_class", f"WITH {o.steps(ALL)}, {o.DSM} SELECT {S}, {_CLASS} AS ground_class {_CELL}")
def _(spark, sf):
    return ra.with_ground_class(steps(spark, sf, ALL), fx.layer(spark, "ground")).select(*STEP, "step_idx", "ground_class")


@query("ground_class_named", f"WITH {o.steps()}, {o.DSM} SELECT {S}, {_CLASS} AS ground_class, CASE {_CLASS} WHEN 0 THEN 'unclassified' WHEN 1 THEN 'bare' WHEN 2 THEN 'grass' WHEN 3 THEN 'tree' WHEN 4 THEN 'road' END AS ground_class_name {_CELL}")
def _(spark, sf):
    return ra.with_ground_class(steps(spark, sf), fx.layer(spark, "ground"), ft.GROUND_NAMES).select(*STEP, "step_idx", "ground_class", "ground_class_name")


@query("road_flag", f'WITH {o.steps()}, {o.DSM} SELECT {S}, CASE WHEN c."row" % 25 = 0 THEN 1 WHEN c."row" IS NOT NULL THEN 0 END::BIGINT AS road {_CELL}')
def _(spark, sf):
    return ra.road_flag(steps(spark, sf), fx.layer(spark, "road")).select(*STEP, "step_idx", "road")


@query("raster_downsample_avg", f'WITH {o.DSM} SELECT CAST(floor("row" / 4) AS BIGINT) AS r, CAST(floor(col / 4) AS BIGINT) AS c, round(AVG(value), 6) + 0.0 AS value FROM dsm GROUP BY 1, 2')
def _(spark, sf):
    return shown(ra.downsampled(fx.dsm(spark), 4).withColumnsRenamed({"row": "r", "col": "c"}))


_MAPS = f"{o.steps()}, {o.DSM}, {o.OBSERVERS}, reg AS (SELECT CAST(r_regionkey AS BIGINT) AS m, r_name AS big_map FROM region), sm AS (SELECT s.*, big_map, m FROM steps s JOIN obs USING (observation) JOIN reg USING (big_map))"


def _mapped(spark, sf):
    return steps(spark, sf).join(fx.observers(spark, sf).select("observation", "big_map"), "observation")


@query("raster_sample_by_map", f'WITH {_MAPS} SELECT {S}, big_map, round(c.value + m, 6) + 0.0 AS value FROM sm LEFT JOIN dsm c ON c."row" = CAST(floor((y - (30 - m)) / -0.5) AS BIGINT) AND c.col = CAST(floor((x - (-20 + m)) / 0.5) AS BIGINT)')
def _(spark, sf):
    return shown(ra.sample(_mapped(spark, sf), fx.map_layer(spark, sf), "value"), *STEP, "step_idx", "big_map", "value")


def _resample(name: str, how: str) -> None:
    """Targets of 1 m over cells of 0.5 m, and of 0.25 m below them."""

    def sql(cell: float) -> str:
        k = cell / 0.5
        near = {"bilinear": f"abs(t + 0.5 - (p + 0.5) / {k}) / {max(1, 1 / k)}", "average": f"CASE WHEN floor((p + 0.5) / {k}) = t THEN 0 ELSE 1 END", "nearest": f"CASE WHEN floor((t + 0.5) * {k}) = p THEN 0 ELSE 1 END"}[how]
        axis = lambda n: f"(SELECT t, p, 1.0 - {near} AS w FROM (SELECT unnest(range(0, {int(n / k)})) AS t), (SELECT unnest(range(0, {n})) AS p) WHERE {near} < 1)"
        return f'SELECT CAST({cell} AS DOUBLE) AS cell, a.t AS r, b.t AS c, round(SUM(a.w * b.w * value) / SUM(a.w * b.w), 6) + 0.0 AS value FROM dsm JOIN {axis(100)} a ON a.p = dsm."row" JOIN {axis(130)} b ON b.p = dsm.col WHERE value IS NOT NULL GROUP BY 2, 3'

    @query(name, f"WITH {o.DSM} {sql(1.0)} UNION ALL {sql(0.25)}" if how != "average" else f"WITH {o.DSM} {sql(1.0)}")
    def _(spark, sf):
        made = [ra.resampled(fx.dsm(spark), cell, how).cells.select(F.lit(cell).alias("cell"), F.col("row").alias("r"), F.col("col").alias("c"), "value") for cell in ((1.0,) if how == "average" else (1.0, 0.25))]
        return shown(made[0] if len(made) == 1 else made[0].unionByName(made[1]))


_resample("dsm_bilinear", "bilinear")
_resample("dsm_average", "average")
_resample("dsm_nearest", "nearest")


# other animals


@query("social_density", f"WITH {o.steps(ALL)}, {o.NEIGHBOURS} SELECT {S}, COUNT(m.neighbor_track) FILTER (WHERE distance_m < 10) AS social_density FROM steps LEFT JOIN met m USING ({S}) GROUP BY ALL")
def _(spark, sf):
    return so.density(steps(spark, sf, ALL), fx.fixes(spark, sf)).select(*STEP, "step_idx", "social_density")


_NN = f"nn AS (SELECT {S}, neighbor_track, distance_m FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY distance_m, neighbor_track) AS k FROM met) WHERE k = 1)"


@query("nearest_neighbor", f"""WITH {o.steps()}, {o.NEIGHBOURS}, {_NN}, {o.TRACKS} SELECT s.observation, s.track, s.offset_m, s.step_idx, coalesce(n.neighbor_track, -1) AS nn_track, round(n.distance_m, 6) + 0.0 AS nn_distance_m,
    individual_ID AS nn_individual_ID, species AS nn_species, age AS nn_age FROM steps s LEFT JOIN nn n USING ({S}) LEFT JOIN meta t ON t.observation = s.observation AND t.track = n.neighbor_track""")
def _(spark, sf):
    found = so.nearest(steps(spark, sf), fx.fixes(spark, sf), fx.track_metadata(spark, sf))
    return shown(found, *STEP, "step_idx", "nn_track", "nn_distance_m", "nn_individual_ID", "nn_species", "nn_age")


@query("neighbor_table", f"WITH {o.steps()}, {o.NEIGHBOURS} SELECT {S}, neighbor_track, {r('distance_m', 'nx', 'ny')} FROM met")
def _(spark, sf):
    packed = so.neighbour_table(steps(spark, sf), fx.fixes(spark, sf))
    flat = packed.select(*STEP, "step_idx", F.explode("neighbors").alias("n")).select(*STEP, "step_idx", F.col("n.track").alias("neighbor_track"), "n.distance_m", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"))
    return shown(flat)


_EVERY = f"ev AS (SELECT s.*, t.track AS neighbor_track FROM steps s JOIN (SELECT DISTINCT observation, track FROM fixes) t ON t.observation = s.observation AND t.track <> s.track), al AS (SELECT e.*, m.distance_m FROM ev e LEFT JOIN met m USING ({S}, neighbor_track))"


@query("social_v1_outer", f"WITH {o.steps()}, {o.NEIGHBOURS}, {_EVERY} SELECT {S}, neighbor_track, {r('distance_m')} FROM al")
def _(spark, sf):
    return shown(so.with_missing(steps(spark, sf), fx.fixes(spark, sf)))


@query("nn_from_list", f"WITH {o.steps()}, {o.NEIGHBOURS}, {_EVERY} SELECT {S}, COUNT(*) AS n_listed, round(MIN(distance_m), 6) + 0.0 AS nn_distance FROM al GROUP BY ALL")
def _(spark, sf):
    listed = so.with_missing(steps(spark, sf), fx.fixes(spark, sf)).groupBy(*STEP, "step_idx").agg(F.collect_list(F.struct("neighbor_track", "distance_m")).alias("l"))
    least = F.array_min(F.filter(F.transform("l", lambda x: x["distance_m"]), lambda d: d.isNotNull()))
    return listed.select(*STEP, "step_idx", F.size("l").cast("long").alias("n_listed"), rounded(least).alias("nn_distance"))


def _sight(rows: str, key: str, bx: str = "nx", by: str = "ny", cell: tuple[str, str] | None = None) -> str:
    """CTE `seen`(key, visible) for rows with x, y, za, zb."""
    r1, c1 = cell or (f"CAST(floor(({by} - 30) / -0.5) AS BIGINT)", f"CAST(floor(({bx} + 20) / 0.5) AS BIGINT)")
    return f"""l0 AS (SELECT {key}, CAST(floor((y - 30) / -0.5) AS BIGINT) AS r0, CAST(floor((x + 20) / 0.5) AS BIGINT) AS c0, {r1} AS r1, {c1} AS c1, za, zb FROM {rows}),
l1 AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n FROM l0), l2 AS (SELECT *, unnest(range(1, n)) AS k FROM l1 WHERE n > 1),
l3 AS (SELECT *, r0 + CAST(floor((2 * k * (r1 - r0) + n) / (2.0 * n)) AS BIGINT) AS rr, c0 + CAST(floor((2 * k * (c1 - c0) + n) / (2.0 * n)) AS BIGINT) AS cc, za + (zb - za) * k / n AS z FROM l2),
hid AS (SELECT DISTINCT {key} FROM l3 JOIN dsm d ON d."row" = rr AND d.col = cc WHERE z <= d.value),
seen AS (SELECT {", ".join("l1." + k.strip() for k in key.split(","))}, h.observation IS NULL AND za IS NOT NULL AND zb IS NOT NULL AS visible FROM l1 LEFT JOIN hid h USING ({key}))"""


_HEIGHTS = f"""mz AS (SELECT m.*, a.value + (1.5 - a.value / 10) AS za, b.value + (1.5 - b.value / 10) AS zb FROM mt m LEFT JOIN dsm a ON {o.at('a', 'm.x', 'm.y')} LEFT JOIN dsm b ON {o.at('b', 'm.nx', 'm.ny')})"""
_NK = f"{S}, neighbor_track"
_ON_GRID = f"ong AS (SELECT {S} FROM steps WHERE floor((y - 30) / -0.5) BETWEEN 0 AND 99 AND floor((x + 20) / 0.5) BETWEEN 0 AND 129)"


@query("los_pairs", f"WITH {o.steps()}, {o.NEIGHBOURS}, {o.DSM}, mt AS (SELECT * FROM met), {_HEIGHTS}, {_sight('mz', _NK)} SELECT {_NK}, {r('distance_m')}, visible FROM met JOIN seen USING ({_NK})")
def _(spark, sf):
    return shown(so.visible_neighbours(steps(spark, sf), fx.fixes(spark, sf), fx.dsm(spark), fx.layer(spark, "heights")))


@query("los_capped", f"""WITH {o.steps()}, {o.NEIGHBOURS}, {o.DSM}, mt AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY distance_m, neighbor_track) AS place FROM met WHERE distance_m <= 12) WHERE place <= 3),
    {_HEIGHTS}, {_sight('mz', _NK)} SELECT {_NK}, {r('distance_m')}, coalesce(visible, false) AS visible FROM met LEFT JOIN seen USING ({_NK})""")
def _(spark, sf):
    return shown(so.visible_neighbours(steps(spark, sf), fx.fixes(spark, sf), fx.dsm(spark), fx.layer(spark, "heights"), 12.0, 3))


_VISIBLE = f"""vis AS (SELECT {S}, COUNT(*) FILTER (WHERE visible) AS n_visible, arg_min(visible, struct_pack(d := distance_m, t := neighbor_track)) AS nn_visible FROM met JOIN seen USING ({_NK}) GROUP BY {S})"""


@query("social_visible", f"WITH {o.steps()}, {o.NEIGHBOURS}, {o.DSM}, mt AS (SELECT * FROM met), {_HEIGHTS}, {_sight('mz', _NK)}, {_VISIBLE}, {_ON_GRID} SELECT {S}, coalesce(n_visible, 0) AS social_visible_count, nn_visible FROM steps LEFT JOIN (SELECT * FROM vis SEMI JOIN ong USING ({S})) USING ({S})")
def _(spark, sf):
    found = so.annotated(steps(spark, sf), fx.fixes(spark, sf), fx.track_metadata(spark, sf), fx.dsm(spark), fx.layer(spark, "heights"))
    return found.select(*STEP, "step_idx", "social_visible_count", "nn_visible")


@query("social_features", f"""WITH {o.steps()}, {o.NEIGHBOURS}, {o.DSM}, {o.TRACKS}, mt AS (SELECT * FROM met WHERE distance_m <= 12), {_HEIGHTS}, {_sight('mz', _NK)}, {_ON_GRID},
    al AS (SELECT met.*, coalesce(visible, false) AS visible FROM met LEFT JOIN seen USING ({_NK}) SEMI JOIN ong USING ({S})),
    ag AS (SELECT {S}, COUNT(*) FILTER (WHERE distance_m < 10) AS density, COUNT(*) FILTER (WHERE visible) AS n_visible, arg_min(struct_pack(d := distance_m, t := neighbor_track, v := visible), struct_pack(d := distance_m, t := neighbor_track)) AS nn FROM al GROUP BY {S})
    SELECT s.observation, s.track, s.offset_m, s.step_idx, coalesce(density, 0) AS social_density, coalesce(n_visible, 0) AS social_visible_count, round(nn.d, 6) + 0.0 AS nn_distance_m, coalesce(nn.t, -1) AS nn_track, nn.v AS nn_visible, m.species AS nn_species, m.age AS nn_age
    FROM steps s LEFT JOIN ag USING ({S}) LEFT JOIN meta m ON m.observation = s.observation AND m.track = nn.t""")
def _(spark, sf):
    found = so.annotated(steps(spark, sf), fx.fixes(spark, sf), fx.track_metadata(spark, sf), fx.dsm(spark), fx.layer(spark, "heights"), within=12.0)
    return shown(found, *STEP, "step_idx", "social_density", "social_visible_count", "nn_distance_m", "nn_track", "nn_visible", "nn_species", "nn_age")


# viewsheds

_VK = f"{S}, drow, dcol"
_VIEW = f"""vp AS (SELECT s.*, c.value + (1.5 - c.value / 10) AS za, CAST(floor((s.y - 30) / -0.5) AS BIGINT) AS r, CAST(floor((s.x + 20) / 0.5) AS BIGINT) AS c FROM steps s LEFT JOIN dsm c ON {o.at('c', 's.x', 's.y')}),
va AS (SELECT *, r + drow AS vr, c + dcol AS vc FROM vp, (SELECT unnest(range(-5, 6)) AS drow), (SELECT unnest(range(-5, 6)) AS dcol)),
vn AS (SELECT va.*, d.value AS zb FROM va JOIN dsm d ON d."row" = vr AND d.col = vc WHERE d.value IS NOT NULL
    AND pow(-20 + (vc + 0.5) * 0.5 - x, 2) + pow(30 + (vr + 0.5) * -0.5 - y, 2) <= 4.0)"""


def _view(spark, sf):
    return vs.viewshed(steps(spark, sf), fx.dsm(spark), fx.layer(spark, "heights"), 2.0)


@query("viewshed_cells", f"WITH {o.steps()}, {o.DSM}, {_VIEW}, {_sight('vn', _VK, cell=('vr', 'vc'))} SELECT {_VK}, visible FROM seen")
def _(spark, sf):
    return _view(spark, sf)


@query("viewshed_mean", f"WITH {o.steps()}, {o.DSM}, {_VIEW}, {_sight('vn', _VK, cell=('vr', 'vc'))} SELECT {S}, round(AVG(CASE WHEN visible THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS viewshed_vis FROM seen GROUP BY {S}")
def _(spark, sf):
    return shown(vs.viewshed_share(steps(spark, sf), fx.dsm(spark), fx.layer(spark, "heights"), 2.0))


@query("viewshed_by_map", f"""WITH {_MAPS}, vp AS (SELECT s.*, c.value + m + (1.5 - c.value / 10) + m AS za, CAST(floor((s.y - (30 - m)) / -0.5) AS BIGINT) AS r, CAST(floor((s.x - (-20 + m)) / 0.5) AS BIGINT) AS c FROM sm s LEFT JOIN dsm c ON c."row" = CAST(floor((s.y - (30 - m)) / -0.5) AS BIGINT) AND c.col = CAST(floor((s.x - (-20 + m)) / 0.5) AS BIGINT)),
    vn AS (SELECT vp.*, r + drow AS vr, c + dcol AS vc, drow, dcol, d.value + m AS zb FROM vp, (SELECT unnest(range(-5, 6)) AS drow), (SELECT unnest(range(-5, 6)) AS dcol), dsm d WHERE d."row" = r + drow AND d.col = c + dcol AND d.value IS NOT NULL
        AND pow(-20 + m + (c + dcol + 0.5) * 0.5 - x, 2) + pow(30 - m + (r + drow + 0.5) * -0.5 - y, 2) <= 4.0),
    ln AS (SELECT *, greatest(abs(drow), abs(dcol)) AS n FROM vn), lk AS (SELECT *, unnest(range(1, n)) AS k FROM ln WHERE n > 1),
    hid AS (SELECT DISTINCT {S}, drow, dcol FROM lk JOIN dsm d ON d."row" = lk.r + CAST(floor((2 * k * drow + n) / (2.0 * n)) AS BIGINT) AND d.col = lk.c + CAST(floor((2 * k * dcol + n) / (2.0 * n)) AS BIGINT) WHERE za + (zb - za) * k / n <= d.value + m)
    SELECT {S}, round(AVG(CASE WHEN h.observation IS NULL AND za IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS viewshed_vis FROM ln LEFT JOIN hid h USING ({S}, drow, dcol) GROUP BY {S}""")
def _(spark, sf):
    return shown(vs.viewshed_share(_mapped(spark, sf), fx.map_layer(spark, sf), fx.map_layer(spark, sf, "heights"), 2.0), *STEP, "step_idx", "viewshed_vis")


@query("viewshed_grid", f"WITH {o.steps()}, {o.DSM}, {_VIEW}, {_sight('vn', _VK, cell=('vr', 'vc'))} SELECT {S}, CAST(floor(drow / 3.0) AS BIGINT) AS bin_row, CAST(floor(dcol / 3.0) AS BIGINT) AS bin_col, round(AVG(CASE WHEN visible THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS mean FROM seen GROUP BY ALL")
def _(spark, sf):
    return shown(ra.binned(_view(spark, sf).withColumn("visible", F.col("visible").cast("double")), 3))


_PLACES = f"""pl AS (SELECT CAST(0 AS BIGINT) AS observation, CAST(0 AS BIGINT) AS track, 0.0 AS offset_m, ROW_NUMBER() OVER (ORDER BY x, y) AS step_idx, x, y FROM (SELECT x, y FROM steps UNION SELECT x, y FROM sims)),
{_VIEW.replace("FROM steps s", "FROM pl s")}"""


@query("viewshed_driver", f"""WITH {o.simulated(SIMS, 'uniform', True)}, {_PLACES}, {_sight('vn', _VK, cell=('vr', 'vc'))}, sh AS (SELECT x, y, AVG(CASE WHEN visible THEN 1.0 ELSE 0.0 END) AS vis FROM seen JOIN pl USING (step_idx) GROUP BY 1, 2)
    SELECT {K}, step_idx, CAST(-1 AS BIGINT) AS replicate, round(vis, 6) + 0.0 AS viewshed_vis FROM steps LEFT JOIN sh USING (x, y) UNION ALL SELECT {K}, target_step_index, replicate, round(vis, 6) + 0.0 FROM sims LEFT JOIN sh USING (x, y)""")
def _(spark, sf):
    s, folder = steps(spark, sf), store.new_folder(spark, "viewsheds")
    sims = si.simulate(s, SIMS, layer=fx.dsm(spark)).withColumnRenamed("target_step_index", "step_idx")
    kept = lambda points: vs.annotate(spark, points, folder, fx.dsm(spark), fx.layer(spark, "heights"), 2.0)
    observed = kept(s.select(*STEP, "step_idx", F.lit(-1).cast("long").alias("replicate"), "x", "y"))
    # the second run finds what the first has made
    both = kept(observed.drop("viewshed_vis").unionByName(sims.select(*STEP, "step_idx", "replicate", "x", "y")))
    return shown(both, *STEP, "step_idx", "replicate", "viewshed_vis")


_VNAME = "'observation' || observation || '_track' || track || '_frame' || lpad(CAST(CAST(round_even(frame, 0) AS BIGINT) AS VARCHAR), 6, '0') || '_viewshed30m.tif'"
_PLAN = f"vo AS (SELECT observation, track, offset_m, step_idx, CASE WHEN step_idx = 3 THEN NULL ELSE x END AS x, false AS is_simulated, {_VNAME} AS name FROM steps), vm AS (SELECT DISTINCT {_VNAME} AS name FROM steps WHERE track % 2 = 0), vq AS (SELECT vo.*, vm.name IS NOT NULL AS exists_, CASE WHEN x IS NULL THEN 'ignore' WHEN vm.name IS NOT NULL THEN 'reuse' ELSE 'create' END AS action FROM vo LEFT JOIN vm USING (name))"


def _planned(spark, sf, limit=None):
    points = steps(spark, sf).withColumn("name", vs.viewshed_name(30)).withColumn("is_simulated", F.lit(False))
    return vs.plan(points.withColumn("x", F.when(F.col("step_idx") != 3, F.col("x"))), points.where("track % 2 = 0"), limit)


@query("viewshed_preview", f"WITH {o.steps()}, {_PLAN} SELECT {S}, name, exists_, action, CASE action WHEN 'ignore' THEN 'no position' WHEN 'reuse' THEN 'found' ELSE 'missing' END AS reason FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY observation, is_simulated ORDER BY track, offset_m, step_idx) AS k FROM vq) WHERE k <= 10")
def _(spark, sf):
    return _planned(spark, sf, 10).select(*STEP, "step_idx", "name", F.col("exists").alias("exists_"), "action", "reason")


@query("viewshed_preview_summary", f"WITH {o.steps()}, {_PLAN} SELECT is_simulated, action, COUNT(*) AS n FROM vq GROUP BY 1, 2 ORDER BY 1, 2")
def _(spark, sf):
    return _planned(spark, sf).groupBy("is_simulated", "action").agg(F.count(F.lit(1)).alias("n")).orderBy("is_simulated", "action")


@query("viewshed_reuse_anti", f"WITH {o.steps()}, {_PLAN} SELECT {S}, name FROM vo WHERE name NOT IN (SELECT name FROM vm)")
def _(spark, sf):
    points = steps(spark, sf).withColumn("name", vs.viewshed_name(30))
    return vs.still_to_make(points, points.where("track % 2 = 0")).select(*STEP, "step_idx", "name")


_PREVIEW = f"""pa AS (SELECT observation, track, offset_m, step_idx, CAST(round_even(frame, 0) AS BIGINT) AS frame, false AS is_simulated, CAST(NULL AS BIGINT) AS replicate FROM steps UNION ALL SELECT observation, track, offset_m, target_step_index, CAST(round_even(frame, 0) AS BIGINT), true, replicate FROM sims),
    pb AS (SELECT *, 'observation' || observation AS observation_id, CASE WHEN track % 3 = 0 THEN 'track_unknown' ELSE 'track' || lpad(track::VARCHAR, 3, '0') END AS track_tag FROM pa),
    pc AS (SELECT *, observation_id || '_' || track_tag || '_frame' || lpad(frame::VARCHAR, 6, '0') || CASE WHEN is_simulated THEN '_rep' || replicate ELSE '' END || '_viewshed30m.tif' AS file FROM pb),
    pd AS (SELECT *, '/v/' || observation_id || CASE WHEN is_simulated THEN '/steps_5m/' || track_tag || '/simulated/offset_0m/' ELSE '/' || track_tag || '/observed/' END || file AS tif_path, frame % 2 = 0 AS exists_ FROM pc),
    pe AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY observation_id, is_simulated, offset_m ORDER BY track, step_idx, replicate NULLS FIRST) AS k FROM pd)"""


@query("viewshed_preview_paths", f"WITH {o.simulated(SIMS)}, {_PREVIEW} SELECT observation_id, is_simulated, track AS track_index, step_idx, track_tag, frame, replicate, 30.0::DOUBLE AS radius_m, tif_path, exists_, CASE WHEN NOT exists_ THEN 'create' WHEN is_simulated THEN 'ignore' ELSE 'reuse' END AS action, CASE WHEN NOT exists_ THEN 'will create (missing)' WHEN is_simulated THEN 'exists but reuse=False' ELSE 'reusing existing file' END AS reason FROM pe WHERE k <= 50")
def _(spark, sf):
    s = steps(spark, sf)
    sims = si.simulate(s, SIMS).select(*STEP, F.col("target_step_index").alias("step_idx"), "frame", F.lit(True).alias("is_simulated"), "replicate")
    name = F.concat(F.lit("observation"), F.col("observation").cast("string"))
    label = F.when(F.col("track") % 3 == 0, F.concat(name, F.lit("_"))).when(F.col("track") % 3 == 1, F.concat(name, F.lit("_track"), F.lpad(F.col("track").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("track"), F.lpad(F.col("track").cast("string"), 3, "0")))
    points = s.select(*STEP, "step_idx", "frame", F.lit(False).alias("is_simulated"), F.lit(None).cast("long").alias("replicate")).unionByName(sims).withColumn("track_label", label)
    made = vs.preview(points, spark.createDataFrame([], "tif_path string"), "/v", 30.0, dataset="steps_5m", limit=None).where("frame % 2 = 0")
    shown_ = vs.preview(points, made, "/v", 30.0, dataset="steps_5m", limit=50)
    return shown_.select("observation_id", "is_simulated", "track_index", "step_idx", "track_tag", "frame", "replicate", "radius_m", "tif_path", F.col("exists").alias("exists_"), "action", "reason")


@query("length_tags", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size // 2 || 'm' ELSE p_size // 2 || 'p5m' END AS tag FROM part")
def _(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", vs.length_tag(F.col("p_size") / 2).alias("tag"))


# training examples


@query("track_info_join", f"WITH {o.steps()}, {o.TRACKS} SELECT {S}, individual_ID, species, age FROM steps JOIN meta USING (observation, track)")
def _(spark, sf):
    return ca.unique_join(steps(spark, sf), fx.track_metadata(spark, sf), TRACK).select(*STEP, "step_idx", "individual_ID", "species", "age")


_NUM = ["angle_to_observer", "dist_to_observer", "step_speed_mps", "delta_observer_dist"]
_T2 = {"angle_to_observer": "angle_to_observer / 180", "dist_to_observer": "ln(greatest(dist_to_observer, 1e-6))", "step_speed_mps": "ln(greatest(step_speed_mps, 1e-6))", "delta_observer_dist": "delta_observer_dist"}
_T2 = {k: f"CASE WHEN {k} IS NOT NULL THEN {v} END" for k, v in _T2.items()}
_T1 = {"angle_to_observer": "angle_to_observer / 180", "dist_to_observer": "ln(1 + dist_to_observer)", "step_speed_mps": "ln(1 + step_speed_mps)", "delta_observer_dist": "delta_observer_dist"}


def _stats(t: dict[str, str], source: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS feature, {v} AS v FROM {source}" for k, v in t.items())
    return f"stats AS (SELECT feature, COUNT(v) AS n, CASE WHEN COUNT(v) >= 2 THEN AVG(v) ELSE 0.0 END AS mean, CASE WHEN COUNT(v) >= 2 AND stddev_samp(v) > 0 THEN stddev_samp(v) ELSE 1.0 END AS std FROM ({each}) GROUP BY 1)"


@query("transform_v2", f"WITH {o.feat()} SELECT {S}, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in _T2.items()) + " FROM feat")
def _(spark, sf):
    return shown(_observed(spark, sf).select(*STEP, "step_idx", *[ft.transformed(f).alias(f) for f in _NUM]))


@query("transform_share", "SELECT l_orderkey, l_linenumber, round(ln(p / (1 - p)), 6) + 0.0 AS logit FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_discount * 10, 1e-6), 1 - 1e-6) AS p FROM lineitem)")
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("viewshed_vis"))
    return rows.select("l_orderkey", "l_linenumber", rounded(ft.transformed("viewshed_vis")).alias("logit"))


@query("transform_v1", f"WITH {o.feat()} SELECT {S}, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in _T1.items()) + " FROM feat")
def _(spark, sf):
    return shown(_observed(spark, sf).select(*STEP, "step_idx", *[ft.transformed_log1p(f).alias(f) for f in _NUM]))


@query("global_stats", f"WITH {o.feat(ALL)}, {_stats(_T2, 'feat')} SELECT feature, n, {r('mean', 'std')} FROM stats")
def _(spark, sf):
    return shown(ft.numeric_stats(_observed(spark, sf, ALL), _NUM))


def _both(spark, sf):
    s = steps(spark, sf)
    sims = ft.simulated_features(si.simulate(s, SIMS), s, fx.observers(spark, sf))
    return _observed(spark, sf).select(*_NUM).unionByName(sims.select(*_NUM))


@query("combined_stats_v1", f"WITH {o.simfeat(SIMS)}, of0 AS (SELECT m.*, easting, northing FROM moves m JOIN obs USING (observation)), feat AS (SELECT {S}, {o.features('of0')}), al AS (SELECT {', '.join(_NUM)} FROM feat UNION ALL SELECT {', '.join(_NUM)} FROM simfeat), {_stats(_T1, 'al')} SELECT feature, n, {r('mean', 'std')} FROM stats")
def _(spark, sf):
    return shown(ft.numeric_stats(_both(spark, sf), _NUM, ft.transformed_log1p))


def _z(k: str) -> str:
    return f"({_T2[k]} - (SELECT mean FROM stats WHERE feature = '{k}')) / (SELECT std FROM stats WHERE feature = '{k}')"


@query("zscore", f"WITH {o.feat()}, {_stats(_T2, 'feat')} SELECT {S}, " + ", ".join(f"round({_z(k)}, 6) + 0.0 AS {k}_z" for k in _NUM) + " FROM feat")
def _(spark, sf):
    rows = _observed(spark, sf)
    return shown(ft.normalised(rows, _NUM, ft.numeric_stats(rows, _NUM)), *STEP, "step_idx", *[f + "_z" for f in _NUM])


_VOC = "voc AS (SELECT feature, value, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY value) - 1 AS idx FROM (SELECT DISTINCT 'age' AS feature, coalesce(age, '') AS value FROM meta UNION SELECT DISTINCT 'species', coalesce(species, '') FROM meta))"


@query("vocabulary", f"WITH {o.FIXES}, {o.TRACKS}, {_VOC} SELECT * FROM voc")
def _(spark, sf):
    return ft.vocabulary(fx.track_metadata(spark, sf), ["age", "species"])


def _hot(f: str) -> str:
    return f"(SELECT string_agg(CASE WHEN value = coalesce({f}, '') THEN '1' ELSE '0' END, '' ORDER BY idx) FROM voc WHERE feature = '{f}')"


@query("onehot", f"WITH {o.FIXES}, {o.TRACKS}, {_VOC} SELECT observation, track, {_hot('age')} AS age, {_hot('species')} AS species FROM meta")
def _(spark, sf):
    meta = fx.track_metadata(spark, sf)
    known = ft.vocabulary(meta, ["age", "species"])
    digits = lambda f: F.array_join(F.transform(f + "_onehot", lambda v: v.cast("int").cast("string")), "")
    return ft.one_hot(ft.one_hot(meta, "age", known), "species", known).select(*TRACK, digits("age").alias("age"), digits("species").alias("species"))


@query("onehot_ground_v1", f"WITH {o.steps()}, {o.DSM} SELECT {S}, " + ", ".join(f"CASE WHEN {_CLASS} = {k} THEN 1 ELSE 0 END::BIGINT AS ground_{v}" for k, v in ft.GROUND_NAMES.items()) + f" {_CELL}")
def _(spark, sf):
    rows = ra.with_ground_class(steps(spark, sf), fx.layer(spark, "ground"))
    return ft.ground_one_hot(rows).select(*STEP, "step_idx", *["ground_" + v for v in ft.GROUND_NAMES.values()])


_VF = ["dist_to_observer", "step_speed_mps"]


@query("feature_vector", f"WITH {o.feat()}, {o.TRACKS}, {_VOC}, {_stats(_T2, 'feat')} SELECT {S}, round({_z(_VF[0])}, 6) + 0.0 AS v0, round({_z(_VF[1])}, 6) + 0.0 AS v1, {_hot('age')} AS hot FROM feat JOIN meta USING (observation, track)")
def _(spark, sf):
    rows = _observed(spark, sf)
    meta = fx.track_metadata(spark, sf)
    made = ft.normalised(rows, _VF, ft.numeric_stats(rows, _VF)).join(meta, TRACK)
    made = ft.one_hot(made, "age", ft.vocabulary(meta, ["age"])).withColumn("v", ft.feature_vector(_VF, ["age"]))
    hot = F.array_join(F.transform(F.slice("v", 3, F.size("v") - 2), lambda x: x.cast("int").cast("string")), "")
    return made.select(*STEP, "step_idx", rounded(F.get("v", 0)).alias("v0"), rounded(F.get("v", 1)).alias("v1"), hot.alias("hot"))


_INDEX = f"ix AS (SELECT s.observation, s.track, s.offset_m, s.step_idx, COUNT(*) AS n_sims FROM steps s JOIN sims m ON m.observation = s.observation AND m.track = s.track AND m.offset_m = s.offset_m AND m.target_step_index = s.step_idx WHERE s.step_idx >= 5 GROUP BY ALL)"


@query("sample_index", f"WITH {o.simulated(SIMS, 'uniform', True)}, {_INDEX} SELECT * FROM ix")
def _(spark, sf):
    s = steps(spark, sf)
    return ft.sample_index(s, si.simulate(s, SIMS, layer=fx.dsm(spark)), 5)


@query("context_window", f"""WITH {o.steps()} SELECT {S}, COUNT(x) OVER w AS n_context, round(FIRST_VALUE(x) OVER w, 6) + 0.0 AS oldest_x, round(LAST_VALUE(x) OVER w, 6) + 0.0 AS newest_x FROM steps
    WINDOW w AS (PARTITION BY {K} ORDER BY step_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    rows = ft.context_window(steps(spark, sf), 5, F.col("x"))
    return rows.select(*STEP, "step_idx", F.size("context").cast("long").alias("n_context"), rounded(F.get("context", 0)).alias("oldest_x"), rounded(F.get("context", F.size("context") - 1)).alias("newest_x"))


_CHOICE = f"ch AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, target_step_index ORDER BY {o.uniform('choice', 'observation', 'track', 'CAST(offset_m AS BIGINT)', 'target_step_index', 'replicate')}, replicate) AS q FROM sims) WHERE q <= 2)"


@query("sim_choice", f"WITH {o.simulated(SIMS)}, {_CHOICE} SELECT {K}, target_step_index, replicate FROM ch")
def _(spark, sf):
    return ft.chosen(si.simulate(steps(spark, sf), SIMS), 2).select(*STEP, "target_step_index", "replicate")


@query("training_example", f"""WITH {o.simulated(SIMS)}, {_CHOICE}, lx AS (SELECT {S}, LEAD(x) OVER w AS ox, COUNT(x) OVER v AS n_context, SUM(x) OVER v AS context_sum FROM steps
    WINDOW w AS (PARTITION BY {K} ORDER BY step_idx), v AS (PARTITION BY {K} ORDER BY step_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    sx AS (SELECT {K}, target_step_index AS step_idx, COUNT(*) AS n_sims, arg_min(x, replicate) AS first_sim FROM ch GROUP BY ALL)
    SELECT {S}, round(ox, 6) + 0.0 AS observed_x, n_context, round(context_sum, 6) + 0.0 AS context_sum, n_sims, round(first_sim, 6) + 0.0 AS first_sim_x FROM lx JOIN sx USING ({S}) WHERE step_idx >= 3 AND ox IS NOT NULL""")
def _(spark, sf):
    s = steps(spark, sf)
    made = ft.training_examples(s, si.simulate(s, SIMS), 3, 2, ["x", "y"])
    total = F.aggregate("context", F.lit(0.0), lambda a, v: a + F.get(v, 0))
    return made.select(*STEP, "step_idx", rounded(F.get("observed", 0)).alias("observed_x"), F.size("context").cast("long").alias("n_context"), rounded(total).alias("context_sum"), F.size("simulated").cast("long").alias("n_sims"), rounded(F.get(F.get("simulated", 0), 0)).alias("first_sim_x"))


@query("dropna_v1", f"WITH {o.feat()} SELECT {S} FROM feat WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in _OF))
def _(spark, sf):
    return ft.complete(_observed(spark, sf), ft.OBSERVER).select(*STEP, "step_idx")


@query("local_index_v1", f"WITH {o.feat()} SELECT {S}, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY step_idx) - 1 AS local_index FROM feat WHERE angle_to_observer IS NOT NULL")
def _(spark, sf):
    return ft.local_index(ft.complete(_observed(spark, sf), ["angle_to_observer"])).select(*STEP, "step_idx", "local_index")


# the older loader

_V1 = ["step_speed_mps", "dist_to_observer", "delta_observer_dist", "angle_to_observers"]
_V1T = {"step_speed_mps": "ln(1 + step_speed_mps)", "dist_to_observer": "ln(1 + dist_to_observer)", "delta_observer_dist": "delta_observer_dist", "angle_to_observers": "angle_to_observer / 180"}


def _older(spark, sf):
    """(target, reference) in the older form: complete steps with ids, ground classes and ages."""
    s = steps(spark, sf)
    sims = si.simulate(s, SIMS)
    observed, _ = si.with_ids(s, sims)
    place = fx.observers(spark, sf)
    target = ft.observed_features(s, place).join(observed.select(*STEP, "step_idx", "id"), [*STEP, "step_idx"])
    reference = si.with_ids(s, ft.simulated_features(sims, s, place))[1]
    meta = fx.track_metadata(spark, sf).select(*TRACK, F.col("age").alias("age_class"))
    older = lambda rows: ra.with_ground_class(v1.observer_info(rows).join(meta, TRACK).withColumn("offset", F.col("offset_m").cast("long")), fx.layer(spark, "ground"))
    return v1.prepared(older(target), older(reference), [*_V1, "age_class"], {"age_class": "age_"})


_OLDER = f"""WITH {o.simfeat(SIMS)}, of0 AS (SELECT m.*, easting, northing FROM moves m JOIN obs USING (observation)), feat AS (SELECT {S}, frame, x, y, {o.features('of0')}), {o.TRACKS}, {o.DSM},
    big AS (SELECT {K} FROM steps GROUP BY {K} HAVING COUNT(*) > 2),
    tg AS (SELECT f.*, {_ID} AS id, age, {_CLASS} AS g FROM feat f JOIN meta USING (observation, track) LEFT JOIN dsm c ON {o.at('c', 'f.x', 'f.y')} WHERE age IS NOT NULL AND step_speed_mps IS NOT NULL AND angle_to_observer IS NOT NULL AND dist_to_observer IS NOT NULL AND delta_observer_dist IS NOT NULL),
    rf AS (SELECT f.*, s2.frame, f.observation || '_' || f.track || '_f' || CAST(round_even(s2.frame, 0) AS BIGINT) AS base, age FROM simfeat f JOIN sims s2 USING ({K}, target_step_index, replicate) JOIN big USING ({K}) JOIN meta USING (observation, track)
        WHERE age IS NOT NULL AND step_speed_mps IS NOT NULL AND angle_to_observer IS NOT NULL AND dist_to_observer IS NOT NULL AND delta_observer_dist IS NOT NULL),
    bo AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, {v} AS v FROM {t}" for k, v in _V1T.items() for t in ("tg", "rf"))}),
    st1 AS (SELECT feature, AVG(v) AS m, stddev_samp(v) AS s FROM bo GROUP BY 1)"""
_V1Z = {k: f"({v} - (SELECT m FROM st1 WHERE feature = '{k}')) / (SELECT s FROM st1 WHERE feature = '{k}')" for k, v in _V1T.items()}


@query("v1_prepared", f"{_OLDER} SELECT id, split_part(id, 'f', 1) AS track_id, ROW_NUMBER() OVER (PARTITION BY split_part(id, 'f', 1), offset_m ORDER BY frame, id) - 1 AS local_index, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}_transformed" for k, v in _V1Z.items()) + ", CASE WHEN age = 'adult' THEN 1 ELSE 0 END::BIGINT AS age_adult, CASE WHEN g = 3 THEN 1 ELSE 0 END::BIGINT AS ground_tree FROM tg")
def _(spark, sf):
    target, _, names = _older(spark, sf)
    assert "age_adult" in names["age_class"]
    return shown(target, "id", "track_id", "local_index", *[f + "_transformed" for f in _V1], "age_adult", "ground_tree")


@query("v1_items", f"""{_OLDER}, lo AS (SELECT *, ROW_NUMBER() OVER w - 1 AS local_index, SUM(z) OVER v AS context_sum, COUNT(z) OVER v AS n_context FROM (SELECT *, split_part(id, 'f', 1) AS track_id, {_V1Z['step_speed_mps']} AS z FROM tg)
    WINDOW w AS (PARTITION BY track_id, offset_m ORDER BY frame, id), v AS (PARTITION BY track_id, offset_m ORDER BY frame, id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
    rz AS (SELECT base || '_ob' AS target_id, base || '_sim-' || replicate AS id, {_V1Z['step_speed_mps']} AS z FROM rf),
    rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_id ORDER BY {o.uniform('item', 'target_id', 'id')}, id) AS k, COUNT(*) OVER (PARTITION BY target_id) AS n FROM rz),
    ra AS (SELECT target_id, SUM(z) AS reference_sum FROM rk WHERE k <= 2 AND n >= 2 GROUP BY 1)
    SELECT lo.id, local_index, n_context, round(context_sum, 6) + 0.0 AS context_sum, round(z, 6) + 0.0 AS target_speed, round(reference_sum, 6) + 0.0 AS reference_sum FROM lo JOIN ra ON ra.target_id = lo.id WHERE local_index >= 2""")
def _(spark, sf):
    target, reference, _ = _older(spark, sf)
    enough = reference.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    made = v1.items(target, reference.join(enough, "target_id", "left_semi"), ["step_speed_mps", "track_id"], ["step_speed_mps"], 2, 2)
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda a, v: a + F.get(v, 0)))
    kept = made.join(enough.withColumnRenamed("target_id", "__t"), F.col("id") == F.col("__t"), "left_semi")
    return kept.select("id", "local_index", F.size("context").cast("long").alias("n_context"), total("context").alias("context_sum"), rounded(F.get("target", 0)).alias("target_speed"), total("reference").alias("reference_sum"))


@query("v1_track_onehot", f"{_OLDER} SELECT id, CASE WHEN split_part(id, 'f', 1) = '0_1_' THEN 1 ELSE 0 END::BIGINT AS track_0_1_ FROM tg")
def _(spark, sf):
    hot, names = v1.track_one_hot(_older(spark, sf)[0])
    assert "track_0_1_" in names
    return hot.select("id", "track_0_1_")


@query("observer_info_v1", f"WITH {o.feat()} SELECT {S}, round(sqrt((10.0 + observation % 5 - x) * (10.0 + observation % 5 - x) + (5.0 + observation % 3 - y) * (5.0 + observation % 3 - y)), 6) + 0.0 AS dist_to_observer, {r('angle_to_observer')} FROM feat")
def _(spark, sf):
    return shown(v1.observer_info(_observed(spark, sf)).withColumnRenamed("angle_to_observers", "angle_to_observer"), *STEP, "step_idx", "dist_to_observer", "angle_to_observer")


@query("targets_by_id", f"WITH {o.simulated(SIMS)}, big AS (SELECT {K} FROM steps GROUP BY {K} HAVING COUNT(*) > 2), ob AS (SELECT {K}, {_ID} AS id, LAG({_ID}) OVER (PARTITION BY {K} ORDER BY step_idx) AS prev_step FROM steps), sm1 AS (SELECT observation || '_' || track || '_f' || CAST(round_even(frame, 0) AS BIGINT) || '_ob' AS target_id FROM sims JOIN big USING ({K})) SELECT id, prev_step, COUNT(*) AS n FROM ob JOIN sm1 ON target_id = id GROUP BY 1, 2")
def _(spark, sf):
    s = steps(spark, sf)
    observed, sims = si.with_ids(s, si.simulate(s, SIMS))
    return observed.join(sims.select("target_id"), F.col("id") == F.col("target_id")).groupBy("id", "prev_step").agg(F.count(F.lit(1)).alias("n"))


@query("vocabulary_annotated", f"""WITH {o.steps()}, {o.NEIGHBOURS}, {_NN}, {o.TRACKS}, {o.DSM}, an AS (SELECT t.age AS nn_age, t.species AS nn_species, {_CLASS} AS ground_class FROM steps s LEFT JOIN nn n USING ({S}) LEFT JOIN meta t ON t.observation = s.observation AND t.track = n.neighbor_track LEFT JOIN dsm c ON {o.at('c', 's.x', 's.y')}),
    al AS (SELECT DISTINCT 'nn_age' AS feature, coalesce(nn_age, '') AS value FROM an UNION SELECT DISTINCT 'nn_species', coalesce(nn_species, '') FROM an UNION SELECT DISTINCT 'ground_class', CAST(ground_class AS VARCHAR) FROM an)
    SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY value) - 1 AS idx FROM al""")
def _(spark, sf):
    rows = ra.with_ground_class(so.nearest(steps(spark, sf), fx.fixes(spark, sf), fx.track_metadata(spark, sf)), fx.layer(spark, "ground"))
    return ft.vocabulary(rows, ["nn_age", "nn_species", "ground_class"])


@query("files_discovered", "SELECT DISTINCT split_part(c_name || '_' || c_nationkey || '_tracks.npy', '_', 1) AS observation FROM customer")
def _(spark, sf):
    paths = fx.table(spark, sf, "customer").select(F.concat(F.lit("/raw/"), "c_name", F.lit("_"), F.col("c_nationkey").cast("string"), F.lit("_tracks.npy")).alias("path"))
    return ca.observations_of_files(paths)


@query("any_all_positions", f"WITH {o.FIXES} SELECT observation, track, bool_or(x IS NOT NULL) AS any_position, bool_and(x IS NOT NULL) AS all_positions FROM fixes GROUP BY 1, 2")
def _(spark, sf):
    there = F.col("x").isNotNull()
    return fx.fixes(spark, sf).groupBy(*TRACK).agg(F.bool_or(there).alias("any_position"), F.bool_and(there).alias("all_positions"))


@query("utm_names", f"WITH {_UTM} SELECT c_custkey, CASE WHEN lat BETWEEN -80 AND 84 THEN zone || substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((lat + 80) / 8) AS INTEGER) + 1, 1) END AS utm_zone FROM utm JOIN u0 USING (c_custkey)")
def _(spark, sf):
    rows = _places(spark, sf).withColumns({"observer_easting": F.lit(None).cast("double"), "observer_northing": F.lit(None).cast("double")})
    return ca.observer_position(rows).select("c_custkey", "utm_zone")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean speed of each track's observed steps over all offsets."""
    return avg_speed(spark, sf_dir)
