"""Common table expressions in DuckDB SQL that state the engine's tables independently of it."""

from __future__ import annotations

L = 5.0

FIXES = """
e AS (SELECT user_id, event_id, event_type, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events),
d AS (SELECT *, (event_id * 7919 + CAST(ROUND(value * 100) AS BIGINT)) % 2001 - 1000 AS dx_mm, (event_id * 104729 + CAST(ROUND(value * 100) AS BIGINT) * 31) % 2001 - 1000 AS dy_mm FROM e),
p AS (SELECT user_id, frame, event_type, SUM(dx_mm) OVER w + (user_id % 15) * 2000 AS x_mm, SUM(dy_mm) OVER w + (user_id % 7) * 2000 AS y_mm FROM d
    WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fixes AS (SELECT CAST(FLOOR(user_id / 15) AS BIGINT) AS observation, CAST(user_id % 15 AS BIGINT) AS track, CAST(frame AS BIGINT) AS frame,
    CASE WHEN event_type = 'error' AND frame % 3 = 0 THEN NULL ELSE CAST(x_mm AS DOUBLE) / 1000 END AS x,
    CASE WHEN event_type = 'error' AND frame % 3 = 0 THEN NULL ELSE CAST(y_mm AS DOUBLE) / 1000 END AS y FROM p)
"""

POINTS = (
    FIXES
    + """,
pts AS (SELECT observation, track, CAST(frame AS DOUBLE) AS frame, x, y, ROW_NUMBER() OVER w AS k, LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny, CAST(LEAD(frame) OVER w AS DOUBLE) AS nf
    FROM fixes WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY observation, track ORDER BY frame)),
seg AS (SELECT *, coalesce(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)), 0) AS len FROM pts),
arc AS (SELECT *, SUM(len) OVER (PARTITION BY observation, track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM seg),
line AS (SELECT *, coalesce(LAG(hi) OVER w, 0) AS lo, MAX(hi) OVER (PARTITION BY observation, track) AS total, LEAD(nx) OVER w IS NULL AS is_last FROM arc WINDOW w AS (PARTITION BY observation, track ORDER BY frame))
"""
)


def steps(offsets: tuple[float, ...] = (0.0,), length: float = L) -> str:
    """The steps, as targets joined to the segment that holds them."""
    values = ", ".join(f"(CAST({o} AS DOUBLE))" for o in offsets)
    return (
        POINTS
        + f""",
offs(offset_m) AS (VALUES {values}),
tr AS (SELECT DISTINCT observation, track, total FROM line),
tt AS (SELECT observation, track, offset_m, i AS step_idx, offset_m + i * CAST({length} AS DOUBLE) AS t FROM
    (SELECT *, unnest(range(0, CAST(ceil((total + 1e-9 - offset_m) / CAST({length} AS DOUBLE)) AS BIGINT))) AS i FROM tr, offs WHERE total > 0 AND offset_m <= total)),
steps AS (SELECT t.observation, t.track, offset_m, step_idx, frame + CASE WHEN len > 0 THEN (t - lo) / len ELSE 0 END * (nf - frame) AS frame,
    x + CASE WHEN len > 0 THEN (t - lo) / len ELSE 0 END * (nx - x) AS x, y + CASE WHEN len > 0 THEN (t - lo) / len ELSE 0 END * (ny - y) AS y
    FROM tt t JOIN line USING (observation, track) WHERE nx IS NOT NULL AND t.t >= lo AND (t.t < hi OR is_last)
  UNION ALL SELECT observation, track, offset_m, CAST(0 AS BIGINT), frame, x, y FROM line, offs WHERE total = 0 AND k = 1 AND offset_m = 0)
"""
    )


def moves(offsets: tuple[float, ...] = (0.0,)) -> str:
    return (
        steps(offsets)
        + """,
m0 AS (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(frame) OVER w AS pframe FROM steps WINDOW w AS (PARTITION BY observation, track, offset_m ORDER BY step_idx)),
moves AS (SELECT *, x - px AS dx, y - py AS dy, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS length_m, atan2(y - py, x - px) AS heading FROM m0)
"""
    )


WRAP = "(({0} + pi()) - 2 * pi() * floor(({0} + pi()) / (2 * pi())) - pi())"


def wrap(angle: str) -> str:
    return WRAP.format(angle)


def turns(offsets: tuple[float, ...] = (0.0,)) -> str:
    return (
        moves(offsets)
        + f""",
h AS (SELECT *, LAG(heading) OVER (PARTITION BY observation, track, offset_m ORDER BY step_idx) AS before FROM moves),
turns AS (SELECT observation, track, offset_m, step_idx, {wrap("(heading - before)")} AS delta FROM h WHERE before IS NOT NULL)
"""
    )


DSM = """
dsm AS (SELECT r.i AS "row", c.i AS col, CASE WHEN (r.i * 13 + c.i * 7) % 41 = 0 THEN NULL ELSE CAST((r.i * 37 + c.i * 91) % 5000 AS DOUBLE) / 1000 END AS value
    FROM (SELECT unnest(range(0, 100)) AS i) r, (SELECT unnest(range(0, 130)) AS i) c)
"""


def at(alias: str, x: str, y: str) -> str:
    """Join condition of a raster's cell at a place."""
    return f'{alias}."row" = CAST(floor(({y} - 30) / -0.5) AS BIGINT) AND {alias}.col = CAST(floor(({x} + 20) / 0.5) AS BIGINT)'


def uniform(seed: str, *key: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(key)})), 1, 8) AS BIGINT) / 4294967296.0)"


def simulated(n: int, angles: str = "uniform", raster: bool = False, seed: str = "sim", offsets: tuple[float, ...] = (0.0,)) -> str:
    """The alternatives; all trials are listed at once."""
    part = {"uniform": None, "track": "observation, track", "observation": "observation", "global": ""}[angles]
    u = uniform(seed, "observation", "track", "CAST(offset_m AS BIGINT)", "target_step_index", "trial")
    cte = turns(offsets) + (("," + DSM) if raster else "")
    cte += f""",
st AS (SELECT observation, track, offset_m, step_idx AS target_step_index, x, y, LEAD(length_m) OVER w AS length_m, LEAD(frame) OVER w AS frame, coalesce(heading, LEAD(heading) OVER w) AS base
    FROM moves WINDOW w AS (PARTITION BY observation, track, offset_m ORDER BY step_idx)),
tl AS (SELECT *, unnest(range(0, {50 * n if raster else 2 * n})) AS trial FROM st WHERE length_m IS NOT NULL),
tu AS (SELECT *, {u} AS u FROM tl)
"""
    if part is None:
        cte += ", ta AS (SELECT *, u * 2 * pi() AS theta FROM tu)"
    else:
        by = f"PARTITION BY {part} " if part else ""
        on = " AND ".join([f"a.{c.strip()} = q.{c.strip()}" for c in part.split(",") if c] or ["true"])
        cte += f""",
pool AS (SELECT *, ROW_NUMBER() OVER ({by}ORDER BY observation, track, offset_m, step_idx) - 1 AS pool_idx, COUNT(*) OVER ({by}) AS pool_n FROM turns),
sizes AS (SELECT DISTINCT {part + ", " if part else ""}pool_n FROM pool),
tn AS (SELECT a.*, q.pool_n FROM tu a LEFT JOIN sizes q ON {on}),
ta AS (SELECT a.*, {wrap("(a.base + coalesce(q.delta, a.u * 2 * pi() - pi()))")} AS theta FROM tn a LEFT JOIN pool q ON {on} AND q.pool_idx = CAST(floor(a.u * a.pool_n) AS BIGINT))
"""
    cte += ", te AS (SELECT observation, track, offset_m, target_step_index, trial, theta, x AS px, y AS py, length_m, frame, x + length_m * cos(theta) AS x, y + length_m * sin(theta) AS y FROM ta)"
    kept = f"te t JOIN dsm c ON {at('c', 't.x', 't.y')} AND c.value IS NOT NULL" if raster else "te t"
    return cte + f""",
sims AS (SELECT * FROM (SELECT t.*, ROW_NUMBER() OVER (PARTITION BY observation, track, offset_m, target_step_index ORDER BY trial) - 1 AS replicate FROM {kept}) WHERE replicate < {n})
"""


OBSERVERS = """
obs AS (SELECT o.observation, 10.0 + o.observation % 5 AS easting, 5.0 + o.observation % 3 AS northing, r.r_name AS big_map
    FROM (SELECT DISTINCT observation FROM fixes) o JOIN region r ON r.r_regionkey = o.observation % 5)
"""

TRACKS = """
meta AS (SELECT u.observation, u.track, c.c_name AS individual_ID, c.c_mktsegment AS species,
    CASE WHEN (u.observation * 15 + u.track) % 11 <> 0 THEN list_extract(['adult', 'juvenile', 'subadult'], (u.observation * 15 + u.track) % 3 + 1) END AS age
    FROM (SELECT DISTINCT observation, track FROM fixes) u JOIN customer c ON c.c_custkey = u.observation * 15 + u.track WHERE (u.observation * 15 + u.track) % 13 <> 0)
"""


def angle_between(ax: str, ay: str, bx: str, by: str) -> str:
    n = f"(sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({bx} * {bx} + {by} * {by}))"
    return f"CASE WHEN {n} > 0 THEN degrees(acos(greatest(-1, least(1, ({ax} * {bx} + {ay} * {by}) / nullif({n}, 0))))) END"


def features(source: str) -> str:
    """The seven features of moves in source(px, py, pframe, x, y, frame, easting, northing)."""
    away = lambda x, y: f"sqrt((easting - {x}) * (easting - {x}) + (northing - {y}) * (northing - {y}))"
    move = "sqrt((x - px) * (x - px) + (y - py) * (y - py))"
    return f"""
        {move} AS step_length_m, (frame - pframe) / 30.0 AS step_duration_s, {move} / nullif((frame - pframe) / 30.0, 0) AS step_speed_mps,
        CASE WHEN px IS NOT NULL THEN {away("x", "y")} END AS dist_to_observer, {away("x", "y")} - {away("px", "py")} AS delta_observer_dist,
        {angle_between("(x - px)", "(y - py)", "(easting - px)", "(northing - py)")} AS angle_to_observer, degrees(atan2(y - py, x - px)) AS heading_deg FROM {source}"""


def feat(offsets: tuple[float, ...] = (0.0,)) -> str:
    return moves(offsets) + "," + OBSERVERS + ", of0 AS (SELECT m.*, easting, northing FROM moves m JOIN obs USING (observation)), feat AS (SELECT observation, track, offset_m, step_idx, frame, x, y, " + features("of0") + ")"


def simfeat(n: int) -> str:
    return (
        simulated(n)
        + ","
        + OBSERVERS
        + """, sf0 AS (SELECT s.observation, s.track, s.offset_m, s.target_step_index, s.replicate, s.x, s.y, s.frame, s.px, s.py, b.frame AS pframe, easting, northing
    FROM sims s JOIN steps b ON b.observation = s.observation AND b.track = s.track AND b.offset_m = s.offset_m AND b.step_idx = s.target_step_index JOIN obs ON obs.observation = s.observation),
simfeat AS (SELECT observation, track, offset_m, target_step_index, replicate, x, y, """
        + features("sf0")
        + ")"
    )


NEIGHBOURS = """
met AS (SELECT s.*, f.track AS neighbor_track, f.x AS nx, f.y AS ny, sqrt((f.x - s.x) * (f.x - s.x) + (f.y - s.y) * (f.y - s.y)) AS distance_m
    FROM steps s JOIN fixes f ON f.observation = s.observation AND f.frame = CAST(round_even(s.frame, 0) AS BIGINT) AND f.track <> s.track WHERE f.x IS NOT NULL AND f.y IS NOT NULL)
"""
