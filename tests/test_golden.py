"""Hand-made cases: walks, densifying, angles, rounding, sampling, readers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.functions import geometry as g
from wayfarer.model import MissingColumns
from wayfarer.operators import features, raster, simulation, social, trajectory
from wayfarer.sources import catalog


def track(spark, *points):
    rows = [(0, 0, k, *(p or (None, None))) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, "observation bigint, track bigint, frame bigint, x double, y double")


def walked(fixes, length, offset):
    return [(r["x"], r["y"]) for r in trajectory.walk_arc(fixes, length, [offset]).orderBy("step_idx").collect()]


@pytest.mark.parametrize(
    ("points", "offset", "xs"),
    [
        (((0.0, 0.0), (10.0, 0.0)), 0.0, [0, 5, 10]),
        (((0.0, 0.0), (10.0, 0.0)), 3.0, [3, 8]),
        (((0.0, 0.0), (10.0, 0.0)), 11.0, []),
        (((1.0, 1.0), (1.0, 1.0)), 0.0, [1]),
        (((1.0, 1.0), (1.0, 1.0)), 1.0, []),
        (((0.0, 0.0), None, (10.0, 0.0)), 0.0, [0, 5, 10]),
        (((0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (10.0, 0.0)), 0.0, [0, 5, 10]),
        ((None, (2.0, 0.0), None), 0.0, [2]),
        ((None, None), 0.0, []),
    ],
)
def test_walk_arc(spark, points, offset, xs):
    assert [x for x, _ in walked(track(spark, *points), 5.0, offset)] == xs


def test_walk_arc_keeps_arc_distance(spark):
    r = np.random.default_rng(3)
    points = [tuple(p) for p in r.normal(size=(60, 2)).cumsum(axis=0).tolist()]
    found = walked(track(spark, *points), 0.7, 0.2)
    line = np.array(points)
    s = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])
    t = np.arange(0.2, s[-1] + 1e-9, 0.7)
    assert np.allclose(found, np.stack([np.interp(t, s, line[:, k]) for k in (0, 1)], axis=1))


def test_walk_chord(spark):
    line = track(spark, *[(float(x), 0.0) for x in (0, 1, 2, 3, 3.5, 5, 7)])
    at = lambda **k: [r["x"] for r in trajectory.walk_chord(line, 2.0, **k).orderBy("step_idx").collect()]
    assert at() == [0, 2, 5, 7]
    assert at(offset=3.0) == [3, 5, 7]
    assert at(offset=100.0) == [2, 5, 7]
    assert at(allowed=F.col("x") != 2) == [0, 3, 5, 7]


def test_densify(spark):
    short = trajectory.densify(track(spark, (0.0, 0.0), (0.12, 0.0)), 0.1)
    assert short.count() == 2
    gaps = trajectory.densify(track(spark, None, (1.0, 1.0), None), 0.05).orderBy("seg", "k").collect()
    assert [(r["frame"], r["x"]) for r in gaps] == [(0.0, None), (1.0, None), (2.0, None)]
    whole = trajectory.densify_distinct(track(spark, (0.0, 0.0), (1.0, 0.0), (2.0, 0.0)), 0.25)
    assert sorted(r["x"] for r in whole.collect()) == pytest.approx([0, 1 / 3, 2 / 3, 1, 4 / 3, 5 / 3, 2])


def test_angles(spark):
    angles = spark.createDataFrame([(math.pi,), (-math.pi,), (1.5 * math.pi,)], "a double").select(g.wrap(F.col("a"))).collect()
    assert [r[0] for r in angles] == pytest.approx([-math.pi, -math.pi, -math.pi / 2])
    one = spark.range(1).select(*[g.angle_between(*map(F.lit, v)) for v in ((1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (1.0, 0.0, -2.0, 0.0))]).first()
    assert tuple(one) == (pytest.approx(90), None, pytest.approx(180))
    turn = spark.range(1).select(g.turning_degrees(*map(F.lit, (1.0, 0.0, 0.0, 1.0))), g.turning_degrees(*map(F.lit, (1.0, 0.0, 0.0, -1.0)))).first()
    assert tuple(turn) == (pytest.approx(90), pytest.approx(-90))


def test_frames_round_half_to_even(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "f double").select(social.frame_of(F.col("f"))).collect()
    assert [r[0] for r in rows] == [0, 2, 2]


def test_utm_of_known_places(spark):
    """The central meridian and the equator, and mirror images across both."""
    at = lambda lat, lon: tuple(spark.range(1).select(*g.utm(F.lit(lat), F.lit(lon))).first())
    assert at(0.0, 39.0) == pytest.approx((500000.0, 0.0))
    east, north = at(1.0, 37.5)
    assert at(1.0, 40.5) == pytest.approx((1000000 - east, north))
    assert at(-1.0, 37.5) == pytest.approx((east, 10000000 - north))
    assert north == pytest.approx(0.9996 * 110574.4 * 1.0003, rel=2e-3)


def layer(spark, values):
    cells = spark.createDataFrame([(r, c, v) for r, row in enumerate(values) for c, v in enumerate(row)], "row bigint, col bigint, value double")
    return raster.Layer(cells, 0.0, float(len(values)), 1.0, -1.0, len(values[0]), len(values))


def test_sample_and_sightline(spark):
    dsm = layer(spark, [[0.0, 5.0, 0.0, None], [0.0, 0.0, 0.0, 0.0]])
    points = spark.createDataFrame([(0.5, 1.5), (3.5, 1.5), (9.0, 9.0), (None, 0.5)], "x double, y double")
    assert sorted((r["x"] or -1, r["v"]) for r in raster.sample(points, dsm, "v").collect()) == [(-1, None), (0.5, 0.0), (3.5, None), (9.0, None)]
    pairs = spark.createDataFrame([(1, 0.5, 1.5, 1.0, 2.5, 1.5, 1.0), (2, 0.5, 0.5, 1.0, 2.5, 0.5, 1.0), (3, 0.5, 1.5, 9.0, 2.5, 1.5, 9.0), (4, 0.5, 0.5, None, 2.5, 0.5, 1.0)], "id bigint, ax double, ay double, az double, bx double, by double, bz double")
    seen = social.sightline(pairs, dsm, ["id"], ("ax", "ay", "az"), ("bx", "by", "bz"))
    assert {r["id"]: r["visible"] for r in seen.collect()} == {1: False, 2: True, 3: True, 4: False}
    back = social.sightline(pairs, dsm, ["id"], ("bx", "by", "bz"), ("ax", "ay", "az"))
    assert {r["id"]: r["visible"] for r in back.collect()} == {1: False, 2: True, 3: True, 4: False}


def test_simulated_steps_have_the_observed_length(spark):
    steps = trajectory.walk_arc(track(spark, *[(float(k), float(k % 3)) for k in range(30)]), 2.0, [0.0])
    for angles in ("uniform", "track", "observation", "global"):
        rows = simulation.simulate(steps, 4, angles).collect()
        assert len(rows) == 4 * (steps.count() - 1)
        assert all(math.hypot(r["x"] - r["px"], r["y"] - r["py"]) == pytest.approx(r["length_m"]) for r in rows)
    with pytest.raises(ValueError, match="angles"):
        simulation.simulate(steps, 4, "none")


def test_rejection_goes_on_for_steps_that_are_short(spark):
    steps = trajectory.walk_arc(track(spark, (0.5, 0.5), (3.5, 0.5)), 1.0, [0.0])
    dsm = layer(spark, [[1.0, 1.0, 1.0, 1.0]])
    made = simulation.simulate(steps, 3, layer=dsm)
    assert made.groupBy("target_step_index").count().where("count <> 3").count() == 0
    assert made.agg(F.max("trial")).first()[0] >= 6


def test_statistics_guard_small_and_constant_features(spark):
    rows = spark.createDataFrame([(1.0, None, 7.0), (3.0, 5.0, 7.0)], "a double, b double, c double")
    found = {r["feature"]: (r["n"], r["mean"], r["std"]) for r in features.numeric_stats(rows, ["a", "b", "c"]).collect()}
    assert found == {"a": (2, 2.0, pytest.approx(math.sqrt(2))), "b": (1, 0.0, 1.0), "c": (2, 7.0, 1.0)}


def test_one_hot_of_unknown_and_missing_values(spark):
    known = features.vocabulary(spark.createDataFrame([("b",), ("a",), (None,)], "age string"), ["age"])
    rows = features.one_hot(spark.createDataFrame([("a",), (None,), ("z",)], "age string"), "age", known).collect()
    assert [r["age_onehot"] for r in rows] == [[0, 1, 0], [1, 0, 0], [0, 0, 0]]


def test_read_tracks_and_metadata(spark, tmp_path):
    np.save(tmp_path / "ob7_utm.npy", np.array([[[0.0, 1.0], [np.nan, np.nan]]]))
    np.save(tmp_path / "Observation8_utm.npy", np.array([[2.0, 3.0]]))
    fixes = catalog.read_tracks(spark, str(tmp_path), r"^(.*)_utm\.npy$")
    with pytest.raises(ValueError, match="no .npy file"):
        catalog.read_tracks(spark, str(tmp_path), "^(nothing)$")
    assert sorted((r["observation"], r["track"], r["frame"], r["x"]) for r in fixes.collect()) == [("observation7", 0, 0, 0.0), ("observation7", 0, 1, None), ("observation8", 0, 0, 2.0)]
    (tmp_path / "tracks.csv").write_text("observation,track,frame,age\nob7,0,9,adult\n")
    meta = catalog.read_metadata(spark, str(tmp_path / "tracks.csv"), ["observation", "track"])
    assert meta.columns == ["observation", "track", "frame_meta", "age"]
    assert meta.first()["observation"] == "observation7"
    with pytest.raises(MissingColumns):
        catalog.read_metadata(spark, str(tmp_path / "tracks.csv"), ["observation", "species"])
    path = catalog.write_table(fixes, str(tmp_path / "fixes"), ["observation"])
    assert catalog.only(spark.read.parquet(path), ["7"]).count() == 2
    with pytest.raises(ValueError, match="no requested"):
        catalog.only(fixes, [99])


def test_labels():
    assert catalog.wanted_labels(["ob7", "Observation12", 3, " 4 "]) == {"observation7", "observation12", "observation3", "observation4"}
    with pytest.raises(ValueError, match="names no observation"):
        catalog.wanted_labels(["track7"])
    with pytest.raises(ValueError, match="one named obs"):
        catalog.observation_of(F.lit("a"), "a(b)(c)")
