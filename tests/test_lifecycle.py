"""Ingest, preprocess and examples in one run, on observations named by strings and a raster per map; inspection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import loader_v1, raster, trajectory, viewshed
from wayfarer.plans import lifecycle
from wayfarer.sources import catalog, inspect, store


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    raw = tmp_path_factory.mktemp("raw")
    r = np.random.default_rng(1)
    for name in ("ob1", "Observation2"):
        walk = np.cumsum(r.normal(0.3, 0.5, (3, 60, 2)), axis=1) + 20
        walk[1, 10:13] = np.nan
        np.save(raw / f"{name}_utm.npy", walk)
    (raw / "observations.csv").write_text("observation,big_map,observer_easting,observer_northing,observer_lat,observer_lon\nob1,a,25,30,,\nob2,b,,,0.0002,39.0\n")
    (raw / "tracks.csv").write_text("observation,track,individual_ID,species,age\nob1,0,zoe,zebra,adult\nob1,1,yan,zebra,\nob2,0,max,kudu,juvenile\n")
    return raw


@pytest.fixture(scope="module")
def store_folder(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("store"))
    names = lifecycle.ingest(spark, str(folder), out, r"^(?P<obs>.*)_(utm)\.npy$", str(folder / "observations.csv"), str(folder / "tracks.csv"))
    assert names == ["observation1", "observation2"]
    return out


def rasters(spark):
    cells = spark.range(80).select(F.col("id").alias("row")).crossJoin(spark.range(90).select(F.col("id").alias("col")))
    maps = spark.createDataFrame([("a", 0.0), ("b", 5.0)], "big_map string, up double")
    grids = maps.select("big_map", F.lit(0.0).alias("origin_x"), F.lit(80.0).alias("origin_y"), F.lit(1.0).alias("cell_x"), F.lit(-1.0).alias("cell_y"), F.lit(90).alias("width"), F.lit(80).alias("height"))
    of = lambda value: raster.MapLayer(cells.crossJoin(maps).select("big_map", "row", "col", value.alias("value")), grids)
    return lifecycle.Rasters(of(F.col("up") + F.pmod(F.col("row") * 7 + F.col("col") * 3, F.lit(11)) / 5), of(F.col("up") + F.col("row") / 10), of(F.lit(1.4)), of(F.pmod(F.col("row"), F.lit(5))))


def test_run(spark, store_folder, tmp_path):
    root = inspect.Root(spark, store_folder)
    fixes, tracks, observers = (root._table(t) for t in ("fixes", "tracks", "observations"))
    assert tracks.count() == 6  # three a file, those without metadata too
    settings = lifecycle.Settings(offsets={2.0: [0.0, 1.0], 3.0: [0.0]}, alternatives=4, viewshed_radius=3.0)
    observed, simulated = lifecycle.preprocess(fixes, observers, tracks, rasters(spark), str(tmp_path), settings, {0: "bare", 1: "grass"})
    walks = observed.groupBy("observation", "track", "step_length", "offset_m").count().collect()
    assert {r["observation"] for r in walks} == {"observation1", "observation2"}
    assert {(r["step_length"], r["offset_m"]) for r in walks} == {(2.0, 0.0), (2.0, 1.0), (3.0, 0.0)}
    assert observed.schema["step_speed_mps"].metadata["units"] == "m/s"
    assert simulated.where("viewshed_vis is null").count() == 0
    assert observed.where("social_density is null or nn_track is null").count() == 0
    lengths = simulated.where("abs(step_length_m - length_m) > 1e-9").count()
    assert lengths == 0
    made = lifecycle.examples(observed, simulated, ["step_speed_mps", "dist_to_observer", "viewshed_vis", "social_density"], ["age", "ground_class"], 3, 4)
    rows = made.collect()
    assert rows
    width = len(rows[0]["observed"])
    assert all(len(v) == width for r in rows for v in [r["observed"], *r["context"], *r["simulated"]])
    assert all(len(r["context"]) == 3 and r["meta"]["target_step_index"] == r["step_idx"] for r in rows)
    assert all(v[3] == 0.0 for r in rows for v in r["simulated"])  # alternatives have no social density
    before = spark.read.parquet(f"{tmp_path}/viewsheds").count()
    viewshed.annotate(spark, observed.drop("viewshed_vis"), f"{tmp_path}/viewsheds", rasters(spark).dsm, rasters(spark).heights, 3.0)
    assert spark.read.parquet(f"{tmp_path}/viewsheds").count() == before  # all were found


def test_inspection(spark, store_folder):
    root = inspect.Root(spark, store_folder)
    assert root.observations() == ["observation1", "observation2"]
    assert root.open("ob1").count() == 180
    with pytest.raises(FileNotFoundError):
        root.open(7)
    assert root.xy_names() == ("x", "y")
    assert root.track_columns() == ["individual_ID", "species", "age"]
    assert root.tracks(1, [0, 2]) == [0, 2]
    with pytest.raises(ValueError, match="no track"):
        root.tracks(1, [0, 9])
    summary = root.summary("Observation2")
    assert (summary["n_tracks"], summary["n_frames"], summary["n_fixes"]) == (3, 60, 177)
    assert list(summary["attributes"])[:2] == ["big_map", "observer_lat"]
    assert summary["attributes"]["utm_zone"] == "37N"
    assert summary["attributes"]["easting"] == pytest.approx(500000.0)
    assert root.track(1, 0) == {"observation": "observation1", "track": 0, "individual_ID": "zoe", "species": "zebra", "age": "adult"}
    assert root.track(2, 2)["species"] == ""
    assert root.plot_rows(1, [0], 20).count() == 20
    labelled = root._table("tracks").withColumn("track_label", F.col("individual_ID"))
    assert catalog.track_rows(root.open(1), ["zoe", "yan"], labelled).select("track").distinct().count() == 2
    with pytest.raises(FileNotFoundError):
        inspect.Root(spark, store_folder + "/nowhere").open(1)


def test_the_users_own_labels(spark, folder):
    own = catalog.read_tracks(spark, str(folder), r"^(.*)_utm\.npy$", lambda name: F.concat(F.lit("site-"), F.lower(name)))
    assert sorted(r[0] for r in own.select("observation").distinct().collect()) == ["site-ob1", "site-observation2"]


def test_stores(spark, tmp_path):
    place = str(tmp_path / "kept")
    assert store.open_or_none(spark, place) is None
    store.append(store.empty(spark, "a bigint, b string"), place)
    assert store.open_or_none(spark, place).columns == ["a", "b"]
    store.append(spark.createDataFrame([(1, "x")], "a bigint, b string"), place)
    assert store.open_or_none(spark, place).count() == 1
    assert store.report(spark, str(tmp_path)) == ["kept"]
    store.append(spark.createDataFrame([(2, 0.5)], "a bigint, c double"), str(tmp_path / "other"))
    both = catalog.read_all(spark, [place, str(tmp_path / "other")])
    assert sorted(map(tuple, both.collect())) == [(1, "x", None), (2, None, 0.5)]


def test_attributes_of_all_kinds(spark):
    rows = spark.sql("select cast('NaN' as double) a, 1.5D b, date'2020-01-02' c, timestamp'2020-01-02 03:04:05' d, 'x' e, cast(null as int) f")
    assert rows.select(catalog.attributes(rows, *rows.columns)).first()[0] == '{"b":1.5,"c":"2020-01-02","d":"2020-01-02T03:04:05","e":"x"}'


def test_labels_lose_blanks(spark):
    assert spark.sql("select ' ob3 ' n").select(catalog.label(F.col("n"))).first()[0] == "observation3"


def test_older_loader(spark):
    cols = "id string, offset bigint, frame double, step_speed_mps double, social_dens bigint, species string, ground_class bigint"
    target = spark.createDataFrame([(f"1_{t}_f{k}_ob", 0, float(k), 1.0 + k + t, k % 2, "ab"[t], k % 5) for t in range(2) for k in range(4)], cols)
    reference = spark.createDataFrame([(f"1_{t}_f{k}_sim-{j}", f"1_{t}_f{k}_ob", 0, float(k), 2.0 + j, 0, "ab"[t], 9) for t in range(2) for k in range(4) for j in range(3)], cols.replace("id string,", "id string, target_id string,"))
    done, other, names = loader_v1.prepared(target, reference, ["step_speed_mps"], {"species": "species_"})
    assert names == {"ground_class": ["ground_unclassified", "ground_bare", "ground_grass", "ground_tree", "ground_road"], "species": ["species_a", "species_b"]}
    both = np.log1p([1.0 + k + t for t in range(2) for k in range(4)] + [2.0 + j for _ in range(8) for j in range(3)])
    z = {r["id"]: r["step_speed_mps_transformed"] for r in done.collect()}
    assert z["1_0_f0_ob"] == pytest.approx((np.log1p(1.0) - both.mean()) / both.std(ddof=1))
    features = loader_v1.rewritten(["step_speed_mps", "species", "id"], "species", names["species"])
    assert features == ["step_speed_mps", "id", "species_a", "species_b"]
    hot, tracks = loader_v1.track_one_hot(done)
    assert tracks == ["track_1_0_", "track_1_1_"]
    made = loader_v1.passes(hot, other, 2, context_features=features, target_features=features, context=2, references=2, random_effects=tracks)
    rows = made.collect()
    assert len(rows) == 2 * 2 * 2
    assert all(len(r["context"]) == 2 and len(r["reference"]) == 2 and len(r["target"]) == 3 and sum(r["random_effects"]) == 1 for r in rows)
    context, one, refs = loader_v1.collated(made.where("pass = 0"), ["s", "a", "b"], ["s", "a", "b"])
    assert (len(context), len(one), len(refs)) == (8, 4, 8)
    with pytest.raises(Exception, match="too few reference steps"):
        loader_v1.items(hot, other.where("id not like '%2'"), ["step_speed_mps"], ["step_speed_mps"], 2, 3).collect()


def test_walks_of_several_lengths(spark):
    line = spark.createDataFrame([(0, 0, k, float(k), 0.0) for k in range(13)], "observation bigint, track bigint, frame bigint, x double, y double")
    made = trajectory.moves(trajectory.walk_lengths(line, {3.0: [0.0, 1.0], 4.0: [0.0]}))
    found = {(r["step_length"], r["offset_m"]): r["n"] for r in made.where("abs(length_m - step_length) < 1e-9").groupBy("step_length", "offset_m").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {(3.0, 0.0): 4, (3.0, 1.0): 3, (4.0, 0.0): 3}
