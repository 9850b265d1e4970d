"""The streamed walk against the batch walk, the fixes arriving in three files."""

import pytest

from wayfarer.operators import trajectory
from wayfarer.sources import fixtures
from wayfarer.streaming.walk import walk_arc_stream


@pytest.mark.parametrize("offset", [0.0, 2.0])
def test_stream(spark, tmp_path, offset):
    fixes = fixtures.fixes(spark, "/root/testdata/sf0.001").where("track < 3").cache()
    for k in range(3):
        fixes.where(f"frame >= {k * 25} and frame < {(k + 1) * 25 if k < 2 else 10**6}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = walk_arc_stream(stream, 5.0, offset).writeStream.format("memory").queryName("walked").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = lambda df: sorted((r["track"], r["step_idx"], round(r["frame"], 6), round(r["x"], 6), round(r["y"], 6)) for r in df.collect())
    assert spark.table("walked").where("late > 0").count() == 0
    assert rows(spark.table("walked")) == rows(trajectory.walk_arc(fixes, 5.0, [offset]))


def test_late_fixes_are_counted(spark, tmp_path):
    """Observations named by strings; the second file has a fix that comes too late."""
    for frames in ((0, 10), (4, 20)):
        rows = [("observation1", 0, f, float(f), 0.0) for f in frames]
        spark.createDataFrame(rows, "observation string, track bigint, frame bigint, x double, y double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("observation string, track bigint, frame bigint, x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = walk_arc_stream(stream, 5.0).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = sorted((r["step_idx"], r["x"], r["late"]) for r in spark.table("late").collect() if r["step_idx"] is not None)
    assert found == [(0, 0.0, 0), (1, 5.0, 0), (2, 10.0, 0), (3, 15.0, 0), (4, 20.0, 0)]
    assert sum(r["late"] for r in spark.table("late").collect()) == 1
