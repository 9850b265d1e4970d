"""Looking into a folder of ingested observations, one table each: <root>/<observation>/fixes and /tracks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, store

#: Attributes that a summary names first.
PREFERRED = ("big_map", "site", "date", "observer_lat", "observer_lon", "observer_easting", "observer_northing", "utm_zone_number", "utm_zone_letter")


@dataclass(frozen=True)
class Root:
    """A folder with the tables fixes (partitioned by observation), tracks and observations."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        found = store.open_or_none(self.spark, f"{self.folder}/{name}")
        if found is None:
            raise FileNotFoundError(f"{self.folder} has no table {name}")
        return found

    def observations(self) -> list[str]:
        """Names of the observations, sorted: the partition folders, not the rows."""
        return [n.removeprefix("observation=") for n in store.report(self.spark, f"{self.folder}/fixes")]

    def open(self, observation: str | int) -> DataFrame:
        """The fixes of one observation; raises if it isn't there."""
        (name,) = catalog.wanted_labels([observation])
        if name not in self.observations():
            raise FileNotFoundError(f"{self.folder} has no {name}")
        return self._table("fixes").where(F.col("observation") == name)

    def xy_names(self) -> tuple[str, str]:
        """The names of the two coordinates."""
        names = [c for c in self._table("fixes").columns if c not in ("observation", "track", "frame")]
        if len(names) != 2:
            raise ValueError(f"there are not two coordinates but {names}")
        return names[0], names[1]

    def track_columns(self) -> list[str]:
        """The names of the metadata of tracks."""
        return [c for c in self._table("tracks").columns if c not in ("observation", "track")]

    def tracks(self, observation: str | int, which: int | str | list[int | str]) -> list[int]:
        """Numbers of tracks given by number or label; raises for one that isn't there."""
        (name,) = catalog.wanted_labels([observation])
        rows = self._table("tracks").where(F.col("observation") == name)
        found = catalog.track_rows(rows, which, rows if "track_label" in rows.columns else None)
        return sorted(r["track"] for r in found.select("track").distinct().collect())

    def summary(self, observation: str | int) -> dict:
        """Tracks, frames and fixes of an observation, its attributes (the preferred ones first) and its tracks' metadata columns."""
        counts = catalog.summary(self.open(observation)).first().asDict()
        about = self._table("observations").where(F.col("observation") == counts["observation"]).first()
        known = {k: v for k, v in about.asDict().items() if v is not None and k != "observation"} if about else {}
        order = [*[k for k in PREFERRED if k in known], *sorted(set(known) - set(PREFERRED))]
        return {**counts, "attributes": {k: known[k] for k in order}, "track_columns": self.track_columns()}

    def track(self, observation: str | int, track: int | str) -> dict:
        """The metadata of one track."""
        (number,) = self.tracks(observation, track)
        (name,) = catalog.wanted_labels([observation])
        return self._table("tracks").where((F.col("observation") == name) & (F.col("track") == number)).first().asDict()

    def plot_rows(self, observation: str | int, tracks: list[int | str] | None = None, most: int = 2000) -> DataFrame:
        """What a plot of an observation's tracks shows: its fixes, every k-th frame so that most are left at most."""
        fixes = self.open(observation)
        if tracks is not None:
            fixes = fixes.where(F.col("track").isin(self.tracks(observation, tracks)))
        frames = fixes.agg(F.max("frame")).first()[0]
        return catalog.thinned(fixes, most, 0 if frames is None else frames + 1)
