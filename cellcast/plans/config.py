"""Settings of a run, checked before anything is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Region:
    """Limits of the processed window: latitudes, and longitudes in 0..360."""

    lat: tuple[float, float]
    lon: tuple[float, float]

    @classmethod
    def of(cls, lat: list[float] | None, lon: list[float] | None) -> Region:
        """Limits from user input. Both are needed, as two numbers that aren't both zero; longitudes may be negative."""
        for name, limits in (("latitude", lat), ("longitude", lon)):
            if not limits or len(limits) != 2:
                raise ValueError(f"{name} limits must be two numbers")
            if list(limits) == [0, 0]:
                raise ValueError(f"{name} limits must be given")
        return cls((float(lat[0]), float(lat[1])), (lon[0] % 360, lon[1] % 360))


def session(app: str = "cellcast") -> SparkSession:
    """A session with the settings the engine relies on; memory, cores and partitions are the cluster's."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
