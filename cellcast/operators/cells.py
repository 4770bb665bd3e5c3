"""Cells from labelled gates, and aggregates over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars


def summarise(labels: DataFrame, gates: DataFrame) -> DataFrame:
    """(scan, id, num_gates, max_refl, lat, lon) of each label other than 0.

    Every gate counts, gates without a value too; the maximum and the centroid, weighted by e^value, use those with
    one. The weights are taken relative to the largest value, so they can't overflow. The largest value comes from its
    own small aggregate, so no label's gates are gathered in one task.
    """
    keys = ["scan", "poly_id"]
    rows = labels.where("poly_id <> 0").join(gates.select("scan", "i", "j", "lat", "lon", "value"), ["scan", "i", "j"])
    top = rows.groupBy(*keys).agg(F.max("value").alias("max_refl"), F.count("*").alias("num_gates"))
    weighed = rows.where("value IS NOT NULL").join(top, keys).withColumn("w", F.exp(F.col("value") - F.col("max_refl")))
    centre = weighed.groupBy(*keys).agg((F.sum(F.col("lat") * F.col("w")) / F.sum("w")).alias("lat"), scalars.wrap_360(F.sum(F.col("lon") * F.col("w")) / F.sum("w")).alias("lon"))
    return top.join(centre, keys, "left").select("scan", F.col("poly_id").alias("id"), "num_gates", "max_refl", "lat", "lon")


def composite(sweeps: DataFrame) -> DataFrame:
    """Each gate's largest value over all heights; NULL only if it has none."""
    return sweeps.groupBy("scan", "i", "j").agg(F.max("value").alias("value"))


def core_summary(regions: DataFrame, gates: DataFrame, seed: float = 50.0, least: int = 25) -> DataFrame:
    """(scan, region, num_gates, max_refl, ci, cj, lat, lon) of regions of at least `least` gates.

    The centre is the mean index weighted by value over the core (value >= seed), or of all gates if there is none,
    and the position is that of the gate nearest to it, halves going to the even index.
    """
    rows = regions.join(gates.select("scan", "i", "j", "value"), ["scan", "i", "j"])
    core = F.col("value") >= seed
    mean = lambda c: F.coalesce(F.sum(F.when(core, F.col(c) * F.col("value"))) / F.sum(F.when(core, F.col("value"))), F.avg(c))
    found = rows.groupBy("scan", "region").agg(F.count("*").alias("num_gates"), F.max("value").alias("max_refl"), mean("i").alias("ci"), mean("j").alias("cj"))
    found = found.where(F.col("num_gates") >= least).withColumn("i", F.bround("ci").cast("int")).withColumn("j", F.bround("cj").cast("int"))
    return found.join(gates.select("scan", "i", "j", "lat", "lon"), ["scan", "i", "j"], "left").drop("i", "j")


def merged(cells: DataFrame, group: str) -> DataFrame:
    """Cells of one group as one: gates added, the centroid weighted by gates, boxes united."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("num_gates")) / F.sum("num_gates")).alias(c)
    return cells.groupBy(group).agg(F.sum("num_gates").alias("total"), weighted("lat"), weighted("lon"), F.min("lat_min").alias("lat_min"), F.max("lat_max").alias("lat_max"), F.min("lon_min").alias("lon_min"), F.max("lon_max").alias("lon_max")).withColumnRenamed("total", "num_gates")


def longest_history(cells: DataFrame, id: str = "id", entries: str = "n_history", ordinal: str = "ordinal") -> DataFrame:
    """One row for each id: the one with the longest history, the first of equals."""
    best = W.partitionBy(id).orderBy(F.desc(entries), ordinal)
    return cells.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def united_histories(history: DataFrame, id: str = "id", ts: str = "ts", ordinal: str = "ordinal") -> DataFrame:
    """One entry for each id and time, from the first copy that has it."""
    first = W.partitionBy(id, ts).orderBy(ordinal)
    return history.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def latest_copy(cells: DataFrame, id: str = "id", last: str = "last_ts", ordinal: str = "ordinal") -> DataFrame:
    """One row for each id: the fields of the copy whose history ends last, the first of equals."""
    best = W.partitionBy(id).orderBy(F.desc(last), ordinal)
    return cells.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def match_statistics(pairs: DataFrame) -> DataFrame:
    """Mean, smallest and largest distance in degrees of matched centres."""
    d = F.sqrt(F.pow(F.col("lat0") - F.col("lat1"), 2) + F.pow(F.col("lon0") - F.col("lon1"), 2))
    return pairs.agg(F.avg(d).alias("mean_distance"), F.min(d).alias("min_distance"), F.max(d).alias("max_distance"))
