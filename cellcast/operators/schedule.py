"""Which files and minutes to process: lookups, common minutes, as-of picks, completeness and retention."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars


def lookup(files: DataFrame, until: Column, back: timedelta | Column, most: int | None = 10) -> DataFrame:
    """Files (product, url, ts) with ts from `back` (a span or a time) to `until`, both included; the newest `most` of each product."""
    first = until - F.lit(back) if isinstance(back, timedelta) else back
    found = files.where(F.col("ts").isNotNull() & F.col("ts").between(first, until))
    if not most:
        return found
    newest = W.partitionBy("product").orderBy(F.desc("ts"), "url")
    return found.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def nth_newest(files: DataFrame, n: int) -> DataFrame:
    """The n-th newest file (from 0) of each product that has so many."""
    newest = W.partitionBy("product").orderBy(F.desc("ts"), "url")
    return files.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == n + 1).drop("_n")


def newest_files(files: DataFrame, n: int, by: str = "modified") -> DataFrame:
    """The n newest files by modification time, oldest first, index files left out. Fewer than n is an error."""
    found = files.where(~F.col("url").endswith(".idx")).orderBy(F.desc(by), "url").limit(n)
    enough = F.when(F.count("*").over(W.partitionBy(F.lit(1))) < n, F.raise_error(F.lit(f"fewer than {n} files"))).otherwise(F.lit(True).cast("boolean"))
    return found.withColumn("_ok", enough).where("_ok").drop("_ok").orderBy(by, F.desc("url"))


def minutes(files: DataFrame, unit: str = "minute") -> DataFrame:
    """Distinct minutes (or hours) of each product."""
    return files.where("ts IS NOT NULL").select("product", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("minute")).distinct()


def common_minutes(files: DataFrame, unit: str = "minute") -> DataFrame:
    """Minutes that every product with any file has. Products without files don't count."""
    seen = minutes(files, unit)
    total = seen.select("product").distinct().agg(F.count("*").alias("total"))
    return seen.groupBy("minute").agg(F.count("*").alias("n")).join(F.broadcast(total), F.col("n") == F.col("total")).select("minute")  # one row


def latest_common(files: DataFrame, unit: str = "minute") -> DataFrame:
    return common_minutes(files, unit).agg(F.max("minute").alias("minute"))


def as_of(files: DataFrame, times: DataFrame, back: timedelta = timedelta(hours=6), parts: int = 16) -> DataFrame:
    """(product, t, url, ts): for each time the newest file of each product not after it and not older than `back`.

    An exact match is the newest possible, so it wins; of files of one time the last url does. Time is cut into buckets,
    `parts` to a span of `back`. Within a bucket of a product files and times stand in one order and the last file is
    carried along; what came in earlier buckets is each bucket's newest file, handed on to the buckets it can reach. So
    the work follows the files and the answers, not files by times, and a product with most files is many buckets.
    """
    span = max(1, int(back.total_seconds() * 1e6) // parts)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: ((micros(c) - F.pmod(micros(c), F.lit(span))) / span).cast("long")
    placed = files.where("ts IS NOT NULL").select("product", bucket("ts").alias("k"), micros("ts").alias("at"), F.struct("ts", "url").alias("file"))
    newest = placed.groupBy("product", "k").agg(F.max("file").alias("file"))
    reach = newest.select("product", F.col("k").alias("k0"), F.explode(F.sequence(F.col("k"), F.col("k") + parts + 1)).alias("k"), "file")
    carried = reach.groupBy("product", "k").agg(F.max(F.when(F.col("k0") < F.col("k"), F.col("file"))).alias("before"))
    asked = times.where("t IS NOT NULL").select("t").distinct().select("t", bucket("t").alias("k"), micros("t").alias("at")).join(carried, "k")
    both = placed.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    so_far = W.partitionBy("product", "k").orderBy("at", "asks", "file").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("own", F.last("file", ignorenulls=True).over(so_far)).where("asks").withColumn("b", F.coalesce("own", "before"))
    return found.where(F.col("b.ts") >= F.col("t") - F.lit(back)).select("product", "t", "b.url", "b.ts")


def hour_or_before(files: DataFrame, times: DataFrame) -> DataFrame:
    """(t, url, hour): the file of a time's hour, else of the hour before."""
    hours = files.select(scalars.to_hour(F.col("ts")).alias("hour"), "url").groupBy("hour").agg(F.min("url").alias("url"))
    asked = times.select("t", F.explode(F.array(scalars.to_hour(F.col("t")), scalars.to_hour(F.col("t") - F.expr("INTERVAL 1 HOUR")))).alias("hour"))
    return asked.join(hours, "hour").groupBy("t").agg(F.max(F.struct("hour", "url")).alias("b")).select("t", "b.url", "b.hour")


def exact_hour(files: DataFrame, times: DataFrame) -> DataFrame:
    """(t, url) of the file of a time's very hour."""
    hours = files.select(scalars.to_hour(F.col("ts")).alias("hour"), "url").groupBy("hour").agg(F.min("url").alias("url"))
    return times.select("t", scalars.to_hour(F.col("t")).alias("hour")).join(hours, "hour").select("t", "url")


def updates(remote: DataFrame, local: DataFrame, products: DataFrame) -> DataFrame:
    """(product, has_update): whether the newest remote file is newer than the newest local one.

    Without remote files there is none; without local ones, or none with a time, there is.
    """
    r = remote.groupBy("product").agg(F.max("ts").alias("r"))
    mine = local.groupBy("product").agg(F.max("ts").alias("l"))
    joined = products.select("product").distinct().join(r, "product", "left").join(mine, "product", "left")
    return joined.select("product", F.when(F.col("r").isNull(), False).when(F.col("l").isNull(), True).otherwise(F.col("r") > F.col("l")).alias("has_update"))


def all_available(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.bool_and("has_update"), F.lit(True)).alias("all_available"))


def complete_scans(sweeps: DataFrame, heights: int, newest: int = 5) -> DataFrame:
    """(ts) of the newest of the `newest` last times at which all heights exist."""
    last = sweeps.groupBy("ts").agg(F.countDistinct("height").alias("n")).orderBy(F.desc("ts")).limit(newest)
    return last.where(F.col("n") == heights).agg(F.max("ts").alias("ts"))


def completeness(sweeps: DataFrame, expected: int, least: float = 0.8) -> DataFrame:
    """(ts, share, enough): how much of the expected heights each time has."""
    share = (F.countDistinct("height") / expected).alias("share")
    return sweeps.groupBy("ts").agg(share).withColumn("enough", F.col("share") >= least)


def retained(files: DataFrame, now: Column, minutes: int = 20, by: str = "modified") -> DataFrame:
    """Files that aren't older than some minutes."""
    return files.where(F.col(by) >= now - F.lit(timedelta(minutes=minutes)))
