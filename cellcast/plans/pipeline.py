"""Whole flows as DataFrame functions: detection, tracking, integration, and the older detection by regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attributes, cells, grow, history, match, shapes, spatial
from ..sources.readers import INTEGRATED
from ..sources.scratch import cut

THRESHOLD, STEP, ROUNDS = 40.0, 8, 100


def detect(gates: DataFrame, polygons: DataFrame, lat: tuple[float, float], lon: tuple[float, float], threshold: float = THRESHOLD, step: int = STEP, outline: bool = True) -> DataFrame:
    """Cells of a scan: gates in the window, assigned to polygons, grown, outlined and summarised."""
    window = cut(spatial.window(gates, lat, lon).select("scan", "i", "j", "lat", "lon", "value"))
    near = spatial.polygons_in(polygons, lat, lon)
    labels = spatial.assign_gates(window, near, ("scan", "i", "j"))
    grown = cut(grow.expand(window, labels, threshold, ROUNDS))
    found = cells.summarise(grown, window)
    if not outline:
        return found
    lines = shapes.outlines(grown, window, step)
    return found.join(lines.withColumnRenamed("poly_id", "id"), ["scan", "id"])


def snapshot(found: DataFrame, ts) -> DataFrame:
    """A scan's cells as history entries."""
    return found.select(F.col("id").alias("cell_id"), F.lit(ts).cast("timestamp_ntz").alias("ts"), "max_refl", "num_gates", "lat", "lon")


def track(old_cells: DataFrame, old_history: DataFrame, new_cells: DataFrame, ts) -> tuple[DataFrame, DataFrame]:
    """(cells, history with vectors) after a scan. History: cell_id, seq, ts, max_refl, num_gates, lat, lon."""
    entries = snapshot(new_cells, ts)
    tables = new_cells.withColumnRenamed("id", "cell_id")
    kept_cells, kept = history.upsert(old_cells, tables, old_history, entries.withColumn("seq", F.lit(0)).select(*old_history.columns))
    length = old_history.groupBy("cell_id").agg((F.max("seq") + 1).alias("seq"))
    more = entries.join(length, "cell_id").select(*old_history.columns)
    whole = history.kept_entries(kept.unionByName(more), ["max_refl", "num_gates", "lat", "lon"])
    return kept_cells, history.vectors(whole)


def integrate(found: DataFrame, gates: DataFrame, polygons: DataFrame, products: list[str] | None = None) -> DataFrame:
    """Cells ([scan,] id, lat, lon, bbox, ...) with the footprint maxima of all products and the polygon attributes.

    By default the products are the keys of the integrated grids. Where cells have a scan, as `detect` returns them, it
    is part of their key; gates and polygons that have one count for cells of their scan only.
    """
    products = products or [key for *_, key in INTEGRATED]
    limits = spatial.footprint(F.col("bbox"), F.col("lat"), F.col("lon"))
    ids = [c for c in ("scan", "id") if c in found.columns]
    boxes = found.select(*ids, *[c.alias(n) for c, n in zip(limits, ("lat_min", "lat_max", "lon_min", "lon_max"), strict=True)])
    return attributes.attributes(found.join(spatial.footprint_max(boxes, gates, products), ids, "left"), polygons)


def detect_regions(gates: DataFrame, least: int = 25) -> DataFrame:
    """The older detection: competing regions around strong cores, summarised, with hulls, merged and thinned out."""
    regions = cut(grow.competing_regions(gates))
    summary = cells.core_summary(regions, gates, least=least)
    points = regions.join(gates.select("scan", "i", "j", "lat", "lon"), ["scan", "i", "j"]).groupBy("scan", "region").agg(
        shapes.hull(F.sort_array(F.collect_list(F.struct("lon", "lat")))).alias("ring"), *[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))]
    )
    own = summary.join(points, ["scan", "region"]).select("scan", F.col("region").cast("int").alias("ordinal"), F.col("region").alias("id"), "num_gates", "lat", "lon", "lat_min", "lat_max", "lon_min", "lon_max", "max_refl", "ring")
    return match.covered(match.merge_cells(own))


def match_scan(tracked: DataFrame, tracked_history: DataFrame, found: DataFrame, ts) -> tuple[DataFrame, DataFrame]:
    """(cells, history with all vectors) after matching a scan's cells to tracked ones by position and size.

    tracked: ordinal, id, num_gates, max_refl, lat, lon, one row for each copy of a cell; the copy with the longest
    history counts. Tracked cells without a match stay, new ones are added. found has one scan and the same columns.
    """
    fields = ["num_gates", "max_refl", "lat", "lon"]
    own = tracked.join(tracked_history.groupBy(F.col("cell_id").alias("id")).agg(F.count("*").alias("n_history")), "id", "left").fillna(0, ["n_history"])
    own = cut(cells.longest_history(own).select("id", *fields))
    last = history.latest_position(own.select(F.col("id").alias("cell_id")), tracked_history)
    old = cut(last.select(F.lit("s").alias("scan"), F.col("cell_id").alias("id"), *fields))
    new = cut(found.select(F.lit("s").alias("scan"), "id", *fields))
    pairs = cut(match.best_matches(old, new).select("old_id", "new_id"))
    after = match.apply_matches(own, old, new, pairs, fields)
    at = F.lit(ts).cast("timestamp_ntz").alias("ts")
    named = new.join(pairs.select(F.col("new_id").alias("id"), "old_id"), "id", "left").select(F.coalesce("old_id", "id").alias("cell_id"), at, *fields)
    entries = history.upsert_entries(tracked_history.select("cell_id", "ts", *fields), named)
    return after, history.vectors(entries, every=True, metres=history.scalars.LEGACY_DEGREE_M, order="ts")
