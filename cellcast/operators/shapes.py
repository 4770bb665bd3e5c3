"""Outlines: contours of labelled regions, hulls of gates, and fallback boxes for polygons that aren't valid."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry
from . import contours


# types as objects: texts of types can only be read where a session runs
_RING = T.ArrayType(T.StructType().add("lon", "double").add("lat", "double"))
_OVERLAP = T.StructType().add("area", "double").add("percent_a", "double").add("percent_b", "double")


def outlines(labels: DataFrame, gates: DataFrame, step: int = 8) -> DataFrame:
    """(scan, poly_id, bbox) of labels (scan, i, j, poly_id): every step-th point of the contour as (lat, lon).

    Points are taken at the gate that holds them, and left out where there is none. A label without a contour (it
    fills the grid) has no row.
    """
    placed = contours.points(labels, gates, step).join(gates.select("scan", "i", "j", "lat", "lon"), ["scan", "i", "j"])
    ordered = F.sort_array(F.collect_list(F.struct("k", "lat", "lon")))
    return placed.groupBy("scan", "poly_id").agg(F.transform(ordered, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("bbox"))


def extents(labels: DataFrame, gates: DataFrame) -> DataFrame:
    """(scan, poly_id, lat_min, lat_max, lon_min, lon_max) of labelled gates, without Python: the exact box mode."""
    rows = labels.where("poly_id <> 0").join(gates.select("scan", "i", "j", "lat", "lon"), ["scan", "i", "j"])
    return rows.groupBy("scan", "poly_id").agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


def thinned(points: Column, step: int = 8) -> Column:
    """Every step-th element of an array, from the first."""
    return F.filter(points, lambda p, k: k % step == 0)


def _points(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points (lon, lat) of all rings, where each ring begins and how many it has; NULL has none."""
    size = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rings.flatten()
    xy = np.stack([pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat")], 1)
    return xy, np.cumsum(size) - size, size


@F.arrow_udf(T.BooleanType())
def _simple(rings: pa.Array) -> pa.Array:
    xy, first, size = _points(rings)
    out = np.zeros(len(size), bool)
    for group in geometry.same_sizes(size):
        out[group] = geometry.are_simple(geometry.rings_at(xy, first[group], int(size[group[0]])))
    return pa.array(out)


def cell_polygon(bbox: Column, lat: Column, lon: Column, min_size: float = 0.0) -> Column:
    """A cell's outline if it is a valid polygon, else a box around its centre, else NULL."""
    half = max(min_size, 0.01)
    box = geometry.box_points(lat - half, lat + half, lon - half, lon + half)
    turned = F.transform(bbox, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return F.when((F.size(bbox) >= 3) & _simple(turned), turned).when(lat.isNotNull() & lon.isNotNull(), box)


@F.pandas_udf(_RING)
def hull(points: pd.Series) -> pd.Series:
    """Convex hull of an array of (lon, lat): the alpha shape of gates whose spacing is small against 1 / alpha."""
    return pd.Series([[{"lon": float(x), "lat": float(y)} for x, y in geometry.convex_hull(np.array([(p["lon"], p["lat"]) for p in r]).reshape(-1, 2))] for r in points])


@F.arrow_udf(T.ArrayType(_RING))
def repair(rings: pa.Array) -> pa.Array:
    """Rings that don't cross of a ring of (lon, lat) that may: parts counter-clockwise, holes clockwise; NULL and no area: none."""
    found = geometry.all_repaired(*_points(rings))
    parts = [r for ring in found for r in ring]
    at = lambda x: pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x], dtype=np.int64)]).astype(np.int32))
    xy = np.array([p for r in parts for p in r], float).reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["lon", "lat"])
    return pa.ListArray.from_arrays(at(found), pa.ListArray.from_arrays(at(parts), points))


@F.arrow_udf(_OVERLAP)
def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """Overlap of two rings of (lon, lat): square degrees and the percentages of both."""
    found = geometry.overlap_percents(*_points(a), *_points(b))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], _OVERLAP.names)
