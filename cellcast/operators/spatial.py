"""Spatial scans, filters and joins: grid windows, gates to polygons, cells to grid footprints.

Boxes meet points and each other in tiles of several levels. A box lies at the level whose tiles are as large as it is,
so it covers four of them at most, whatever else is in the table; points, and smaller boxes, look it up at each level
that exists (ten at most, each four times as wide as the one below). A continent among a million small boxes is four
rows more, and the small ones keep their small tiles.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import geometry, scalars
from ..sources.scratch import cut

#: Bytes up to which the polygon or cell side of a join, dealt out by tile, is broadcast; beyond, both sides are exchanged by tile.
BROADCAST_BYTES = 32 << 20
#: Side of a tile of level 0 in degrees, how many times as wide a level's tiles are as those of the level below, and the last level.
LEAST_TILE, WIDER, LAST = 1e-3, 4, 10
_BOX = ("lat_min", "lat_max", "lon_min", "lon_max")


def window(gates: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Gates within limits, both included, in either order; the predicate reaches the scan of plain columns.

    A file's own longitudes may need turning: `readers.grid` takes limits and filters before it does.
    """
    return gates.where(F.col("lat").between(min(lat), max(lat)) & F.col("lon").between(min(lon), max(lon)))


def window_or_all(gates: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """As window, but an axis without any gate within its limits isn't limited."""
    inside = {"lat": F.col("lat").between(min(lat), max(lat)), "lon": F.col("lon").between(min(lon), max(lon))}
    found = gates.agg(*[F.coalesce(F.max(c), F.lit(False)).alias(k) for k, c in inside.items()]).first()  # one row
    for axis, within in inside.items():
        gates = gates.where(within) if found[axis] else gates
    return gates


def polygons_in(polygons: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Polygons with any vertex of their outer ring in a window given in 0..360; a polygon around it has none."""
    limits = tuple((x + 180) % 360 - 180 for x in lon)
    return polygons.where(geometry.any_vertex_within(F.col("rings")[0], tuple(sorted(lat)), tuple(sorted(limits))))


def _side(level: Column) -> Column:
    return F.lit(LEAST_TILE) * F.pow(F.lit(float(WIDER)), level)


def _level(box: tuple[Column, ...]) -> Column:
    """The lowest level whose tiles are as high and wide as a box (lat_min, lat_max, lon_min, lon_max); the last one for all larger."""
    side = F.least(F.greatest(box[1] - box[0], box[3] - box[2], F.lit(LEAST_TILE)), F.lit(2000.0))
    level = F.ceil(F.log(side / LEAST_TILE) / math.log(WIDER)).cast("int")
    return F.least(F.when(_side(level) < side, level + 1).otherwise(level), F.lit(LAST))  # logarithms may be a bit short


def _tiles(box: tuple[Column, ...], level: Column) -> Column:
    """The tiles of a level that a box covers."""
    span = lambda a, b: F.sequence(_tile(a, level), _tile(b, level))
    return F.flatten(F.transform(span(box[0], box[1]), lambda y: F.transform(span(box[2], box[3]), lambda x: F.struct(y.alias("ty"), x.alias("tx")))))


def _tile(value: Column, level: Column) -> Column:
    """The number of a level's tile; what lies beyond +-1000 degrees counts as there."""
    return F.floor(F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), value)) / _side(level))


def _whole(boxes: DataFrame, box: tuple[Column, ...]) -> DataFrame:
    """Boxes without a missing or inverted limit, with their own level `_own`. Others hold nothing."""
    known = ~F.isnan(box[1]) & ~F.isnan(box[3])  # NaN is above every number
    return boxes.where(known & (box[0] <= box[1]) & (box[2] <= box[3])).withColumn("_own", _level(box))


def _dealt(boxes: DataFrame, box: tuple[Column, ...], level: Column) -> DataFrame:
    """A row of `boxes` for each tile (level, ty, tx) of a level of its own, or of each of an array of levels."""
    rows = boxes.withColumn("level", level).where("level IS NOT NULL")
    return rows.withColumn("tile", F.explode(_tiles(box, F.col("level")))).select("*", "tile.ty", "tile.tx").drop("tile")


def _levels(boxes: DataFrame) -> list[int]:
    """The levels (eleven at most) that boxes lie at."""
    return sorted(r[0] for r in boxes.select("_own").distinct().collect())


def _at_and_above(levels: list[int], above: bool = False) -> Column:
    """For each box a row for every one of `levels` from its own on (or only above it)."""
    return F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k > F.col("_own") if above else k >= F.col("_own")))


def _bytes(rows: DataFrame) -> int:
    """About how many bytes rows take in memory, by their numbers of fields and of array elements."""
    arrays = [f.name for f in rows.schema if isinstance(f.dataType, ArrayType)]
    size = F.lit(16 * len(rows.columns))
    for c in arrays:
        size = size + 64 * F.coalesce(F.size(c), F.lit(0))
    return rows.agg(F.sum(size)).first()[0] or 0


def range_join(points: DataFrame, boxes: DataFrame, small: bool | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Points (by..., lat, lon, ...) with the boxes (by..., lat_min, lat_max, lon_min, lon_max, ...) around them, edges included.

    An equi-join on tiles comes before the exact test, so the work follows the number of matches and of tiles, not the
    product of both sides. The box side is broadcast only if it is small when dealt out by tiles, edges of polygons
    included. Boxes with a missing or inverted limit hold nothing. `by`: columns in which both must be equal.
    """
    box = tuple(F.col(c) for c in _BOX)
    whole = _whole(boxes, box)
    levels = _levels(whole)
    covered = _dealt(whole, box, F.col("_own")).drop("_own")
    if small is None:
        small = _bytes(covered) <= BROADCAST_BYTES
    placed = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    placed = placed.withColumn("ty", _tile(F.col("lat"), F.col("level"))).withColumn("tx", _tile(F.col("lon"), F.col("level")))
    joined = placed.join(F.broadcast(covered) if small else covered, [*by, "level", "ty", "tx"])
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
    return joined.where(inside).drop("level", "ty", "tx")


def overlapping(boxes: DataFrame, keys: tuple[str, ...] = ("scan",)) -> DataFrame:
    """(keys..., a, b), a < b, of boxes (keys..., id, lat_min, lat_max, lon_min, lon_max) of equal keys that share an area.

    Boxes meet in the tiles of the larger one's level; a pair counts in the tile of its common area's lowest corner only.
    """
    box = tuple(F.col(c) for c in _BOX)
    whole = _whole(boxes.select(*keys, "id", *_BOX), box)
    home = _dealt(whole, box, F.col("_own")).select(*keys, "level", "ty", "tx", F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in _BOX])
    guest = _dealt(whole, box, _at_and_above(_levels(whole)))
    near = home.join(guest, [*keys, "level", "ty", "tx"]).where("a <> id AND (level > _own OR a < id) AND a_lat_min < lat_max AND lat_min < a_lat_max AND a_lon_min < lon_max AND lon_min < a_lon_max")
    corner = [_tile(F.greatest(f"a_{c}", c), F.col("level")) for c in ("lat_min", "lon_min")]
    return near.where((F.col("ty") == corner[0]) & (F.col("tx") == corner[1])).select(*keys, F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))


def linked(boxes: DataFrame, keys: tuple[str, ...] = ("scan",)) -> DataFrame:
    """(keys..., a, b) that connect exactly what the pairs of `overlapping` connect, without a pair for every two copies.

    Of boxes with the same keys and limits the one with the smallest id meets the others, and its copies hang on it.
    Boxes without area, which their own copies don't overlap, stay by themselves.
    """
    wide = (F.col("lat_min") < F.col("lat_max")) & (F.col("lon_min") < F.col("lon_max")) & ~F.isnan("lat_max") & ~F.isnan("lon_max")
    same = [*keys, *_BOX]
    rows = boxes.select("id", *same)
    solid = rows.where(wide)
    first = solid.groupBy(*same).agg(F.min("id").alias("a"))
    copies = solid.join(first, same).where("a <> id").select(*keys, "a", F.col("id").alias("b"))
    alone = rows.where(~F.coalesce(wide, F.lit(False)))
    return overlapping(first.withColumnRenamed("a", "id").unionByName(alone), keys).unionByName(copies)


def beside(small: DataFrame, large: DataFrame, km: float, keys: tuple[str, ...] = ("scan",)) -> DataFrame:
    """Rows of `small` (keys..., lat, a box) with those of `large` (keys..., l_ and the box's names) whose box is within `km` of theirs.

    They meet in the tiles that the widened and the other box cover, at the level of the larger of both; a pair comes
    once for each tile that both cover (four at most).
    """
    lat_buffer, lon_buffer = scalars.degree_buffer(F.col("lat"), km)
    wide = (F.col("lat_min") - lat_buffer, F.col("lat_max") + lat_buffer, F.col("lon_min") - lon_buffer, F.col("lon_max") + lon_buffer)
    other = tuple(F.col(f"l_{c}") for c in _BOX)
    a, b = _whole(small, wide), _whole(large, other)
    levels_a, levels_b = _levels(a), _levels(b)
    on = [*keys, "level", "ty", "tx"]
    up = _dealt(a, wide, _at_and_above(levels_b)).drop("_own").join(_dealt(b, other, F.col("_own")).drop("_own"), on)
    down = _dealt(a, wide, F.col("_own")).drop("_own").join(_dealt(b, other, _at_and_above(levels_a, above=True)).drop("_own"), on)
    return up.unionByName(down).where(scalars.beside(tuple(F.col(c) for c in _BOX), other, lat_buffer, lon_buffer)).drop("level", "ty", "tx")


def assign_gates(gates: DataFrame, polygons: DataFrame, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """(keys..., poly_id) of the gates strictly inside a polygon; the first in file order (ordinal) wins.

    Longitudes of polygons may be -180..180. Id 0 assigns nothing, and doesn't hide the next polygon.
    """
    lon = lambda p: F.struct(scalars.wrap_360(p["lon"]).alias("lon"), p["lat"].alias("lat"))
    turned = F.transform("rings", lambda r: F.transform(r, lon))
    boxes = polygons.where("id <> 0 AND size(rings) > 0").select("ordinal", "id", turned.alias("rings"))
    limits = geometry.bounds(F.col("rings")[0])
    boxes = boxes.select("ordinal", "id", geometry.sides(F.col("rings")).alias("sides"), *[c.alias(n) for c, n in zip(limits, ("lat_min", "lat_max", "lon_min", "lon_max"), strict=True)])
    near = range_join(gates.select(*keys, "lat", "lon"), boxes)
    hit = near.where(geometry.within(F.col("sides"), F.col("lon"), F.col("lat")))
    return hit.groupBy(*keys).agg(F.min_by("id", "ordinal").alias("poly_id"))


def footprint_max(cells: DataFrame, gates: DataFrame, products: list[str], unread: Mapping[str, str] | tuple[str, ...] = ()) -> DataFrame:
    """Of each cell ([scan,] id, lat_min, lat_max, lon_min, lon_max) the largest value >= 0 of each product within its box.

    Ids repeat from scan to scan, so where cells have a scan it is part of their key and comes back; where gates have
    one too, only gates of a cell's own scan count. One range join of distinct places with distinct boxes serves all products. A product without a value gives
    NULL and status N/A. `unread` names products that couldn't be used, with their status (see readers.grid_status); a
    plain tuple means DATASET_LOAD_ERROR.
    """
    failed = dict(unread) if isinstance(unread, Mapping) else dict.fromkeys(unread, "DATASET_LOAD_ERROR")
    ids = [c for c in ("scan", "id") if c in cells.columns]
    by = tuple(c for c in ("scan",) if c in cells.columns and c in gates.columns)
    # one row for each place and one for each box, however many values and cells are there
    tops = [F.max(F.when(F.col("product") == p, F.col("value"))).alias(p) for p in products]
    most = gates.where(F.col("value") >= 0).where(F.col("product").isin(products)).groupBy(*by, "lat", "lon").agg(*tops)
    known = cells.select(*ids, *_BOX)
    boxes = cut(known.select(*by, *_BOX).distinct())
    hits = range_join(most, boxes, by=by)
    wide = hits.groupBy(*by, *_BOX).agg(*[F.max(p).alias(p) for p in products])
    out = known.join(wide, [*by, *_BOX], "left")
    return out.select(*ids, *products, *[F.when(F.col(p).isNull(), failed.get(p, "N/A")).alias(f"{p}_status") for p in products])


def footprint(bbox: Column, lat: Column, lon: Column, half: float = 0.01) -> tuple[Column, Column, Column, Column]:
    """Bounds of a cell's outline (lat, lon points), or of a small box at its centre if it has under three points."""
    enough = F.size(bbox) >= 3
    outline = geometry.bounds(bbox)
    box = (lat - half, lat + half, lon - half, lon + half)
    return tuple(F.when(enough, a).otherwise(b) for a, b in zip(outline, box, strict=True))
