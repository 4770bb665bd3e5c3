"""All queries of the engine by name, with their DuckDB equivalents."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import attributes, cells, contours, grow, history, match, schedule, shapes, spatial
from ..sources import gridfiles, readers, writers
from ..sources.scratch import cut, place
from ..streaming import jobs
from . import pipeline, proxies
from .proxies import read, sql, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
col = F.col


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


G, SW, PR, SH, CE, HI, FI = (sql(n) for n in ("gates", "sweeps", "products", "shapes", "cells", "history", "files"))
LAT, LON = (25.2, 26.5), (280.1, 280.8)
_INSIDE = "g.i > s.i0 AND g.j > s.j0 AND g.i < s.i0 + s.hi AND g.j < s.j0 + s.hj AND (NOT s.triangle OR (g.i - s.i0) / s.hi + (g.j - s.j0) / s.hj < 1)"
_LABELS = f"(SELECT g.scan, g.i, g.j, arg_min(s.id, s.ordinal) AS poly_id FROM {G} g JOIN {SH} s ON s.id <> 0 AND {_INSIDE} GROUP BY ALL)"


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gates = view(spark, sf_dir, "gates")
    return gates, spatial.assign_gates(gates, proxies.polygons(spark, sf_dir), ("scan", "i", "j"))


# --- scans, filters, gates to polygons -------------------------------------------------------------------------------


@query(f"SELECT i, j, round(lat, 6) AS lat, round(lon, 6) AS lon, value FROM {G} WHERE lat BETWEEN {LAT[0]} AND {LAT[1]} AND lon BETWEEN {LON[0]} AND {LON[1]} AND value >= 40")
def gates_window(spark, sf_dir):
    return spatial.window(view(spark, sf_dir, "gates"), LAT, LON).where("value >= 40").select("i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "value")


@query(f"SELECT kind, TIMESTAMP '2024-01-20 12:00:00' AS ts, i, j, round(lat, 6) AS lat, round(lon, 6) AS lon, value FROM {G}, (VALUES ('grib'), ('grib-png'), ('netcdf')) k(kind) WHERE lat BETWEEN {LAT[0]} AND {LAT[1]} AND lon BETWEEN {LON[0]} AND {LON[1]} AND value IS NOT NULL")
def grid_files(spark, sf_dir):
    """The grid written as GRIB2, packed and as pictures, and as NetCDF, and a window of each file read back."""
    out = None
    for kind in ("grib", "grib-png", "netcdf"):
        path = place(spark)
        gridfiles.write(view(spark, sf_dir, "gates"), path, kind, 25.0, 280.0, 0.01, _NOW).count()
        # limits a hair wider than the window, as axes come from steps
        found = gridfiles.read(spark, path, (LAT[0] - 1e-7, LAT[1] + 1e-7), (LON[0] - 1e-7, LON[1] + 1e-7)).where("value IS NOT NULL")
        found = found.select(F.lit(kind).alias("kind"), "ts", "i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("value", 1).alias("value"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"SELECT count(*) AS n FROM {G} WHERE lat BETWEEN {LAT[0]} AND {LAT[1]}")
def gates_window_or_all(spark, sf_dir):
    return spatial.window_or_all(view(spark, sf_dir, "gates"), LAT, (10.0, 20.0)).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n_all, count(value) AS n_valid, count(*) FILTER (value >= 40) AS n_strong, count(*) FILTER (value >= 0) AS n_positive, max(value) AS top FROM {G}")
def gate_counts(spark, sf_dir):
    over = lambda x: F.count(F.when(col("value") >= x, 1))
    return view(spark, sf_dir, "gates").agg(F.count("*").alias("n_all"), F.count("value").alias("n_valid"), over(40).alias("n_strong"), over(0).alias("n_positive"), F.max("value").alias("top"))


@query(f"""SELECT id FROM {SH} s WHERE
  (i0 BETWEEN 20 AND 150 AND j0 BETWEEN 10 AND 80) OR (i0 + hi BETWEEN 20 AND 150 AND j0 BETWEEN 10 AND 80) OR (i0 BETWEEN 20 AND 150 AND j0 + hj BETWEEN 10 AND 80)
  OR (NOT triangle AND i0 + hi BETWEEN 20 AND 150 AND j0 + hj BETWEEN 10 AND 80)""")
def polygons_in_window(spark, sf_dir):
    return spatial.polygons_in(proxies.polygons(spark, sf_dir), LAT, LON).select("id")


@query(f"SELECT i, j, poly_id FROM {_LABELS}")
def assigned_gates(spark, sf_dir):
    return _labels(spark, sf_dir)[1].select("i", "j", "poly_id")


_SUMMARY = """SELECT {key} AS id, count(*) AS num_gates, max(value) AS max_refl, round(sum(lat * exp(value - top)) / sum(CASE WHEN value IS NOT NULL THEN exp(value - top) END), 6) AS lat,
  round(sum(lon * exp(value - top)) / sum(CASE WHEN value IS NOT NULL THEN exp(value - top) END), 6) AS lon FROM (SELECT *, max(value) OVER (PARTITION BY {key}) AS top FROM {rows}) GROUP BY {key}"""


@query(_SUMMARY.format(key="poly_id", rows=f"{_LABELS} JOIN {G} USING (scan, i, j)"))
def cell_summary(spark, sf_dir):
    gates, labels = _labels(spark, sf_dir)
    return cells.summarise(labels, gates).select("id", "num_gates", "max_refl", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"SELECT DISTINCT poly_id FROM {_LABELS} WHERE poly_id <> 0")
def distinct_labels(spark, sf_dir):
    return _labels(spark, sf_dir)[1].where("poly_id <> 0").select("poly_id").distinct()


_BOX = "id, lat - (2 + id % 3) * 5e-3 AS lat_min, lat + (2 + id % 3) * 5e-3 AS lat_max, lon - (2 + id % 4) * 5e-3 AS lon_min, lon + (2 + id % 4) * 5e-3 AS lon_max"


@query(f"""SELECT b.id, max(value) FILTER (product = 'p0') AS p0, max(value) FILTER (product = 'p1') AS p1, max(value) FILTER (product = 'p2') AS p2,
  CASE WHEN p0 IS NULL THEN 'N/A' END AS p0_status, CASE WHEN p1 IS NULL THEN 'N/A' END AS p1_status, CASE WHEN p2 IS NULL THEN 'N/A' END AS p2_status
  FROM (SELECT {_BOX} FROM {CE}) b LEFT JOIN {PR} g ON value >= 0 AND product IN ('p0', 'p1', 'p2') AND g.lat BETWEEN lat_min AND lat_max AND g.lon BETWEEN lon_min AND lon_max GROUP BY b.id""")
def footprint_max(spark, sf_dir):
    return spatial.footprint_max(view(spark, sf_dir, "cells").selectExpr(*_split(_BOX)), view(spark, sf_dir, "products"), ["p0", "p1", "p2"])


def _split(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


@query(f"SELECT i, j, max(value) AS value FROM {SW} GROUP BY i, j")
def composite(spark, sf_dir):
    return cells.composite(view(spark, sf_dir, "sweeps")).select("i", "j", "value")


# --- growth and shapes ------------------------------------------------------------------------------------------------


def _grown_sql(rounds: int, labels: str = _LABELS) -> str:
    parts = [f"WITH g AS MATERIALIZED (SELECT i, j, value FROM {G}), r0 AS MATERIALIZED (SELECT i, j, poly_id, 0 AS r FROM {labels})"]
    for k in range(1, rounds + 1):
        near = " UNION ALL ".join(f"SELECT i {di} AS i, j {dj} AS j, poly_id FROM r{k - 1} WHERE r = {k - 1} AND poly_id > 0" for di, dj in (("+ 1", ""), ("- 1", ""), ("", "+ 1"), ("", "- 1")))
        parts.append(f"r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT n.i, n.j, max(n.poly_id), {k} FROM ({near}) n JOIN g ON g.i = n.i AND g.j = n.j AND g.value >= 40 WHERE NOT EXISTS (SELECT 1 FROM r{k - 1} o WHERE o.i = n.i AND o.j = n.j) GROUP BY n.i, n.j)")
    return ", ".join(parts) + f" SELECT i, j, poly_id FROM r{rounds}"


@query(_grown_sql(4))
def grown_labels_4_rounds(spark, sf_dir):
    gates, labels = _labels(spark, sf_dir)
    return grow.expand(gates, labels, rounds=4, tile=64).select("i", "j", "poly_id")


@query(_grown_sql(100))
def grown_labels(spark, sf_dir):
    gates, labels = _labels(spark, sf_dir)
    return grow.expand(gates, labels).select("i", "j", "poly_id")


@query(f"""WITH RECURSIVE g AS MATERIALIZED (SELECT i, j, CAST(i AS BIGINT) * 2097152 + j AS n FROM {G} WHERE value >= 60),
  e AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM g a JOIN g b ON (b.i = a.i AND b.j IN (a.j - 1, a.j + 1)) OR (b.j = a.j AND b.i IN (a.i - 1, a.i + 1))),
  r(n, root) AS (SELECT n, n FROM g UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.n AND r.root < e.b)
  SELECT CAST(n // 2097152 AS INT) AS i, CAST(n % 2097152 AS INT) AS j, CAST(min(root) // 2097152 AS INT) AS root_i, CAST(min(root) % 2097152 AS INT) AS root_j FROM r GROUP BY n""")
def strong_components(spark, sf_dir):
    return grow.components(view(spark, sf_dir, "gates"), 60.0, tile=64).select("i", "j", "root_i", "root_j")


def _competing_sql(rounds: int) -> str:
    """Components of strong gates by recursion, then rounds of claims; a round without claims leaves the rest empty."""
    parts = [f"WITH RECURSIVE g AS MATERIALIZED (SELECT i, j, value, CAST(i AS BIGINT) * 2097152 + j AS n FROM {G} WHERE value >= 40)"]
    parts.append("s AS MATERIALIZED (SELECT * FROM g WHERE value >= 50), e AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM s a JOIN s b ON (b.i = a.i AND b.j IN (a.j - 1, a.j + 1)) OR (b.j = a.j AND b.i IN (a.i - 1, a.i + 1)))")
    parts.append("c(n, root) AS (SELECT n, n FROM s UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.n AND c.root < e.b), k AS MATERIALIZED (SELECT n, min(root) AS root FROM c GROUP BY n)")
    parts.append("r0 AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY root) AS region, n // 2097152 AS i, n % 2097152 AS j, 0 AS r FROM k)")
    for t in range(1, rounds + 1):
        near = f"SELECT DISTINCT o.region, o.i + d.x AS i, o.j + f.x AS j FROM r{t - 1} o, (VALUES (-1), (0), (1)) d(x), (VALUES (-1), (0), (1)) f(x) WHERE o.r = {t - 1}"
        parts.append(f"r{t} AS MATERIALIZED (SELECT * FROM r{t - 1} UNION ALL SELECT n.region, n.i, n.j, {t} FROM ({near}) n JOIN g ON g.i = n.i AND g.j = n.j WHERE NOT EXISTS (SELECT 1 FROM r{t - 1} o WHERE o.i = n.i AND o.j = n.j))")
    return ", ".join(parts) + f" SELECT region, i, j FROM r{rounds}"


@query(_competing_sql(100))
def competing_regions(spark, sf_dir):
    return grow.competing_regions(view(spark, sf_dir, "gates"), tile=64).select("region", "i", "j")


@query(f"""WITH l AS (SELECT i, j, value, i // 10 * 10 + j // 10 AS region FROM {G} WHERE value IS NOT NULL),
  s AS (SELECT region, count(*) AS num_gates, max(value) AS max_refl, coalesce(sum(i * value) FILTER (value >= 50) / sum(value) FILTER (value >= 50), avg(i)) AS ci,
  coalesce(sum(j * value) FILTER (value >= 50) / sum(value) FILTER (value >= 50), avg(j)) AS cj FROM l GROUP BY region HAVING count(*) >= 25)
  SELECT region, num_gates, max_refl, round(ci, 6) AS ci, round(cj, 6) AS cj FROM s""")
def region_summary(spark, sf_dir):
    gates = view(spark, sf_dir, "gates")
    regions = gates.where("value IS NOT NULL").selectExpr("scan", "i", "j", "i div 10 * 10 + j div 10 AS region")
    return cells.core_summary(regions, gates).select("region", "num_gates", "max_refl", F.round("ci", 6).alias("ci"), F.round("cj", 6).alias("cj"))


@query(f"SELECT poly_id, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max FROM {_LABELS} JOIN {G} USING (scan, i, j) GROUP BY poly_id")
def label_extents(spark, sf_dir):
    gates, labels = _labels(spark, sf_dir)
    return shapes.extents(labels, gates).select("poly_id", *[F.round(c, 6).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")])


@query()
def label_outlines(spark, sf_dir):
    gates, labels = _labels(spark, sf_dir)
    return shapes.outlines(labels, gates).select("poly_id", "bbox")


def _outline_sql(step: int) -> str:
    """Segments of all squares of gates, then a walk along them from every node that ends where it meets a smaller one."""
    corners = " UNION ALL ".join(f"SELECT poly_id, i - {di} AS r, j - {dj} AS c, {bit} AS bit FROM l" for di, dj, bit in ((0, 0, 1), (0, 1, 2), (1, 1, 4), (1, 0, 8)))
    side = "(VALUES (0, 0, 1), (1, 1, 2), (2, 2, 1), (3, 1, 0))"
    return f"""WITH RECURSIVE l AS MATERIALIZED (SELECT * FROM {_LABELS} WHERE poly_id <> 0), z AS (SELECT max(i) AS mi, max(j) AS mj FROM {G}),
  q AS (SELECT poly_id, r, c, sum(bit)::INT AS m FROM ({corners}), z WHERE r >= 0 AND c >= 0 AND r < mi AND c < mj GROUP BY poly_id, r, c),
  s AS MATERIALIZED (SELECT poly_id, (2 * r + a.dr) * 2097152 + 2 * c + a.dc AS f, arg_min((2 * r + b.dr) * 2097152 + 2 * c + b.dc, (a.k - b.k + 4) % 4) AS t
    FROM q, {side} a(k, dr, dc), {side} b(k, dr, dc) WHERE (m >> a.k) & 1 = 1 AND (m >> ((a.k + 1) % 4)) & 1 = 0 AND (m >> b.k) & 1 = 0 AND (m >> ((b.k + 1) % 4)) & 1 = 1 GROUP BY poly_id, r, c, a.k, a.dr, a.dc),
  w(poly_id, start, free, node, k) AS (SELECT poly_id, f, NOT EXISTS (SELECT 1 FROM s o WHERE o.poly_id = s.poly_id AND o.t = s.f), f, 0 FROM s
    UNION ALL SELECT w.poly_id, w.start, w.free, s.t, w.k + 1 FROM w JOIN s ON s.poly_id = w.poly_id AND s.f = w.node WHERE (w.k = 0 OR w.node <> w.start) AND (w.free OR w.node >= w.start)),
  n AS (SELECT poly_id, start, free, max(k) AS n FROM w GROUP BY ALL HAVING free OR arg_max(node, k) = start AND max(k) > 0),
  b AS (SELECT poly_id, start FROM n QUALIFY row_number() OVER (PARTITION BY poly_id ORDER BY n DESC, free DESC, start) = 1)
  SELECT poly_id, CAST(k AS BIGINT) AS k, CAST(node // 2097152 // 2 AS INT) AS i, CAST(node % 2097152 // 2 AS INT) AS j FROM w JOIN b USING (poly_id, start) WHERE k % {step} = 0"""


@query(_outline_sql(2))
def outline_points(spark, sf_dir):
    """Every second point of all labels' contours, by tiles so small that most lines cross some."""
    gates, labels = _labels(spark, sf_dir)
    return contours.points(labels, gates, 2, tile=8).select("poly_id", "k", "i", "j")


@query(f"SELECT id, CASE WHEN triangle THEN round(hi * hj / 2 * 1e-4, 9) ELSE round(hi * hj * 1e-4, 9) END AS square_degrees FROM {SH}")
def polygon_areas(spark, sf_dir):
    return proxies.polygons(spark, sf_dir).select("id", F.round(geometry.area_square_degrees(col("rings")[0]), 9).alias("square_degrees"))


@query(f"SELECT id, round(i0 * 1e-2 + 25, 6) AS lat_min, round((i0 + hi) * 1e-2 + 25, 6) AS lat_max, round(j0 * 1e-2 - 80, 6) AS lon_min, round((j0 + hj) * 1e-2 - 80, 6) AS lon_max, CASE WHEN triangle THEN 3 ELSE 4 END AS corners FROM {SH}")
def polygon_boxes(spark, sf_dir):
    names = ("lat_min", "lat_max", "lon_min", "lon_max")
    limits = geometry.bounds(col("rings")[0])
    return proxies.polygons(spark, sf_dir).select("id", *[F.round(c, 6).alias(n) for c, n in zip(limits, names, strict=True)], F.size(col("rings")[0]).alias("corners"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 4 ELSE 3 END AS corners FROM {CE}")
def cell_outlines(spark, sf_dir):
    """A triangle where there is one, a box around the centre for cells with two points."""
    p = lambda a, b: F.struct((col("lat") + a).alias("lat"), (col("lon") + b).alias("lon"))
    bbox = F.when(col("id") % 3 == 0, F.array(p(0, 0), p(0, 1))).otherwise(F.array(p(0, 0), p(0, 1), p(1, 0)))
    return view(spark, sf_dir, "cells").select("id", F.size(shapes.cell_polygon(bbox, col("lat"), col("lon"))).alias("corners"))


_TIE = "(1 + id % 5) * 1e-2 AS w, (1 + id % 7) * 1e-2 AS h, 1 - id % 3 * 5e-1 AS f"


@query(f"SELECT id, 2 AS parts, round(w * h / 2, 9) AS whole, round(w * h / 4 * (1 + f * f), 9) AS common, round(50 * (1 + f * f), 4) AS percent_a, round(25 * (1 + f * f), 4) AS percent_b FROM (SELECT id, {_TIE} FROM {CE})")
def crossed_rings(spark, sf_dir):
    """Bow ties at all cells, repaired, and their overlaps with boxes that begin at their left side, a quarter or the middle."""
    # a small file is read by few tasks, but its rings are work for all
    c = view(spark, sf_dir, "cells").selectExpr("id", "lat", "lon", *_split(_TIE)).repartition(4 * spark.sparkContext.defaultParallelism, "id")
    p = lambda x, y: F.struct((col("lon") + col("w") * x).alias("lon"), (col("lat") + col("h") * y).alias("lat"))
    shift = (1 - col("f")) / 2
    c = c.select("id", F.array(p(0, 0), p(1, 1), p(1, 0), p(0, 1)).alias("tie"), F.array(p(shift, 0), p(shift + 1, 0), p(shift + 1, 1), p(shift, 1)).alias("box"))
    c = c.select("id", shapes.repair("tie").alias("parts"), shapes.overlap("tie", "box").alias("o"))
    whole = F.aggregate(F.transform("parts", geometry.area_square_degrees), F.lit(0.0), lambda s, x: s + x)
    return c.select("id", F.size("parts").alias("parts"), F.round(whole, 9).alias("whole"), F.round("o.area", 9).alias("common"), F.round("o.percent_a", 4).alias("percent_a"), F.round("o.percent_b", 4).alias("percent_b"))


@query("SELECT i.x AS i, j.x AS j, round(25 + i.x * 5e-1, 6) AS lat, round(280 + j.x * 5e-1, 6) AS lon FROM (SELECT unnest(range(40)) AS x) i, (SELECT unnest(range(30)) AS x) j")
def dense_grid(spark, sf_dir):
    axes = spark.createDataFrame([(25.0, 280.0, 0.5, 40, 30)], "lat0 double, lon0 double, step double, n_lat int, n_lon int")
    return readers.dense_grid(axes).select(col("i").cast("long"), col("j").cast("long"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"SELECT cell_id, seq FROM (SELECT cell_id, seq, row_number() OVER (PARTITION BY cell_id ORDER BY seq) - 1 AS k FROM {HI}) WHERE k % 8 = 0")
def every_eighth(spark, sf_dir):
    points = view(spark, sf_dir, "history").groupBy("cell_id").agg(F.sort_array(F.collect_list("seq")).alias("p"))
    return points.select("cell_id", F.explode(shapes.thinned(col("p"))).alias("seq"))


# --- scalars -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, x, CASE WHEN x < 0 THEN x + 360 ELSE x END AS to_360, CASE WHEN x > 180 THEN x - 360 ELSE x END AS to_180, (x + 180) - 360 * floor((x + 180) / 360) - 180 AS half_open FROM (SELECT o_orderkey, CAST(o_orderkey % 720 - 360 AS DOUBLE) AS x FROM orders)")
def longitudes(spark, sf_dir):
    x = read(spark, sf_dir, "orders").select("o_orderkey", (col("o_orderkey") % 720 - 360).cast("double").alias("x"))
    return x.select("o_orderkey", "x", scalars.lon_360(col("x")).alias("to_360"), scalars.lon_180(col("x")).alias("to_180"), scalars.wrap_180(col("x")).alias("half_open"))


_PAIR = f"SELECT a.id AS a, b.id AS b, a.lat AS lat0, a.lon AS lon0, b.lat AS lat1, b.lon AS lon1, a.num_gates AS g0, b.num_gates AS g1, a.max_refl AS r0, b.max_refl AS r1 FROM {CE} a JOIN {CE} b ON b.id = a.id + 1"
_HAV = "2 * 6371 * atan2(sqrt(h), sqrt(1 - h))"


def _pairs(spark, sf_dir):
    c = view(spark, sf_dir, "cells")
    a = c.select(*[col(x).alias(y) for x, y in (("id", "a"), ("lat", "lat0"), ("lon", "lon0"), ("num_gates", "g0"), ("max_refl", "r0"))])
    b = c.select(*[col(x).alias(y) for x, y in (("id", "b"), ("lat", "lat1"), ("lon", "lon1"), ("num_gates", "g1"), ("max_refl", "r1"))])
    return a.join(b, col("b") == col("a") + 1)


@query(f"""SELECT a, b, round({_HAV}, 6) AS km, round(abs(g0 - g1) / 97e0, 9) AS gates, round(CASE WHEN {_HAV} > 10 THEN 1000 ELSE 5e-1 * {_HAV} / 10 + 3e-1 * abs(g0 - g1) / 97 + 2e-1 * abs(r0 - r1) / 64 END, 6) AS cost,
  round(5e-1 * least(sqrt((lat0 - lat1) ^ 2 + (lon0 - lon1) ^ 2) / 10, 1) + 3e-1 * abs(g0 - g1) / 97 + 2e-1 * abs(r0 - r1) / 64, 9) AS degree_cost
  FROM (SELECT *, sin(radians(lat1 - lat0) / 2) ^ 2 + cos(radians(lat0)) * cos(radians(lat1)) * sin(radians(lon1 - lon0) / 2) ^ 2 AS h FROM ({_PAIR}))""")
def distances_and_costs(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    km = scalars.haversine_km(*[col(x) for x in ("lat0", "lon0", "lat1", "lon1")])
    g, r = scalars.normalize_diff(col("g0"), col("g1"), F.lit(97.0)), scalars.normalize_diff(col("r0"), col("r1"), F.lit(64.0))
    cost = scalars.degree_cost(col("lat0") - col("lat1"), col("lon0") - col("lon1"), g, r)
    return p.select("a", "b", F.round(km, 6).alias("km"), F.round(g, 9).alias("gates"), F.round(scalars.distance_cost(km, g, r), 6).alias("cost"), F.round(cost, 9).alias("degree_cost"))


@query(f"SELECT id, round(1e0 / 111, 9) AS lat_buffer, round(1 / (111 * cos(radians(lat))), 9) AS lon_buffer FROM {CE}")
def buffers(spark, sf_dir):
    a, b = scalars.degree_buffer(col("lat"), 1.0)
    return view(spark, sf_dir, "cells").select("id", F.round(a, 9).alias("lat_buffer"), F.round(b, 9).alias("lon_buffer"))


_NAME = "CASE l_linenumber % 4 WHEN 0 THEN concat('MRMS_EchoTop_18_00.50_', strftime(l_shipdate, '%Y%m%d'), '-123456.grib2.gz') WHEN 1 THEN concat('MRMS_PROBSEVERE_', strftime(l_shipdate, '%Y%m%d'), '_120059.json') WHEN 2 THEN concat('G16_s', strftime(l_shipdate, '%Y%j'), '1234567.nc') ELSE concat('x_', strftime(l_shipdate, '%Y'), '1399-123456') END"


@query(f"""SELECT DISTINCT name, CASE WHEN k = 3 THEN NULL ELSE date_trunc('day', l_shipdate) + CASE k WHEN 1 THEN INTERVAL 12 HOUR ELSE INTERVAL 754 MINUTE END END AS minute,
  CASE WHEN k = 0 THEN date_trunc('day', l_shipdate) + INTERVAL 45296 SECOND END AS second FROM (SELECT l_shipdate, l_linenumber % 4 AS k, {_NAME} AS name FROM lineitem)""")
def name_times(spark, sf_dir):
    d = lambda f: F.date_format("l_shipdate", f)
    k = col("l_linenumber") % 4
    name = F.when(k == 0, F.concat(F.lit("MRMS_EchoTop_18_00.50_"), d("yyyyMMdd"), F.lit("-123456.grib2.gz"))).when(k == 1, F.concat(F.lit("MRMS_PROBSEVERE_"), d("yyyyMMdd"), F.lit("_120059.json")))
    name = name.when(k == 2, F.concat(F.lit("G16_s"), d("yyyyDDD"), F.lit("1234567.nc"))).otherwise(F.concat(F.lit("x_"), d("yyyy"), F.lit("1399-123456")))
    names = read(spark, sf_dir, "lineitem").select(name.alias("name")).distinct()
    return names.select("name", scalars.name_minute(col("name")).alias("minute"), scalars.name_second(col("name")).alias("second"))


@query("""SELECT o_orderkey, date_trunc('minute', o_orderdate) AS minute, date_trunc('hour', o_orderdate) AS hour, date_trunc('day', o_orderdate) + INTERVAL 61 MINUTE AS compact, date_trunc('day', o_orderdate) AS day,
  make_timestamp(1760000000000000 + o_orderkey * 1000000) AS unix FROM orders""")
def product_times(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return o.select(
        "o_orderkey", scalars.to_minute(col("o_orderdate")).alias("minute"), scalars.to_hour(col("o_orderdate")).alias("hour"), scalars.name_any(F.concat(F.lit("a_"), day, F.lit(".0101"))).alias("compact"),
        scalars.name_any(F.concat(day, F.lit(".nc"))).alias("day"), scalars.name_any(F.concat(F.lit("u"), (col("o_orderkey") + 1760000000).cast("string"))).alias("unix"),
    )


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS name, concat(regexp_replace(url, '/+$', ''), '/', 'x.gz') AS joined FROM pages")
def url_parts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", scalars.base_name(col("url")).alias("name"), scalars.join_url(col("url"), F.lit("/x.gz")).alias("joined"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 0e0 AS gone, CAST(NULL AS DOUBLE) AS bad, 'MATCH_ERROR' AS bad_status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS whole FROM events")
def property_casts(spark, sf_dir):
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("x"), F.lit("1_0")))
    value, status = scalars.number_of(m, "x")
    return read(spark, sf_dir, "events").select("event_id", scalars.number_of(m, "k")[0].alias("k"), scalars.number_of(m, "none")[0].alias("gone"), value.alias("bad"), status.alias("bad_status"), F.element_at(scalars.floats_in(col("props")), 1).cast("long").alias("whole"))


_LATEST = "SELECT event_id AS cell_id, event_id % 30 * 5e-1 AS EchoTop18, event_id % 20 * 5e-1 AS EchoTop30, CAST(event_id % 4 AS DOUBLE) AS EchoTop50, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 50 * 1e0 END AS VIL, value / 10 AS VII, event_id % 60 * 1e0 AS RALA, event_id % 90 * 1e0 AS PrecipRate, event_id % 70 * 1e0 AS MESH, event_id % 13 * 1e0 AS MinFlashArea, event_id % 40 AS num_gates, event_id % 7 * 1e0 AS CGFlashDensity, event_id % 5 * 1e0 AS FlashDensity FROM {events}"


@query(f"""SELECT cell_id, round(CASE WHEN EchoTop50 = 0 THEN 3e-1 * EchoTop18 + 7e-1 * EchoTop30 ELSE 1e-1 * EchoTop18 + 3e-1 * EchoTop30 + 6e-1 * EchoTop50 END, 6) AS CompET, round(VIL + VII, 6) AS THL, round((VIL + VII) / nullif(EchoTop18, 0), 6) AS THLD,
  round((5e-1 * tanh(5293e-5 * RALA) + 5e-1 * tanh(6617e-5 * PrecipRate)) * tanh(MESH / 25), 6) AS PII, round(MinFlashArea / nullif(num_gates * 12321e-4, 0), 6) AS FAR, round(coalesce(CGFlashDensity / nullif(FlashDensity, 0), 0), 6) AS CGFlashRatio FROM ({_LATEST.format(events='events')})""")
def composite_indices(spark, sf_dir):
    latest = spark.sql(_LATEST, events=read(spark, sf_dir, "events"))
    return attributes.indices(latest).select("cell_id", *[F.round(c, 6).alias(c) for c in ("CompET", "THL", "THLD", "PII", "FAR", "CGFlashRatio")])


# --- files and schedule ---------------------------------------------------------------------------------------------------

_NOW = datetime.datetime(2024, 1, 20, 12, 0)
_T = "TIMESTAMP '2024-01-20 12:00:00'"


def _now() -> F.Column:
    return F.lit(_NOW).cast("timestamp_ntz")


@query(f"SELECT product, url, ts FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ts DESC, url) AS n FROM {FI} WHERE ts BETWEEN {_T} - INTERVAL 6 HOUR AND {_T}) WHERE n <= 10")
def recent_files(spark, sf_dir):
    return schedule.lookup(view(spark, sf_dir, "files"), _now(), datetime.timedelta(hours=6), 10)


@query(f"SELECT product, url, ts FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ts DESC, url) AS n FROM {FI}) WHERE n = 3")
def third_newest(spark, sf_dir):
    return schedule.nth_newest(view(spark, sf_dir, "files"), 2)


@query(f"SELECT url, ts FROM {FI} ORDER BY ts DESC, url LIMIT 5")
def newest_files(spark, sf_dir):
    return schedule.newest_files(view(spark, sf_dir, "files"), 5, by="ts").select("url", "ts")


@query(f"SELECT count(*) AS n FROM {FI} WHERE ts >= {_T} - INTERVAL 20 MINUTE")
def retained_files(spark, sf_dir):
    return schedule.retained(view(spark, sf_dir, "files"), _now(), by="ts").agg(F.count("*").alias("n"))


@query(f"SELECT h AS minute FROM (SELECT DISTINCT product, date_trunc('hour', ts) AS h FROM {FI}) GROUP BY h HAVING count(*) = (SELECT count(DISTINCT product) FROM {FI})")
def common_hours(spark, sf_dir):
    return schedule.common_minutes(view(spark, sf_dir, "files"), "hour")


_TWO = f"(SELECT * FROM {FI} WHERE product IN ('click', 'view'))"


@query(f"SELECT max(m) AS minute FROM (SELECT m FROM (SELECT DISTINCT product, date_trunc('minute', ts) AS m FROM {_TWO}) GROUP BY m HAVING count(*) = (SELECT count(DISTINCT product) FROM {_TWO}))")
def latest_common_minute(spark, sf_dir):
    return schedule.latest_common(view(spark, sf_dir, "files").where("product IN ('click', 'view')"))


_TIMES = "(SELECT DISTINCT CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (o_orderkey % 720) AS TIMESTAMP) AS t FROM orders)"


def _times(spark, sf_dir):
    hours = read(spark, sf_dir, "orders").select((col("o_orderkey") % 720).alias("h")).distinct()
    return hours.select((F.timestamp_seconds(F.lit(1704067200) + col("h") * 3600)).cast("timestamp_ntz").alias("t"))


@query(f"SELECT p.product, t.t, f.url, f.ts FROM {_TIMES} t CROSS JOIN (SELECT DISTINCT product FROM {FI}) p ASOF JOIN {FI} f ON p.product = f.product AND t.t >= f.ts WHERE f.ts >= t.t - INTERVAL 6 HOUR")
def as_of_files(spark, sf_dir):
    return schedule.as_of(view(spark, sf_dir, "files"), _times(spark, sf_dir))


_HOURS = f"(SELECT date_trunc('hour', ts) AS hour, min(url) AS url FROM {FI} WHERE product = 'purchase' GROUP BY 1)"


@query(f"SELECT t, arg_max(url, hour) AS url, max(hour) AS hour FROM {_TIMES} JOIN {_HOURS} ON hour IN (date_trunc('hour', t), date_trunc('hour', t) - INTERVAL 1 HOUR) GROUP BY t")
def hour_or_before(spark, sf_dir):
    return schedule.hour_or_before(view(spark, sf_dir, "files").where("product = 'purchase'"), _times(spark, sf_dir))


@query(f"SELECT t, url FROM {_TIMES} JOIN {_HOURS} ON hour = date_trunc('hour', t)")
def exact_hour(spark, sf_dir):
    return schedule.exact_hour(view(spark, sf_dir, "files").where("product = 'purchase'"), _times(spark, sf_dir))


_REMOTE, _LOCAL = f"(SELECT * FROM {FI} WHERE product <> 'click')", f"(SELECT * FROM {FI} WHERE product IN ('click', 'view') AND ts < {_T})"


@query(f"""SELECT p.product, CASE WHEN r.t IS NULL THEN false WHEN l.t IS NULL THEN true ELSE r.t > l.t END AS has_update FROM (SELECT DISTINCT product FROM {FI}) p
  LEFT JOIN (SELECT product, max(ts) AS t FROM {_REMOTE} GROUP BY 1) r USING (product) LEFT JOIN (SELECT product, max(ts) AS t FROM {_LOCAL} GROUP BY 1) l USING (product)""")
def product_updates(spark, sf_dir):
    f = view(spark, sf_dir, "files")
    return schedule.updates(f.where("product <> 'click'"), f.where(col("product").isin("click", "view") & (col("ts") < _now())), f)


@query(f"SELECT coalesce(bool_and(has_update), true) AS all_available FROM ({SQL['product_updates']})")
def all_available(spark, sf_dir):
    return schedule.all_available(product_updates(spark, sf_dir))


_STACK = "(SELECT date_trunc('day', l_shipdate) AS ts, l_linenumber AS height FROM lineitem)"


def _stack(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts"), col("l_linenumber").alias("height"))


@query(f"WITH h AS (SELECT count(DISTINCT height) AS k FROM {_STACK}) SELECT max(ts) AS ts FROM (SELECT ts, count(DISTINCT height) AS n FROM {_STACK} GROUP BY ts ORDER BY ts DESC LIMIT 50) WHERE n = 7")
def complete_scan(spark, sf_dir):
    return schedule.complete_scans(_stack(spark, sf_dir), 7, 50)


@query(f"SELECT ts, count(DISTINCT height) / 7e0 AS share, count(DISTINCT height) / 7e0 >= 8e-1 AS enough FROM {_STACK} GROUP BY ts")
def scan_completeness(spark, sf_dir):
    return schedule.completeness(_stack(spark, sf_dir), 7)


# a listing's line for each order: data files of two kinds of names, and lines that are none
_LINE = """CASE o_orderkey % 9 WHEN 0 THEN '<a href="../">parent</a>' WHEN 1 THEN '<a href="MRMS_latest.grib2.gz">x</a>' WHEN 2 THEN '<a href="sub/">sub</a>' WHEN 3 THEN '<a href="?C=N;O=D">N</a>'
  WHEN 4 THEN concat('<a href="f', CAST(o_custkey AS STRING), '.nc">f</a> <a href="g.nc">g</a>') WHEN 5 THEN concat('<a href="e_20250110-', CAST(100000 + o_custkey % 100 AS STRING), '">e</a>')
  WHEN 6 THEN '<a href="readme.txt">r</a>' WHEN 7 THEN 'no link.gz' ELSE concat('<a href="p', CAST(o_custkey % 50 AS STRING), '.json">p</a>') END"""


@query("""SELECT name, count(*) AS n FROM (SELECT CASE o_orderkey % 9 WHEN 4 THEN 'f' || o_custkey || '.nc' WHEN 5 THEN 'e_20250110-' || (100000 + o_custkey % 100) WHEN 8 THEN 'p' || o_custkey % 50 || '.json' END AS name FROM orders)
  WHERE name IS NOT NULL GROUP BY name""")
def listing_names(spark, sf_dir):
    lines = read(spark, sf_dir, "orders").selectExpr(f"{_LINE} AS value")
    return readers.listing(lines).groupBy("name").agg(F.count("*").alias("n"))


@query(SQL["listing_names"])
def compressed_listing(spark, sf_dir):
    """The same listing from a gzip file, which is read as it is."""
    path = place(spark)
    read(spark, sf_dir, "orders").selectExpr(f"{_LINE} AS value").write.option("compression", "gzip").text(path)
    return readers.listing(spark.read.text(path)).groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT folder, needed, count(o_orderkey) AS n FROM (VALUES (0, 'EchoTop18', true), (1, 'EchoTop30', true), (2, 'FLASH', false), (3, 'NLDN', true), (4, 'PrecipRate', true), (5, 'QPE_01H', true), (6, 'RotationTrack30min', true), (7, 'VILDensity', true),
  (8, 'ProbSevere', true), (9, 'RhoHV', false), (10, 'PrecipFlag', true), (11, 'RALA', true), (12, 'CompRefQC', true), (13, 'VII', true)) t(k, folder, needed) LEFT JOIN orders ON o_orderkey % 17 = k GROUP BY ALL""")
def source_catalog(spark, sf_dir):
    """Files by the source that the first part of their url names; urls of no source are left out."""
    sources = spark.createDataFrame([(*x, x in readers.CHECKED) for x in readers.DOWNLOADS], "suffix string, folder string, needed boolean")
    suffixes = F.array(*[F.lit(x) for x, _ in readers.DOWNLOADS], *[F.lit("2D/other/")] * 3)
    urls = read(spark, sf_dir, "orders").select(F.concat(suffixes[(col("o_orderkey") % 17).cast("int")], F.lit("x_"), col("o_orderkey").cast("string")).alias("url"))
    return sources.join(urls.select(F.regexp_extract("url", "^(.*/)", 1).alias("suffix"), "url"), "suffix", "left").groupBy("folder", "needed").agg(F.count("url").alias("n"))


@query("SELECT url, height FROM (SELECT concat('/d/MRMS_MergedReflectivityQC_', lpad(CAST(l_linenumber AS VARCHAR), 2, '0'), '.00_', CAST(l_orderkey AS VARCHAR)) AS url, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '.00' AS height FROM lineitem) WHERE height IN ('01.00', '03.00')")
def sweep_files(spark, sf_dir):
    name = F.concat(F.lit("/d/MRMS_MergedReflectivityQC_"), F.lpad(col("l_linenumber").cast("string"), 2, "0"), F.lit(".00_"), col("l_orderkey").cast("string"))
    heights = spark.createDataFrame([("01.00",), ("03.00",)], "height string")
    return readers.sweep_files(read(spark, sf_dir, "lineitem").select(name.alias("url")), heights).select("url", "height")


# --- history ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT cell_id, seq FROM (SELECT *, lag(max_refl) OVER w AS r, lag(num_gates) OVER w AS g FROM {HI} WINDOW w AS (PARTITION BY cell_id ORDER BY ts)) WHERE NOT coalesce(r = max_refl AND g = num_gates, false)")
def kept_entries(spark, sf_dir):
    h = view(spark, sf_dir, "history").withColumn("at", col("ts"))
    return history.kept_entries(h.select("cell_id", "ts", "seq", "max_refl", "num_gates"), ["max_refl", "num_gates"], order="ts").select("cell_id", "seq")


@query(SQL["kept_entries"])
def changed_entries(spark, sf_dir):
    return history.changed_entries(view(spark, sf_dir, "history"), ["max_refl", "num_gates"]).select("cell_id", "seq")


_MOVES = f"""SELECT cell_id, seq, round((lon - lag(lon) OVER w) * {{m}} * cos(radians((lat + lag(lat) OVER w) / 2)), 4) AS dx, round((lat - lag(lat) OVER w) * {{m}}, 4) AS dy,
  round(epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER w / 1e6, 6) AS dt, lead(seq) OVER w IS NULL AS last FROM {HI} WINDOW w AS (PARTITION BY cell_id ORDER BY ts)"""


def _moves(spark, sf_dir, every, metres):
    v = history.vectors(view(spark, sf_dir, "history"), every=every, metres=metres, order="ts")
    return v.select("cell_id", "seq", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"), F.round("dt", 6).alias("dt"))


@query("SELECT cell_id, seq, CASE WHEN last THEN dx END AS dx, CASE WHEN last THEN dy END AS dy, CASE WHEN last THEN dt END AS dt FROM (" + _MOVES.format(m="111000e0") + ")")
def last_vectors(spark, sf_dir):
    return _moves(spark, sf_dir, False, scalars.DEGREE_M)


@query("SELECT cell_id, seq, dx, dy, dt FROM (" + _MOVES.format(m="111320e0") + ")")
def all_vectors(spark, sf_dir):
    return _moves(spark, sf_dir, True, scalars.LEGACY_DEGREE_M)


@query("SELECT cell_id, count(*) AS n FROM (" + _MOVES.format(m="111320e0") + ") WHERE cell_id NOT IN (SELECT cell_id FROM (" + _MOVES.format(m="111320e0") + ") WHERE last AND sqrt(dx * dx + dy * dy) > 9000) GROUP BY cell_id")
def cells_without_jumps(spark, sf_dir):
    v = history.vectors(view(spark, sf_dir, "history"), every=True, metres=scalars.LEGACY_DEGREE_M, order="ts")
    return history.without_jumps(v, order="ts").groupBy("cell_id").agg(F.count("*").alias("n"))


@query(f"SELECT cell_id, arg_max(seq, ts) AS seq, max(ts) AS ts FROM {HI} GROUP BY cell_id")
def latest_entries(spark, sf_dir):
    return history.latest(view(spark, sf_dir, "history"), order="ts").select("cell_id", "seq", "ts")


@query(f"SELECT cell_id, round(arg_max(lat, ts), 6) AS lat, arg_max(num_gates, ts) AS num_gates FROM {HI} GROUP BY cell_id")
def latest_positions(spark, sf_dir):
    h = view(spark, sf_dir, "history")
    return history.latest_position(h, h, order="ts").select("cell_id", F.round("lat", 6).alias("lat"), "num_gates")


def _halves(spark, sf_dir):
    h = view(spark, sf_dir, "history")
    return h.where(col("ts") < _now()), h.where(col("ts") >= _now())


_OLD, _NEW = f"(SELECT * FROM {HI} WHERE ts < {_T} AND cell_id % 3 <> 0)", f"(SELECT * FROM {HI} WHERE ts >= {_T} AND cell_id % 4 <> 0)"


@query(f"SELECT cell_id, seq FROM {_OLD} WHERE cell_id IN (SELECT cell_id FROM {_NEW}) UNION ALL SELECT cell_id, seq FROM {_NEW} WHERE cell_id NOT IN (SELECT cell_id FROM {_OLD})")
def upserted_history(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    old, new = old.where("cell_id % 3 <> 0"), new.where("cell_id % 4 <> 0")
    cells_of = lambda h: history.latest(h, order="ts")
    return history.upsert(cells_of(old), cells_of(new), old, new)[1].select("cell_id", "seq")


@query(f"SELECT cell_id, cell_id IN (SELECT cell_id FROM {_OLD}) AS known FROM {_NEW} GROUP BY cell_id")
def upserted_cells(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    old, new = history.latest(old.where("cell_id % 3 <> 0"), order="ts"), history.latest(new.where("cell_id % 4 <> 0"), order="ts")
    return history.upsert(old, new, old, new)[0].select("cell_id", "known")


@query(f"SELECT cell_id, ts, coalesce(CASE WHEN seq % 3 = 0 THEN 99e0 END, max_refl) AS max_refl, num_gates FROM {HI} UNION ALL SELECT cell_id, ts + INTERVAL 1 SECOND, 99e0, NULL FROM {HI} WHERE seq % 5 = 0")
def upserted_entries(spark, sf_dir):
    h = view(spark, sf_dir, "history")
    new = h.where("seq % 3 = 0").select("cell_id", "ts", F.lit(99.0).alias("max_refl"))
    more = h.where("seq % 5 = 0").select("cell_id", (col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.lit(99.0).alias("max_refl"))
    return history.upsert_entries(h.select("cell_id", "ts", "max_refl", "num_gates"), new.unionByName(more))


@query("SELECT user_id AS cell_id, ts, value FROM events WHERE event_id % 2 = 0")
def entries_with_metric(spark, sf_dir):
    m = F.when(col("event_id") % 2 == 0, F.create_map(F.lit("VIL"), col("value"))).otherwise(F.create_map(F.lit("VII"), col("value")))
    return history.entries_with(read(spark, sf_dir, "events").select(col("user_id").alias("cell_id"), "ts", m.alias("metrics")), "VIL")


@query(f"SELECT id, num_gates, max_refl FROM {CE} WHERE id = 77")
def cell_lookup(spark, sf_dir):
    return view(spark, sf_dir, "cells").where("id = 77").select("id", "num_gates", "max_refl")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'k,' END || CASE WHEN event_id % 3 = 0 THEN 'm' ELSE 'n' END AS missing FROM events WHERE json_exists(props, '$.k')")
def missing_keys(spark, sf_dir):
    one = lambda k: F.create_map(F.lit(k), F.lit("1"))
    a = F.map_concat(F.from_json("props", "map<string,string>"), F.when(col("event_id") % 3 == 0, one("m")).otherwise(one("n")))
    b = F.when(col("event_id") % 2 == 0, one("k")).otherwise(one("z"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(history.missing_keys(a, b), ",").alias("missing"))


# --- cells: attributes, matching, merging ----------------------------------------------------------------------------------


@query(f"""SELECT c.id, CASE WHEN p.id IS NULL THEN NULL ELSE p.id END AS MESH, CASE WHEN p.id IS NULL THEN 'NO_MATCH' END AS MESH_status, CASE WHEN p.id IS NOT NULL THEN 0e0 END AS VIL
  FROM {CE} c LEFT JOIN (SELECT id, CAST(id AS DOUBLE) AS m FROM {SH} WHERE id <> 0) p ON p.id = c.id""".replace("THEN NULL ELSE p.id END AS MESH", "THEN NULL ELSE p.m END AS MESH"))
def cell_attributes(spark, sf_dir):
    polys = proxies.polygons(spark, sf_dir).where("id <> 0")
    return attributes.attributes(view(spark, sf_dir, "cells").select("id"), polys).select("id", "MESH", "MESH_status", "VIL")


_A, _B = f"(SELECT * FROM {CE} WHERE id % 20 < 10)", f"(SELECT scan, id, num_gates, max_refl, lat + 1e-2 AS lat, lon - 1e-2 AS lon FROM {CE} WHERE id % 20 >= 10)"
_CAND = f"""SELECT a.scan, a.id AS old_id, b.id AS new_id, 5e-1 * least(sqrt((a.lat - b.lat) ^ 2 + (a.lon - b.lon) ^ 2) / 10, 1) + 3e-1 * (abs(a.num_gates - b.num_gates) / g) + 2e-1 * (abs(a.max_refl - b.max_refl) / r) AS cost
  FROM {_A} a JOIN {_B} b USING (scan) JOIN (SELECT scan, greatest(1, max(num_gates)) AS g, greatest(1, max(max_refl)) AS r FROM (SELECT * FROM {_A} UNION ALL SELECT * FROM {_B}) GROUP BY scan) USING (scan)
  WHERE abs(a.lon - b.lon) * 111 * cos(radians((a.lat + b.lat) / 2)) <= 10 AND abs(a.lat - b.lat) * 111 <= 10"""


def _scans(spark, sf_dir):
    c = view(spark, sf_dir, "cells")
    return c.where("id % 20 < 10"), c.where("id % 20 >= 10").withColumns({"lat": col("lat") + 0.01, "lon": col("lon") - 0.01})


@query(f"SELECT scan, old_id, new_id, round(cost, 9) AS cost FROM ({_CAND})")
def candidate_pairs(spark, sf_dir):
    return match.candidate_pairs(*_scans(spark, sf_dir), digits=9)


@query()
def best_matches(spark, sf_dir):
    return match.best_matches(*_scans(spark, sf_dir))


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT scan, old_id, new_id, cost, row_number() OVER (PARTITION BY scan ORDER BY cost, old_id, new_id) AS k FROM ({_CAND}) WHERE cost < 1),
  -- pairs that come first for both of their cells are taken, pairs that share a cell with them go, until none is left
  t(scan, old_id, new_id, cost, k, taken) AS (SELECT *, k = min(k) OVER (PARTITION BY scan, old_id) AND k = min(k) OVER (PARTITION BY scan, new_id) FROM p UNION ALL
  SELECT scan, old_id, new_id, cost, k, k = min(k) OVER (PARTITION BY scan, old_id) AND k = min(k) OVER (PARTITION BY scan, new_id) FROM
  (SELECT *, bool_or(taken) OVER (PARTITION BY scan, old_id) OR bool_or(taken) OVER (PARTITION BY scan, new_id) AS gone FROM t) WHERE NOT gone)
  SELECT scan, old_id, new_id, round(cost, 9) AS cost FROM t WHERE taken""")
def greedy_matches(spark, sf_dir):
    return match.greedy_cells(*_scans(spark, sf_dir)).withColumn("cost", F.round("cost", 9))


_M = f"(SELECT c.old_id, c.new_id FROM (SELECT id AS old_id, id + 10 AS new_id FROM {_A}) c JOIN {_B} b ON b.id = c.new_id)"


@query(f"""SELECT a.id, coalesce(b.num_gates, a.num_gates) AS num_gates, CASE WHEN b.id IS NULL THEN 'kept' ELSE 'updated' END AS source FROM (SELECT * FROM {_A} WHERE id % 3 > 0) a LEFT JOIN {_M} m ON m.old_id = a.id LEFT JOIN {_B} b ON b.id = m.new_id
  UNION ALL SELECT id, num_gates, 'old' FROM {_A} WHERE id % 3 = 0 AND id IN (SELECT old_id FROM {_M}) UNION ALL SELECT id, num_gates, 'new' FROM {_B} WHERE id NOT IN (SELECT new_id FROM {_M})""")
def applied_matches(spark, sf_dir):
    old, new = _scans(spark, sf_dir)
    found = old.select(col("id").alias("old_id"), (col("id") + 10).alias("new_id")).join(new.select(col("id").alias("new_id")), "new_id")
    return match.apply_matches(old.where("id % 3 > 0"), old, new, found, ["num_gates"])


_CB = f"(SELECT scan, id, num_gates, lat, lon, lat - num_gates * 2e-4 AS lat_min, lat + num_gates * 2e-4 AS lat_max, lon - num_gates * 2e-4 AS lon_min, lon + num_gates * 2e-4 AS lon_max FROM {CE})"


def _boxed(spark, sf_dir):
    c = view(spark, sf_dir, "cells")
    half = col("num_gates") * 2e-4
    c = c.select("scan", col("id").cast("int").alias("ordinal"), "id", "num_gates", "lat", "lon", (col("lat") - half).alias("lat_min"), (col("lat") + half).alias("lat_max"), (col("lon") - half).alias("lon_min"), (col("lon") + half).alias("lon_max"))
    return c.withColumn("ring", geometry.box_points(col("lat_min"), col("lat_max"), col("lon_min"), col("lon_max")))


@query(f"""WITH m AS (SELECT scan, max(num_gates) * 9e-1 AS f FROM {_CB} GROUP BY scan), c AS (SELECT * FROM {_CB} JOIN m USING (scan)),
  p AS (SELECT s.scan, s.id, s.num_gates, l.id AS large_id, l.num_gates AS g, sqrt((s.lat - l.lat) ^ 2 + (s.lon - l.lon) ^ 2) AS d FROM c s JOIN c l ON s.scan = l.scan AND s.num_gates < s.f AND l.num_gates >= l.f
  AND NOT (s.lon_max + 1 / (111 * cos(radians(s.lat))) < l.lon_min OR s.lon_min - 1 / (111 * cos(radians(s.lat))) > l.lon_max OR s.lat_max + 1e0 / 111 < l.lat_min OR s.lat_min - 1e0 / 111 > l.lat_max))
  SELECT scan, id, large_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, large_id) AS n FROM p) WHERE n = 1 AND num_gates < g * 9e-1""")
def nearest_large_cells(spark, sf_dir):
    return match.nearest_large(_boxed(spark, sf_dir))


@query(f"SELECT scan, sum(num_gates)::BIGINT AS num_gates, round(sum(lat * num_gates) / sum(num_gates), 6) AS lat, round(min(lat_min), 6) AS lat_min, round(max(lon_max), 6) AS lon_max FROM {_CB} GROUP BY scan")
def merged_groups(spark, sf_dir):
    m = cells.merged(_boxed(spark, sf_dir), "scan")
    return m.select("scan", "num_gates", F.round("lat", 6).alias("lat"), F.round("lat_min", 6).alias("lat_min"), F.round("lon_max", 6).alias("lon_max"))


@query()
def merged_cells(spark, sf_dir):
    return match.merge_cells(_boxed(spark, sf_dir)).select("scan", "id", "num_gates")


_GROUPS = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM {_CB}), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON {{same}} a.id <> b.id AND a.lat_min < b.lat_max AND b.lat_min < a.lat_max AND a.lon_min < b.lon_max AND b.lon_min < a.lon_max),
  r(id, g) AS (SELECT id, id FROM c UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id WHERE r.g < e.b) SELECT id, min(g) AS "group" FROM r GROUP BY id"""


@query(_GROUPS.format(same="a.scan = b.scan AND"))
def overlap_groups(spark, sf_dir):
    """Overlapping cells by box, within each scan; links come from a tile join of distinct boxes."""
    c = cut(_boxed(spark, sf_dir).drop("ring"))
    return match.overlap_groups(spatial.linked(c), c).select("id", "group")


@query(_GROUPS.format(same=""))
def all_overlap_groups(spark, sf_dir):
    """Overlapping cells by box, whatever their scan: where storms have been."""
    c = cut(_boxed(spark, sf_dir).drop("ring"))
    return match.overlap_groups(spatial.linked(c, ()), c, ())


_AREA = "(lat_max - lat_min) * (lon_max - lon_min)"


def _uncovered_sql(share: str, order: str) -> str:
    """Cells in their order one by one; a cell stays if none that stayed covers it."""
    return f"""WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY {order} DESC, id) AS k FROM (SELECT *, {_AREA} AS area, {_AREA} * 12321 * cos(radians((lat_min + lat_max) / 2)) AS km2 FROM {_CB})),
  o AS MATERIALIZED (SELECT a.scan, a.k, list(b.k) AS over FROM c a JOIN c b ON a.scan = b.scan AND b.k < a.k AND
  100 * greatest(0, least(a.lat_max, b.lat_max) - greatest(a.lat_min, b.lat_min)) * greatest(0, least(a.lon_max, b.lon_max) - greatest(a.lon_min, b.lon_min)) / a.area {share} GROUP BY ALL),
  w AS MATERIALIZED (SELECT c.scan, c.k, o.over FROM c LEFT JOIN o USING (scan, k)),
  r(scan, k, alive) AS (SELECT scan, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM c GROUP BY scan UNION ALL
  SELECT r.scan, w.k, CASE WHEN w.over IS NOT NULL AND list_has_any(w.over, r.alive) THEN r.alive ELSE list_append(r.alive, w.k) END FROM r JOIN w ON w.scan = r.scan AND w.k = r.k + 1),
  f AS (SELECT scan, unnest(arg_max(alive, k)) AS k FROM r GROUP BY scan) SELECT scan, id FROM c JOIN f USING (scan, k)"""


@query(_uncovered_sql(">= 67 - 1e-9", "num_gates"))
def uncovered_cells(spark, sf_dir):
    return match.covered(_boxed(spark, sf_dir)).select("scan", "id")


@query(_uncovered_sql("> 80 + 1e-9", "km2"))
def uncovered_by_area(spark, sf_dir):
    c = _boxed(spark, sf_dir).withColumn("area", geometry.area_km2(col("ring")))
    return match.covered(c, 80.0, order="area", strict=True).select("scan", "id")


@query(f"SELECT id, num_gates FROM (SELECT *, row_number() OVER (PARTITION BY num_gates ORDER BY max_refl DESC, id) AS n FROM {CE}) WHERE n = 1")
def longest_histories(spark, sf_dir):
    return cells.longest_history(view(spark, sf_dir, "cells"), id="num_gates", entries="max_refl", ordinal="id").select("id", "num_gates")


@query(f"SELECT cell_id, hour, seq FROM (SELECT *, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY cell_id, date_trunc('hour', ts) ORDER BY seq) AS n FROM {HI}) WHERE n = 1")
def united_histories(spark, sf_dir):
    h = view(spark, sf_dir, "history").withColumn("hour", scalars.to_hour(col("ts")))
    return cells.united_histories(h, id="cell_id", ts="hour", ordinal="seq").select("cell_id", "hour", "seq")


@query(f"SELECT cell_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY ts DESC, seq) AS n FROM {HI}) WHERE n = 1")
def latest_copies(spark, sf_dir):
    return cells.latest_copy(view(spark, sf_dir, "history"), id="cell_id", last="ts", ordinal="seq").select("cell_id", "seq")


@query(f"SELECT round(avg(d), 6) AS mean_distance, round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance FROM (SELECT sqrt((lat0 - lat1) ^ 2 + (lon0 - lon1) ^ 2) AS d FROM ({_PAIR}))")
def match_statistics(spark, sf_dir):
    s = cells.match_statistics(_pairs(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


# --- whole flows, export, streams -------------------------------------------------------------------------------------------


# polygons with a corner in the window of detection, which holds the whole grid
_CORNERS = ("i0, j0", "i0 + hi, j0", "i0, j0 + hj", "CASE WHEN NOT triangle THEN i0 + hi END, j0 + hj")
_SEEN = f"(SELECT * FROM {SH} WHERE " + " OR ".join("({} BETWEEN 0 AND 200 AND {} BETWEEN 0 AND 100)".format(*c.split(", ")) for c in _CORNERS) + ")"


@query(_SUMMARY.format(key="poly_id", rows=f"({_grown_sql(100, _LABELS.replace(SH, _SEEN))}) JOIN {G} USING (i, j)"))
def detected_summary(spark, sf_dir):
    """Detection end to end but for the outlines: window, polygons, growth, summary."""
    found = pipeline.detect(view(spark, sf_dir, "gates"), proxies.polygons(spark, sf_dir), (25.0, 27.0), (280.0, 281.0), outline=False)
    return found.select("id", "num_gates", "max_refl", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query()
def detected_cells(spark, sf_dir):
    """Detection end to end: window, polygons, growth, outlines, summary."""
    return pipeline.detect(view(spark, sf_dir, "gates"), proxies.polygons(spark, sf_dir), (25.0, 27.0), (280.0, 281.0))


def _integrated_sql() -> str:
    near = " ".join(f"LEFT JOIN (SELECT c.id, max(value) AS {p} FROM {CE} c JOIN {PR} g ON g.product = '{p}' AND g.value >= 0 AND g.lat BETWEEN c.lat - 1e-2 AND c.lat + 1e-2 AND g.lon BETWEEN c.lon - 1e-2 AND c.lon + 1e-2 GROUP BY c.id) {p} ON {p}.id = c.id" for p in ("p0", "p1"))
    found = ", ".join(f"CASE WHEN s.id IS NOT NULL THEN {'CAST(s.id AS DOUBLE)' if name == 'MESH' else '0e0'} END AS \"{name}\", CASE WHEN s.id IS NULL THEN 'NO_MATCH' END AS \"{name}_status\"" for name in attributes.SOURCES)
    status = ", ".join(f"{p}.{p}, CASE WHEN {p}.{p} IS NULL THEN 'N/A' END AS {p}_status" for p in ("p0", "p1"))
    return f"SELECT c.id, c.scan, c.num_gates, c.max_refl, round(c.lat, 6) AS lat, round(c.lon, 6) AS lon, {status}, {found} FROM {CE} c {near} LEFT JOIN (SELECT DISTINCT id FROM {SH}) s ON s.id = c.id"


@query(_integrated_sql())
def integrated_cells(spark, sf_dir):
    found = view(spark, sf_dir, "cells").withColumn("bbox", F.expr("array()").cast("array<struct<lat:double,lon:double>>"))
    done = pipeline.integrate(found, view(spark, sf_dir, "products"), proxies.polygons(spark, sf_dir), ["p0", "p1"])
    return done.drop("bbox").withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query()
def detected_regions(spark, sf_dir):
    return pipeline.detect_regions(view(spark, sf_dir, "gates")).select("scan", "id", "num_gates", "max_refl")


_OLDER, _NEWER = f"(SELECT * FROM {HI} WHERE ts < {_T})", f"(SELECT * FROM {HI} WHERE ts >= {_T})"


@query(f"""WITH n AS (SELECT cell_id, arg_max(max_refl, ts) AS max_refl, arg_max(num_gates, ts) AS num_gates, arg_max(lat, ts) AS lat, arg_max(lon, ts) AS lon FROM {_NEWER} GROUP BY cell_id),
  e AS (SELECT cell_id, seq, ts, max_refl, num_gates, lat, lon FROM {_OLDER} WHERE cell_id IN (SELECT cell_id FROM n)
  UNION ALL SELECT n.cell_id, coalesce(o.seq, 0), {_T}, max_refl, num_gates, lat, lon FROM n LEFT JOIN (SELECT cell_id, max(seq) + 1 AS seq FROM {_OLDER} GROUP BY cell_id) o USING (cell_id)),
  k AS (SELECT *, coalesce(max_refl = lag(max_refl) OVER w AND num_gates = lag(num_gates) OVER w AND lat = lag(lat) OVER w AND lon = lag(lon) OVER w, false) AS same FROM e WINDOW w AS (PARTITION BY cell_id ORDER BY seq)),
  v AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(ts) OVER w AS lt, lead(seq) OVER w IS NULL AS last FROM k WHERE NOT same WINDOW w AS (PARTITION BY cell_id ORDER BY seq))
  SELECT cell_id, seq, ts, max_refl, num_gates, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN last THEN round((lon - lo) * 111000 * cos(radians((lat + la) / 2)), 4) END AS dx, CASE WHEN last THEN round((lat - la) * 111000, 4) END AS dy,
  CASE WHEN last THEN round(epoch_us(ts) / 1e6 - epoch_us(lt) / 1e6, 6) END AS dt FROM v""")
def tracked_history(spark, sf_dir):
    """Tracking end to end: older histories go on with one entry for each cell of the newest scan, and get their last motion."""
    old, new = _halves(spark, sf_dir)
    columns = ["cell_id", "seq", "ts", "max_refl", "num_gates", "lat", "lon"]
    found = history.latest(new, order="ts").withColumnRenamed("cell_id", "id")
    done = pipeline.track(old.select("cell_id").distinct(), old.select(*columns), found.drop("ts", "seq", "value"), _NOW)[1]
    return done.select("cell_id", "seq", "ts", "max_refl", "num_gates", *[F.round(c, n).alias(c) for c, n in (("lat", 6), ("lon", 6), ("dx", 4), ("dy", 4), ("dt", 6))])


@query(f"""SELECT cell_id, count(*) AS n, arg_max(num_gates, ts) AS num_gates, arg_max(max_refl, ts) AS max_refl, round(arg_max(lat, ts), 4) AS lat, round(arg_max(lon, ts), 4) AS lon, strftime(arg_min(ts, seq), '%Y-%m-%dT%H:%M:%S') AS first_timestamp,
  round(arg_max(lon, seq), 4) AS last_lon, arg_max(max_refl, seq) AS last_refl FROM {HI} GROUP BY cell_id""")
def exported_cells(spark, sf_dir):
    """Cells written as JSON and read again."""
    h = view(spark, sf_dir, "history")
    rows = writers.export(history.latest(h, order="ts"), h)
    entry = "struct<timestamp:string,max_refl:double,num_gates:long,centroid:array<double>>"
    r = rows.select(F.from_json("json", f"struct<id:long,num_gates:long,max_refl:double,centroid:array<double>,storm_history:array<{entry}>>").alias("r")).select("r.*")
    last = F.element_at("storm_history", -1)
    return r.select(
        col("id").alias("cell_id"), F.size("storm_history").cast("long").alias("n"), "num_gates", "max_refl", col("centroid")[0].alias("lat"), col("centroid")[1].alias("lon"),
        col("storm_history")[0]["timestamp"].alias("first_timestamp"), last["centroid"][1].alias("last_lon"), last["max_refl"].alias("last_refl"),
    )


@query(f"SELECT h AS start FROM (SELECT DISTINCT product, date_trunc('hour', ts) AS h FROM {FI}) GROUP BY h HAVING count(*) = 5 AND h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {FI})")
def streamed_common_hours(spark, sf_dir):
    """The stream's closed windows with all five products equal the batch's common hours that its watermark has passed."""
    stream = _event_stream(spark, sf_dir).select(col("event_type").alias("product"), "ts")
    return _drained(jobs.complete_windows(stream, 5, "1 hour"))


@query(f"SELECT cell_id, ts FROM (SELECT DISTINCT cell_id, ts FROM {HI})")
def streamed_once(spark, sf_dir):
    stream = _event_stream(spark, sf_dir).select(col("user_id").alias("cell_id"), "ts")
    return _drained(jobs.once(stream)).select("cell_id", col("ts").cast("timestamp_ntz").alias("ts"))


# scans by the hour, of each cell its newest entry of the hour
_SCANS = f"(SELECT cell_id, date_trunc('hour', ts) AS ts, arg_max(max_refl, ts) AS max_refl, arg_max(num_gates, ts) AS num_gates, arg_max(lat, ts) AS lat, arg_max(lon, ts) AS lon FROM {HI} GROUP BY ALL)"


@query(f"""WITH s AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS n FROM {_SCANS}), t AS (SELECT max(n) AS top FROM s),
  l AS (SELECT *, n - row_number() OVER (PARTITION BY cell_id ORDER BY n) AS island FROM s),
  f AS (SELECT *, min(ts) OVER w AS life, max(n) OVER w = n AND n < (SELECT top FROM t) AS ends FROM l WINDOW w AS (PARTITION BY cell_id, island)),
  k AS (SELECT *, coalesce(max_refl = lag(max_refl) OVER w AND num_gates = lag(num_gates) OVER w AND lat = lag(lat) OVER w AND lon = lag(lon) OVER w, false) AS same FROM f WINDOW w AS (PARTITION BY cell_id, life ORDER BY ts)),
  v AS (SELECT *, row_number() OVER w - 1 AS seq, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(ts) OVER w AS lt FROM k WHERE NOT same WINDOW w AS (PARTITION BY cell_id, life ORDER BY ts))
  SELECT cell_id, life, seq, ts, max_refl, num_gates, round(lat, 6) AS lat, round(lon, 6) AS lon, round((lon - lo) * 111000 * cos(radians((lat + la) / 2)), 4) AS dx, round((lat - la) * 111000, 4) AS dy, epoch(ts - lt)::DOUBLE AS dt, false AS ended FROM v
  UNION ALL SELECT cell_id, life, NULL, ts, max_refl, num_gates, round(lat, 6), round(lon, 6), NULL, NULL, NULL, true FROM k WHERE ends""")
def streamed_tracks(spark, sf_dir):
    """The tracker as a stream of hourly scans, stopped half-way and started again from its checkpoint."""
    newest = lambda c: F.max_by(c, "ts").alias(c)
    fields = ["max_refl", "num_gates", "lat", "lon"]
    scans = cut(view(spark, sf_dir, "history").groupBy("cell_id", scalars.to_hour(col("ts")).alias("hour")).agg(*[newest(c) for c in fields]).withColumnRenamed("hour", "ts"))
    folder, path, checkpoint = place(spark), place(spark), place(spark)
    middle = scans.agg(F.timestamp_micros(F.avg(F.unix_micros(col("ts").cast("timestamp"))).cast("long")).cast("timestamp_ntz")).first()[0]
    for part in (col("ts") < F.lit(middle).cast("timestamp_ntz"), col("ts") >= F.lit(middle).cast("timestamp_ntz")):
        scans.where(part).write.mode("append").parquet(folder)
        jobs.start_tracks(jobs.marked(spark.readStream.schema(scans.schema).parquet(folder)), path, checkpoint, every=None).awaitTermination()
    found = spark.read.parquet(path)
    ntz = lambda c: col(c).cast("timestamp_ntz").alias(c)
    return found.select("cell_id", ntz("life"), F.when(~col("ended"), col("seq")).cast("long").alias("seq"), ntz("ts"), "max_refl", "num_gates", *[F.round(c, n).alias(c) for c, n in (("lat", 6), ("lon", 6), ("dx", 4), ("dy", 4))], "dt", "ended")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(stream: DataFrame) -> DataFrame:
    """A stream run to its end into a table of the shared folder; a table of one file at least."""
    spark = stream.sparkSession
    parts: list[DataFrame] = []

    def keep(rows: DataFrame, number: int) -> None:
        parts.append(cut(rows))

    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", place(spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT n_nationkey AS id, 3 AS corners FROM nation")
def geojson_polygons(spark, sf_dir):
    """Feature collections, written as text and read back."""
    rows = read(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()
    features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[-80, 25], [-79, 25], [-80, 26]]]}, "properties": {"ID": str(r.n_nationkey), "MESH": None}} for r in rows]
    table = spark.createDataFrame([(json.dumps({"features": features}),)], "value string")
    path = place(spark)
    table.write.text(path)
    return readers.polygons(spark, path).select(col("id").cast("int").alias("id"), F.size(col("rings")[0]).alias("corners"))
