import datetime as dt
import gzip
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.functions import geometry
from cellcast.operators import attributes, history, match, schedule, spatial
from cellcast.plans import catalog, config, pipeline, proxies
from cellcast.sources import readers, writers
from cellcast.streaming import jobs

SF = "/root/testdata/sf0.001"
T = [dt.datetime(2025, 10, 10, 12, m) for m in range(10)]


@pytest.mark.parametrize("rows,kept", [([(0, "a"), (0, "b"), (1, "b")], [0, 2]), ([(0, "a"), (1, "a"), (1, "b")], [0, 2]), ([(0, None), (1, None)], [0, 1]), ([(0, "a"), (1, "b"), (2, "a")], [0, 1, 2])])
def test_appends_compare_with_the_last_kept_entry(spark, rows, kept):
    df = spark.createDataFrame([(1, k, T[t], v) for k, (t, v) in enumerate(rows)], "cell_id long, seq int, ts timestamp_ntz, v string")
    assert sorted(r.seq for r in history.kept_entries(df, ["v"]).collect()) == kept


def test_vectors(spark):
    df = spark.createDataFrame([(1, 0, T[0], 40.0, 280.0), (1, 1, T[2], 40.1, 280.2), (2, 0, T[0], 1.0, 2.0)], "cell_id long, seq int, ts timestamp_ntz, lat double, lon double")
    got = {(r.cell_id, r.seq): r for r in history.vectors(df).collect()}
    assert got[1, 0].dx is None and got[2, 0].dt is None
    assert (round(got[1, 1].dx, 4), round(got[1, 1].dy, 6), got[1, 1].dt) == (16993.7273, 11100.0, 120.0)


def test_track_keeps_history_of_known_cells(spark):
    old = spark.createDataFrame([(1,), (2,)], "cell_id long")
    h = spark.createDataFrame([(i, 0, T[0], 50.0, 5, 40.0, 280.0) for i in (1, 2)], "cell_id long, seq int, ts timestamp_ntz, max_refl double, num_gates long, lat double, lon double")
    new = spark.createDataFrame([(2, 51.0, 6, 40.1, 280.1), (3, 52.0, 7, 41.0, 281.0)], "id long, max_refl double, num_gates long, lat double, lon double")
    cells, entries = pipeline.track(old, h, new, T[1])
    assert {r.cell_id: r.known for r in cells.collect()} == {2: True, 3: False}
    assert sorted((r.cell_id, r.seq, r.dt) for r in entries.collect()) == [(2, 0, None), (2, 1, 60.0), (3, 0, None)]


def test_assignment_is_optimal():
    rnd = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        cost = rnd.random((n, m)).round(1)
        col = match.assign(cost)
        used = [c for c in col if c >= 0]
        assert len(used) == len(set(used)) == min(n, m)
        k, total = min(n, m), sum(cost[r, c] for r, c in enumerate(col) if c >= 0)
        best = min(sum(cost[r, c] for r, c in zip(rs, cs)) for rs in itertools.combinations(range(n), k) for cs in itertools.permutations(range(m), k))
        assert abs(total - best) < 1e-9


def test_matches_beat_greedy(spark):
    rnd = np.random.default_rng(2)
    frame = lambda k: spark.createDataFrame([("s", i, 40 + float(a), 280 + float(b), int(c), float(d)) for i, (a, b, c, d) in enumerate(zip(rnd.random(30) / 5, rnd.random(30) / 5, rnd.integers(1, 90, 30), rnd.random(30) * 60))], "scan string, id long, lat double, lon double, num_gates long, max_refl double")
    old, new = frame(0), frame(1)
    best, greedy = match.best_matches(old, new).toPandas(), match.greedy_matches(match.candidate_pairs(old, new)).toPandas()
    total = lambda x: x.cost.sum() + 30 - len(x)
    assert best.old_id.is_unique and best.new_id.is_unique and total(best) <= total(greedy) + 1e-9


def test_match_scan(spark):
    schema = "ordinal int, id long, num_gates long, max_refl double, lat double, lon double"
    tracked = spark.createDataFrame([(0, 1, 10, 50.0, 40.0, 280.0), (1, 2, 10, 50.0, 45.0, 285.0)], schema)
    h = spark.createDataFrame([(i, 0, T[0], 50.0, 10, y, x) for i, y, x in ((1, 40.0, 280.0), (2, 45.0, 285.0))], "cell_id long, seq int, ts timestamp_ntz, max_refl double, num_gates long, lat double, lon double")
    found = spark.createDataFrame([(0, 70, 12, 51.0, 40.02, 280.01), (1, 71, 5, 44.0, 30.0, 270.0)], schema)
    cells, entries = pipeline.match_scan(tracked, h, found, T[1])
    assert {(r.id, r.num_gates, r.source) for r in cells.collect()} == {(1, 12, "updated"), (2, 10, "kept"), (71, 5, "new")}
    assert sorted((r.cell_id, r.dt) for r in entries.collect() if r.ts == T[1]) == [(1, 60.0), (71, None)]


def test_settings():
    assert config.Region.of([33.5, 35.7], [-79.3, 284.6]) == config.Region((33.5, 35.7), (280.7, 284.6))
    for lat, lon in (([0, 0], [1, 2]), ([1, 2], [0, 0]), (None, [1, 2]), ([1], [1, 2])):
        with pytest.raises(ValueError):
            config.Region.of(lat, lon)


def _boxes(spark, rows):
    out = [("s", k, i, n, (a + b) / 2, (a + b) / 2, a, b, a, b, [{"lon": x, "lat": y} for x, y in ((a, a), (a, b), (b, b), (b, a))]) for k, (i, n, a, b) in enumerate(rows)]
    return spark.createDataFrame(out, "scan string, ordinal int, id long, num_gates long, lat double, lon double, lat_min double, lat_max double, lon_min double, lon_max double, ring array<struct<lon:double,lat:double>>")


def test_covered_cells_go_and_cover_nothing(spark):
    cells = _boxes(spark, [(1, 100, 0.0, 10.0), (2, 50, 1.0, 11.0), (3, 20, 8.5, 11.0), (4, 10, 1.0, 2.0)])
    assert sorted(r.id for r in match.covered(cells, 80.0).collect()) == [1, 3]


def test_small_cells_merge(spark):
    got = match.merge_cells(_boxes(spark, [(1, 100, 0.0, 1.0), (2, 10, 1.005, 1.1), (3, 10, 5.0, 5.1), (4, 95, 9.0, 10.0), (5, 92, 9.5, 10.5)])).collect()
    assert sorted((r.id, r.num_gates) for r in got) == [(1, 110), (3, 10), (4, 187)]


def test_overlap_groups_of_all_cells(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    rows = [(i, 5, float(a), float(a + w)) for i, (a, w) in enumerate(zip(rnd.random(120) * 40, rnd.choice([0.02, 0.1, 0.6], 120)))]
    group = {i: i for i, *_ in rows}
    for _ in rows:  # the smallest id moves on by one overlap a round
        for (i, _, a, b), (j, _, c, d) in itertools.combinations(rows, 2):
            if a < d and c < b:
                group[i] = group[j] = min(group[i], group[j])
    monkeypatch.setattr(catalog, "_boxed", lambda *_: _boxes(spark, rows))
    got = {r.id: r.group for r in catalog.QUERIES["all_overlap_groups"](spark, SF).collect()}
    assert got == group and 10 < len(set(group.values())) < 100


def test_merging_takes_the_first_overlap_each_time(spark):
    rnd = np.random.default_rng(4)
    rows = [(int(i), int(n), float(a), float(a + w)) for i, (n, a, w) in enumerate(zip(rnd.integers(1, 60, 60), rnd.random(60) * 4, rnd.random(60) * 0.04 + 0.01))] + [(90, 100, 9.0, 9.1)]
    cells = _boxes(spark, rows)
    rest = [[i, n, np.array([(a, a), (a, b), (b, b), (b, a)])] for i, n, a, b in rows[-1:] + rows[:-1]]
    while True:
        pair = next(((i, j) for i, j in itertools.combinations(range(len(rest)), 2) if geometry.overlap_percent(rest[i][2], rest[j][2])[0] > 0), None)
        if pair is None:
            break
        i, j = pair if rest[pair[0]][1] >= rest[pair[1]][1] else pair[::-1]
        rest[i][1:] = rest[i][1] + rest[j][1], geometry.convex_hull(np.concatenate([rest[i][2], rest[j][2]]))
        del rest[j]
    got = match.merge_cells(cells).collect()
    assert len(rest) < 50 and sorted((r.id, r.num_gates) for r in got) == sorted((i, n) for i, n, _ in rest)


def test_merged_cells_hold_the_gates_of_all_cells(spark):
    total = proxies.view(spark, SF, "cells").agg(F.sum("num_gates")).first()[0]
    assert catalog.QUERIES["merged_cells"](spark, SF).agg(F.sum("num_gates")).first()[0] == total


def test_regions_are_detected_on_all_gates(spark, tmp_path):
    gates = [(k, 20 + k // 6, 30 + k % 6, 60.0) for k in range(36)]  # 6 x 6 gates of 90 dBZ
    spark.createDataFrame(gates, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [(r.num_gates, r.max_refl) for r in catalog.QUERIES["detected_regions"](spark, str(tmp_path)).collect()] == [(36, 90.0)]


def test_polygon_queries_take_every_supplier(spark, tmp_path):
    gates = [(k, k // 100, k % 100, 30.0) for k in range(20_000)]
    spark.createDataFrame(gates, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").selectExpr("*", "1 AS l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(9, 13).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(9, 16).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path))
    for name, key in (("grown_labels", "poly_id"), ("label_outlines", "poly_id"), ("detected_cells", "id")):
        assert {r[0] for r in run(name).select(key).collect()} == {10, 11, 12, 13}
    assert {r.id for r in run("integrated_cells").where("MESH IS NOT NULL").collect()} == {10, 11, 12, 13}


def test_attributes(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    polys = spark.createDataFrame([(0, 1, {"MESH": "1"}), (1, 1, {"MESH": "12.5", "VIL": None, "LJA": "x", "SRW02KM": "3"}), (2, 2, {})], "ordinal int, id long, props map<string,string>")
    got = {r.id: r for r in attributes.attributes(cells, polys).collect()}
    assert len(attributes.SOURCES) == 36
    assert (got[1].MESH, got[1].VIL, got[1].VIL_status, got[1].LJA_status, got[1].SRH02km, got[1].PWAT) == (12.5, None, "MATCH_ERROR", "MATCH_ERROR", 3.0, 0.0)
    assert got[2].MESH_status == got[3].MESH_status == "NO_MATCH"


def test_schedule_goldens(spark):
    files = spark.createDataFrame([("A", "a", T[m]) for m in (0, 2, 4)] + [("B", "b", T[m]) for m in (2, 4)] + [("C", "c", None)], "product string, url string, ts timestamp_ntz")
    assert schedule.latest_common(files).first().minute == T[4]
    picks = spark.createDataFrame([("A", "x", T[0] - dt.timedelta(minutes=2)), ("A", "y", T[0]), ("A", "z", T[2])], files.schema)
    times = spark.createDataFrame([(T[0],), (T[1],), (T[0] - dt.timedelta(hours=7),)], "t timestamp_ntz")
    assert {r.t: r.url for r in schedule.as_of(picks, times).collect()} == {T[0]: "y", T[1]: "y"}
    ask = spark.createDataFrame([("A",), ("B",), ("D",)], "product string")
    got = schedule.updates(files.where("product <> 'B'"), files.where("product = 'A' AND ts < TIMESTAMP_NTZ '2025-10-10 12:03:00'"), ask)
    assert {r.product: r.has_update for r in got.collect()} == {"A": True, "B": False, "D": False}
    with pytest.raises(Exception, match="fewer than"):
        schedule.newest_files(files.where("product = 'B'"), 3, by="ts").collect()


def test_cell_files(spark, tmp_path):
    rows = [{"id": "7", "num_gates": 3, "centroid": [40.00005, 280.0], "bbox": [[1, 2], [3, 4]], "max_refl": 50.12345, "storm_history": [{"timestamp": "2025-10-10T12:00:00", "max_refl": 50.0, "num_gates": "3", "centroid": [40.0, 280.0]}]}, {"id": 8, "num_gates": "4", "centroid": [1, 2], "bbox": [], "max_refl": 1, "storm_history": []}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    (tmp_path / "none.json").write_text("[]")
    cells, entries = readers.cells(spark, str(tmp_path / "c.json"))
    assert {r.cell_id: r.num_gates for r in cells.collect()} == {7: 3, 8: 4} and entries.first().ts == T[0]
    out = {r.cell_id: json.loads(r.json) for r in writers.export(cells, entries).collect()}
    assert out[7]["storm_history"][0]["centroid"] == [40.0, 280.0] and out[7]["max_refl"] == 50.1234 and out[8]["storm_history"] == []
    assert readers.cells(spark, str(tmp_path / "none.json"))[0].count() == 0
    # written cells: statuses stand beside numbers, numbers are rounded half to even, entries keep their order, other columns stay out
    found = spark.createDataFrame([(9, 7, 50.00005, 40.00015, 280.0, "ring")], "cell_id long, num_gates long, max_refl double, lat double, lon double, alpha_shape string")
    steps = spark.createDataFrame([(9, k, T[k], 1.0, 7, 40.0, 280.0, 0.12345, -0.00005, 60.0, {"max_flash_density": v}) for k, v in ((1, "2.5"), (0, "N/A"))], "cell_id long, seq int, ts timestamp_ntz, max_refl double, num_gates long, lat double, lon double, dx double, dy double, dt double, metrics map<string,string>")
    cell = json.loads(writers.export(found, steps).first().json)
    assert list(cell) == ["id", "num_gates", "max_refl", "centroid", "storm_history"] and (cell["id"], cell["max_refl"], cell["centroid"]) == (9, 50.0, [40.0002, 280.0])
    assert [(e["timestamp"], e["dx"], e["dy"], e["metrics"]["max_flash_density"]) for e in cell["storm_history"]] == [("2025-10-10T12:00:00", 0.1234, 0.0, "N/A"), ("2025-10-10T12:01:00", 0.1234, 0.0, "2.5")]
    # compressed files are read as they are
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(json.dumps(rows).encode()))
    assert readers.cells(spark, str(tmp_path / "c.json.gz"))[0].count() == 2
    (tmp_path / "p.json.gz").write_bytes(gzip.compress(json.dumps({"features": [{"id": 4, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 4]]]}, "properties": {"VIL": "3"}}]}).encode()))
    assert [(r.id, len(r.rings[0]), r.props["VIL"]) for r in readers.polygons(spark, str(tmp_path / "p.json.gz")).collect()] == [(4, 3, "3")]
    spark.createDataFrame([(1.0, -75.0, float("nan")), (2.0, 10.0, 5.0)], "Latitude double, longitude double, unknown double").write.parquet(str(tmp_path / "g"))
    assert sorted((r.lat, r.lon, r.value) for r in readers.grid(spark, str(tmp_path / "g")).collect()) == [(1.0, 285.0, None), (2.0, 10.0, 5.0)]


def test_grids_limits_statuses_and_times(spark, tmp_path):
    """Limits in 0..360 reach the scan of a file in either convention; what can't be used has a status."""
    west, east = str(tmp_path / "w"), str(tmp_path / "e")
    lons = [-180.0, -90.0, -80.0, -75.0, 0.0, 10.0, 179.0]
    spark.createDataFrame([(float(k), x, 1.0, T[2]) for k, x in enumerate(lons)], "lat double, lon double, unknown double, valid_time timestamp_ntz").write.parquet(west)
    spark.createDataFrame([(float(k), x % 360, 1.0, 1760099696_000_000_000) for k, x in enumerate(lons)], "lat double, lon double, unknown double, `time` long").write.parquet(east)
    for limits, want in (((270.0, 285.0), [1, 2, 3]), ((0.0, 10.0), [4, 5]), ((200.0, 360.0), [1, 2, 3]), ((285.0, 180.0), [0, 3]), ((0.0, 360.0), list(range(7)))):
        for path in (west, east):
            inside = [k for k in want if min(limits) <= lons[k] % 360 <= max(limits)]
            if limits == (285.0, 180.0):
                inside = [k for k in range(7) if 180 <= lons[k] % 360 <= 285]
            assert sorted(r.lat for r in readers.grid(spark, path, lon_limits=limits).collect()) == inside
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = readers.grid(spark, west, lat_limits=(1.0, 3.0), lon_limits=(270.0, 285.0))._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(lon,-90.0)" in pushed and "GreaterThanOrEqual(lat,1.0)" in pushed and "LessThanOrEqual(lon,285.0)" in pushed
    assert readers.grid_time(spark.read.parquet(west), "plain").first().ts == T[2]
    assert readers.grid_time(spark.read.parquet(east), "plain").first().ts == dt.datetime(2025, 10, 10, 12, 34, 56)
    assert readers.grid_time(spark.read.parquet(east), "x_20251010-010203").first().ts == dt.datetime(2025, 10, 10, 1, 2, 3)
    assert readers.grid_time(spark.range(1), "plain").first().ts is None
    spark.createDataFrame([], "lat double, lon double, unknown double").write.parquet(str(tmp_path / "none"))
    spark.createDataFrame([(1.0, 2.0, 3.0)], "lat double, lon double, other double").write.parquet(str(tmp_path / "odd"))
    status = {n: readers.grid_status(spark, str(tmp_path / n)) for n in ("w", "none", "odd", "gone")}
    assert status == {"w": None, "none": "EMPTY_DATASET", "odd": "VAR_NOT_FOUND", "gone": "DATASET_LOAD_ERROR"}
    with pytest.raises(ValueError, match="no column"):
        readers.grid(spark, str(tmp_path / "odd"))
    cells = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0)], "id long, lat_min double, lat_max double, lon_min double, lon_max double")
    gates = spark.createDataFrame([("a", 0.5, 0.5, 7.0)], "product string, lat double, lon double, value double")
    got = spatial.footprint_max(cells, gates, ["a", "b", "c", "d"], {"b": "EMPTY_DATASET", "c": "VAR_NOT_FOUND"}).first()
    assert (got.a, got.a_status, got.b_status, got.c_status, got.d_status) == (7.0, None, "EMPTY_DATASET", "VAR_NOT_FOUND", "N/A")


def test_joins_of_boxes_of_all_sizes(spark):
    """Tiles follow the boxes: tiny ones, a huge one, one point, and limits that are missing or inverted."""
    rnd = np.random.default_rng(2)
    boxes = [(k, float(a), float(a + w), float(b), float(b + w)) for k, (a, b, w) in enumerate(zip(rnd.random(80) * 5, rnd.random(80) * 5, rnd.choice([0.001, 0.05, 0.4], 80)))]
    boxes += [(90, 0.0, 60.0, 0.0, 60.0), (91, 1.0, 1.0, 1.0, 1.0), (92, 2.0, 1.0, 0.0, 5.0), (93, None, 1.0, 0.0, 1.0)]
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rnd.random((300, 2)) * 5)] + [(900, 1.0, 1.0)]
    b = spark.createDataFrame(boxes, "id long, lat_min double, lat_max double, lon_min double, lon_max double")
    p = spark.createDataFrame(points, "k long, lat double, lon double")
    want = sorted((k, i) for k, y, x in points for i, a, c, d, e in boxes if None not in (a, c) and a <= y <= c and d <= x <= e)
    for small in (None, False):
        assert sorted((r.k, r.id) for r in spatial.range_join(p, b, small).collect()) == want
    assert spatial.range_join(p, b.limit(0)).count() == 0 == spatial.range_join(p.limit(0), b).count()
    scan = b.where("id < 92").selectExpr("'s' AS scan", "*")
    real = [r for r in boxes if r[0] < 92]
    meet = sorted((i, j) for (i, a, c, d, e), (j, f, g, h, m) in itertools.combinations(real, 2) if a < g and f < c and d < m and h < e)
    assert sorted((r.a, r.b) for r in spatial.overlapping(scan).collect()) == meet


def test_assignments_are_the_cheapest(spark):
    rnd = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 5), (6, 4), (5, 5), (1, 4)):
        for _ in range(30):
            cost = np.round(rnd.random((n, m)), rnd.integers(1, 4))
            got = match.assign(cost)
            k = min(n, m)
            assert (got >= 0).sum() == k == len(set(got[got >= 0]))
            tall = cost if n <= m else cost.T
            best = min(tall[range(k), list(p)].sum() for p in itertools.permutations(range(max(n, m)), k))
            assert abs(cost[np.flatnonzero(got >= 0), got[got >= 0]].sum() - best) < 1e-9
    place = lambda n: [("s", k, 40 + float(a), 280 + float(b), int(g), 50.0) for k, (a, b, g) in enumerate(zip(rnd.random(n) * 0.4, rnd.random(n) * 0.4, rnd.integers(1, 90, n)))]
    old, new = (spark.createDataFrame(place(n), "scan string, id long, lat double, lon double, num_gates long, max_refl double") for n in (6, 7))
    pairs = {(r.old_id, r.new_id): r.cost for r in match.candidate_pairs(old, new).collect()}
    total = min(sum(pairs.get((k, q), 1.0) for k, q in enumerate(p)) for p in itertools.permutations(range(7), 6))
    found = match.best_matches(old, new).collect()
    assert abs(sum(r.cost for r in found) + 6 - len(found) - total) < 1e-9


def test_tracker_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "cell_id long, ts timestamp_ntz, max_refl double, num_gates long, lat double, lon double"
    scan = lambda t, ids: spark.createDataFrame([(i, T[t], 50.0 + t, 5, 40.0, 280.0) for i in ids], schema).coalesce(1).write.mode("append").parquet(folder)
    scan(0, [1, 2])
    run = lambda: jobs.track(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "state"), str(tmp_path / "cp"), every=None).awaitTermination()
    run()
    scan(1, [2, 3])
    scan(2, [2])
    run()
    state = jobs._stored(spark, str(tmp_path / "state"), 99)
    assert sorted((r.cell_id, r.seq) for r in state.collect()) == [(2, 0), (2, 1), (2, 2)]


def test_tracker_applies_every_scan_of_a_micro_batch(spark, tmp_path):
    """More than ten thousand scans at once: one cell in all, one that misses one, one that comes last, one that ends."""
    folder, n = str(tmp_path / "in"), 10_001
    schema = "cell_id long, ts timestamp_ntz, max_refl double, num_gates long, lat double, lon double"
    at = [T[0] + dt.timedelta(seconds=30 * k) for k in range(n)]
    rows = [(1, at[k], 50.0 + k % 2, 5, 40.0, 280.0) for k in range(n)] + [(2, at[k], 50.0 + k % 2, 5, 41.0, 280.0) for k in range(n) if k != n - 4]
    rows += [(3, at[-1], 50.0, 5, 41.0, 280.0), (3, at[-1], 50.0, 5, 41.0, 280.0), (4, at[-2], 50.0, 5, 41.0, 280.0), (5, None, 50.0, 5, 41.0, 280.0), (None, at[-1], 50.0, 5, 41.0, 280.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    run = lambda: jobs.track(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "state"), str(tmp_path / "cp"), every=None).awaitTermination()
    run()
    state = jobs._stored(spark, str(tmp_path / "state"), 99).orderBy("cell_id", "seq").collect()
    want = [(1, k, at[k]) for k in range(n)] + [(2, k, at[n - 3 + k]) for k in range(3)] + [(3, 0, at[-1])]
    assert [(r.cell_id, r.seq, r.ts) for r in state] == want
    for k in range(3):  # an old scan, and two new ones
        spark.createDataFrame([(1, at[-1] + dt.timedelta(seconds=30 * k), 9.0, 5, 40.0, 280.0)], schema).coalesce(1).write.mode("append").parquet(folder)
        run()
    state = jobs._stored(spark, str(tmp_path / "state"), 99).orderBy("seq").collect()
    assert [(r.cell_id, r.seq) for r in state] == [(1, k) for k in range(n + 1)] and state[-1].max_refl == 9.0
    assert len(list((tmp_path / "state").glob("batch=*"))) == jobs.VERSIONS


def test_streamed_files_are_kept_for_some_minutes(spark, tmp_path):
    folder, found = str(tmp_path / "in"), []
    schema = "product string, url string, ts timestamp_ntz"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: jobs.retained(spark.readStream.schema(schema).parquet(folder)).writeStream.foreachBatch(lambda df, n: found.extend(r.url for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    put([("A", "a", T[0]), ("A", "b", T[0] + dt.timedelta(hours=1)), ("A", "n", None)])
    run()
    put([("A", "c", T[0] + dt.timedelta(minutes=30)), ("A", "d", T[0] + dt.timedelta(minutes=50)), ("A", "b", T[0] + dt.timedelta(hours=1))])
    run()
    assert sorted(found) == ["a", "b", "d"]


def test_kept_entries_compare_with_the_last_kept(spark):
    h = lambda rows: spark.createDataFrame([(c, k, T[t], x, y) for k, (c, t, x, y) in enumerate(rows)], "cell_id long, seq int, ts timestamp_ntz, x double, y double").repartition(3)
    rows = [(1, 1, 1.0, 1.0), (1, 1, 2.0, 1.0), (1, 2, 2.0, 1.0), (2, 1, 1.0, 1.0), (2, 2, 1.0, 1.0), (2, 2, 3.0, 1.0), (3, 1, None, 1.0), (3, 2, None, 1.0), (3, 3, float("nan"), 1.0), (3, 4, float("nan"), 1.0)]
    assert sorted(r.seq for r in history.kept_entries(h(rows), ["x", "y"]).collect()) == [0, 2, 3, 5, 6, 7, 8]
    long = h([(7, k % 5, float(k % 3), 1.0) for k in range(30_000)])
    assert history.kept_entries(long, ["x", "y"]).count() > 10_000


def test_poll_moves_forward_only(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    schema = "product string, ts timestamp_ntz"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: jobs.poll(spark.readStream.schema(schema).parquet(folder), lambda s, m: seen.append(m), str(tmp_path / "cp"), every=None).awaitTermination()
    put([("A", T[1]), ("B", T[1]), ("A", T[3])])
    run()
    put([("A", T[0]), ("B", T[0])])
    run()
    put([("B", T[3])])
    run()
    assert seen == [T[1], T[3]]


def test_histories_are_dealt_out_by_cell_also_behind_a_join(spark, tmp_path):
    """A join by the cell may still become a broadcast at run time, so its dealing out can't replace that of the appends."""
    schema = "cell_id long, seq int, ts timestamp_ntz, v string"
    spark.createDataFrame([(i, k, T[k], "a") for k in range(6) for i in range(40)], schema).write.parquet(str(tmp_path / "h"))
    h = spark.read.schema(schema).parquet(str(tmp_path / "h"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        kept = history.kept_entries(h.join(h.select("cell_id").distinct(), "cell_id", "left_semi"), ["v"])
        assert sorted((r.cell_id, r.seq) for r in kept.collect()) == [(i, 0) for i in range(40)]
        assert "REPARTITION_BY_COL" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def _copies(rnd, n, step):
    """Cells at few places and of few sizes, so that many are alike."""
    return [(f"s{k % 2}", k * step % 997, 40 + int(rnd.integers(4)) * 0.04, 280 + int(rnd.integers(3)) * 0.05, int(rnd.integers(1, 4)), float(rnd.integers(2))) for k in range(n)]


CELL = "scan string, id long, lat double, lon double, num_gates long, max_refl double"


def test_transport_equals_single_copies():
    rnd = np.random.default_rng(4)
    for _ in range(150):
        n, m = rnd.integers(1, 6, 2)
        r, c = np.nonzero(rnd.random((n, m)) < rnd.random())
        cost, supply, demand = np.round(rnd.random(len(r)), int(rnd.integers(1, 4))), rnd.integers(1, 5, n), rnd.integers(1, 5, m)
        used = match.transport(r, c, cost, 1.0, supply, demand)
        assert (used >= 0).all() and (np.bincount(r, used, minlength=n) <= supply).all() and (np.bincount(c, used, minlength=m) <= demand).all()
        pairs = [(i, j, x) for a, b, x in zip(r, c, cost) for i in range(supply[:a].sum(), supply[: a + 1].sum()) for j in range(demand[:b].sum(), demand[: b + 1].sum())]
        i, j, x = (np.array(k, t) for k, t in zip(zip(*pairs), (int, int, float))) if pairs else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        assert abs((used * (cost - 1)).sum() - (x[match.assign_sparse(i, j, x, 1.0)] - 1).sum()) < 1e-9


def test_matches_of_copies(spark, monkeypatch):
    """Cells that are alike cost one pair for all of them, and are matched as if each had its own."""
    rnd = np.random.default_rng(8)
    old, new = (spark.createDataFrame(_copies(rnd, n, step), CELL) for n, step in ((180, 7), (150, 11)))
    rows = {(r.scan, r.old_id, r.new_id): r.cost for r in match.candidate_pairs(old, new).collect()}
    listed = {(r.scan, r.old_id, r.new_id): r.cost for r in match._kind_pairs(old, new).collect()}
    assert rows == listed and len(rows) > 3000
    compared, plain = [], match._kind_pairs
    monkeypatch.setattr(match, "_kind_pairs", lambda a, b: compared.append(plain(a, b).count()) or plain(a, b))
    taken, used = {}, set()
    for (s, i, j), c in sorted(rows.items(), key=lambda x: (x[1], x[0][1], x[0][2])):
        if c < 1 and not {(s, 0, i), (s, 1, j)} & used:
            used |= {(s, 0, i), (s, 1, j)}
            taken[s, i, j] = c
    assert {(r.scan, r.old_id, r.new_id): r.cost for r in match.greedy_cells(old, new).collect()} == taken
    best = match.best_matches(old, new).collect()
    assert all(rows[r.scan, r.old_id, r.new_id] == r.cost for r in best)
    assert len({(r.scan, r.old_id) for r in best}) == len(best) == len({(r.scan, r.new_id) for r in best})
    total = 0.0
    for s in ("s0", "s1"):
        a, b = (sorted({k[n] for k in rows if k[0] == s}) for n in (1, 2))
        cost = np.array([[rows.get((s, i, j), 1.0) for j in b] for i in a])
        got = match.assign(cost)
        total += (cost[np.flatnonzero(got >= 0), got[got >= 0]] - 1).sum()
    assert abs(sum(r.cost - 1 for r in best) - total) < 1e-9
    assert len(compared) == 2 and max(compared) < len(rows) / 2


def test_candidates_of_repeated_rows_and_ids(spark):
    a = [("s", 5, 40.0, 280.0, 3, 1.0), ("s", 5, 40.0, 280.0, 3, 1.0), ("s", 5, 40.05, 280.0, 3, 1.0), ("s", None, 40.0, 280.0, 3, 1.0), ("s", 6, 40.0, 280.0, None, 1.0), (None, 7, 40.0, 280.0, 3, 1.0)]
    b = [("s", 5, 40.0, 280.0, 3, 1.0), ("s", None, 40.01, 280.0, 2, 1.0), ("s", 8, 40.01, 280.0, 2, None)]
    old, new = spark.createDataFrame(a, CELL), spark.createDataFrame(b, CELL)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(match.candidate_pairs(old, new)) == rows(match._kind_pairs(old, new)) and len(rows(match._kind_pairs(old, new))) == 15
