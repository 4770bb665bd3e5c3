import numpy as np
import pandas as pd
import pytest

from cellcast.operators import cells, grow, spatial


def frames(spark, value, label):
    rows = [("s", i, j, float(i), 280.0 + j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(np.atleast_2d(np.array(value, float)))]
    labels = [("s", i, j, int(x)) for (i, j), x in np.ndenumerate(np.atleast_2d(np.array(label))) if x]
    return spark.createDataFrame(rows, "scan string, i int, j int, lat double, lon double, value double"), spark.createDataFrame(labels, "scan string, i int, j int, poly_id long")


def slow(value, label, rounds=100):
    value, label = np.atleast_2d(np.array(value, float)), np.atleast_2d(np.array(label))
    for _ in range(rounds):
        new = label.copy()
        for (i, j), v in np.ndenumerate(value):
            if label[i, j] == 0 and v >= 40:
                near = [label[a, b] for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < value.shape[0] and 0 <= b < value.shape[1]]
                new[i, j] = max([0, *near])
        if (new == label).all():
            break
        label = new
    return label


def grown(spark, value, label, **more):
    gates, labels = frames(spark, value, label)
    out = np.zeros_like(np.atleast_2d(np.array(label)))
    for r in grow.expand(gates, labels, **more).collect():
        out[r.i, r.j] = r.poly_id
    return out


@pytest.mark.parametrize("value,label,want", [([1, 45, 1], [3, 0, 7], [3, 7, 7]), ([1, 45, 45, 45, 1], [3, 0, 0, 0, 7], [3, 3, 7, 7, 7]), ([1, 39.9, 45], [3, 0, 0], [3, 0, 0]), ([1, np.nan, 45], [3, 0, 0], [3, 0, 0]), ([1, 45, 45], [-3, 0, 0], [-3, 0, 0])])
def test_growth_goldens(spark, value, label, want):
    assert grown(spark, value, label).tolist() == [want]


@pytest.mark.parametrize("tile,rounds", [(4, 100), (256, 100), (5, 3)])
def test_growth_against_brute_force(spark, tile, rounds):
    rnd = np.random.default_rng(tile)
    value = np.where(rnd.random((17, 14)) < 0.7, 45, 10)
    label = np.where(rnd.random((17, 14)) < 0.05, rnd.integers(-1, 9, (17, 14)), 0)
    assert (grown(spark, value, label, tile=tile, rounds=rounds) == slow(value, label, rounds)).all()


def test_components_across_tiles(spark):
    value = np.zeros((9, 9))
    value[1, :] = value[:, 4] = 55
    value[7, 0] = 55
    got = grow.components(frames(spark, value, value * 0)[0], tile=3).collect()
    roots = {(r.i, r.j): (r.root_i, r.root_j) for r in got}
    assert set(roots.values()) == {(0, 4), (7, 0)} and len(roots) == (value > 0).sum()


def test_competing_regions_share_gates():
    pdf = pd.DataFrame([(0, j, v) for j, v in enumerate([55, 45, 45, 45, 55, 10, 45])], columns=["i", "j", "value"])
    got = grow.compete(pdf)
    assert sorted(zip(got.region, got.j)) == [(1, 0), (1, 1), (1, 2), (2, 2), (2, 3), (2, 4)]
    assert len(grow.compete(pdf[pdf.value < 1])) == 0


def test_summary_goldens(spark):
    gates = spark.createDataFrame([("s", 0, 0, 40.0, 280.0, 40.0), ("s", 1, 0, 40.01, 280.0, 45.0), ("s", 2, 0, 40.02, 280.0, 50.0), ("s", 5, 5, 1.0, 2.0, None), ("s", 5, 6, 1.0, 2.0, 41.0), ("s", 5, 7, 1.0, 2.0, 50.0), ("s", 9, 9, 1.0, 2.0, None)], "scan string, i int, j int, lat double, lon double, value double")
    labels = spark.createDataFrame([("s", 0, 0, 1), ("s", 1, 0, 1), ("s", 2, 0, 1), ("s", 5, 5, 2), ("s", 5, 6, 2), ("s", 5, 7, 2), ("s", 9, 9, 3)], "scan string, i int, j int, poly_id long")
    got = {r.id: r for r in cells.summarise(labels, gates).collect()}
    assert abs(got[1].lat - 40.0199321726) < 1e-9 and (got[2].num_gates, got[2].max_refl) == (3, 50.0)
    assert (got[3].num_gates, got[3].max_refl, got[3].lat) == (1, None, None)


def polygons(spark, rows):
    return spark.createDataFrame([(k, i, [[{"lon": x - 360, "lat": y} for x, y in r]], {}) for k, (i, r) in enumerate(rows)], "ordinal int, id long, rings array<array<struct<lon:double,lat:double>>>, props map<string,string>")


def test_first_polygon_wins(spark):
    box = lambda a, b: [(a, 0.0), (b, 0.0), (b, 2.0), (a, 2.0)]
    gates = spark.createDataFrame([("s", 0, 0, 1.0, 281.0), ("s", 0, 1, 1.0, 283.0), ("s", 0, 2, 1.0, 284.0), ("s", 0, 3, 1.0, 290.0)], "scan string, i int, j int, lat double, lon double")
    got = spatial.assign_gates(gates, polygons(spark, [(9, box(280.0, 282.0)), (4, box(280.0, 284.0)), (0, box(280.0, 300.0)), (5, box(289.0, 291.0))]), ("scan", "i", "j")).collect()
    assert {r.j: r.poly_id for r in got} == {0: 9, 1: 4, 3: 5}


def test_footprint_skips_negative_values(spark):
    gates = spark.createDataFrame([("p", 1.0, 1.0, v) for v in (-3.0, 0.0, None, 7.0)] + [("q", 1.0, 1.0, -3.0)], "product string, lat double, lon double, value double")
    cells_ = spark.createDataFrame([(1, 1.0, 2.0, 0.0, 1.0), (2, 50.0, 51.0, 50.0, 51.0)], "id long, lat_min double, lat_max double, lon_min double, lon_max double")
    for small in (None,):
        got = {r.id: r for r in spatial.footprint_max(cells_, gates, ["p", "q"]).collect()}
    assert (got[1].p, got[1].p_status, got[1].q, got[1].q_status) == (7.0, None, None, "N/A") and got[2].p_status == "N/A"
    both = [spatial.range_join(gates, cells_, small=s).count() for s in (True, False)]
    assert both == [5, 5]


def test_footprints_join_distinct_places_with_distinct_boxes(spark, monkeypatch):
    gates = spark.createDataFrame([(p, float(k % 5), 1.0, float(k)) for p in ("p", "q") for k in range(500)], "product string, lat double, lon double, value double")
    cells_ = spark.createDataFrame([(k, float(k % 3), float(k % 3) + 1, 0.0, 1.0) for k in range(90)] + [(900, None, 1.0, 0.0, 1.0)], "id long, lat_min double, lat_max double, lon_min double, lon_max double")
    sizes, join = [], spatial.range_join
    monkeypatch.setattr(spatial, "range_join", lambda points, boxes, **k: sizes.append((points.count(), boxes.count())) or join(points, boxes, **k))
    got = {r.id: (r.p, r.q) for r in spatial.footprint_max(cells_, gates, ["p", "q"]).collect()}
    assert sizes == [(5, 4)]
    assert got == {k: (496.0 + k % 3, 496.0 + k % 3) for k in range(90)} | {900: (None, None)}
