"""Several scans with shared ids, times to come, rounds and parts in place of groups by scan, and streams."""

import datetime as dt
import itertools
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.functions import geometry, scalars
from cellcast.operators import graph, match, spatial
from cellcast.plans import catalog, pipeline
from cellcast.sources import scratch
from cellcast.streaming import jobs

T = [dt.datetime(2025, 10, 10, 12, m) for m in range(30)]
FUTURE = dt.datetime(2099, 1, 1)
BOXES = "scan string, ordinal int, id long, num_gates long, lat double, lon double, lat_min double, lat_max double, lon_min double, lon_max double, ring array<struct<lon:double,lat:double>>"


def boxes(spark, rows):
    """rows: scan, id, num_gates, lat_min, lat_max, lon_min, lon_max."""
    ring = lambda a, b, c, d: [{"lon": x, "lat": y} for y, x in ((a, c), (b, c), (b, d), (a, d))]
    return spark.createDataFrame([(s, k, i, n, (a + b) / 2, (c + d) / 2, a, b, c, d, ring(a, b, c, d)) for k, (s, i, n, a, b, c, d) in enumerate(rows)], BOXES)


def random_scans(seed, scans, n, spread, sizes):
    rnd = np.random.default_rng(seed)
    rows = []
    for s in range(scans):
        for i in range(n):  # ids are the same in every scan
            a, c, h, w = (float(x) for x in (*rnd.random(2) * spread, *rnd.choice(sizes, 2)))
            rows.append((f"s{s}", i, int(rnd.integers(1, 60)), a, a + h, c, c + w))
    return rows


# --- several scans ---------------------------------------------------------------------------------------------------------


def test_groups_stay_within_a_scan(spark):
    cells = boxes(spark, [("s1", 1, 5, 0.0, 1.0, 0.0, 1.0), ("s1", 2, 5, 0.5, 1.5, 0.5, 1.5), ("s2", 2, 5, 0.0, 1.0, 0.0, 1.0), ("s2", 3, 5, 0.5, 1.5, 0.5, 1.5)])
    pairs = spatial.overlapping(cells)
    assert sorted(tuple(r) for r in pairs.collect()) == [("s1", 1, 2), ("s2", 2, 3)]
    assert sorted(tuple(r) for r in match.overlap_groups(pairs, cells).collect()) == [("s1", 1, 1), ("s1", 2, 1), ("s2", 2, 2), ("s2", 3, 2)]


def test_cells_of_two_scans_take_their_own_gates(spark):
    cells = spark.createDataFrame([(s, i, 0.5 + i, 0.5) for s in ("s1", "s2") for i in (1, 2)], "scan string, id long, lat double, lon double").withColumn("bbox", F.expr("array()").cast("array<struct<lat:double,lon:double>>"))
    gates = spark.createDataFrame([("s1", "a", 1.5, 0.5, 7.0), ("s2", "a", 1.5, 0.5, 9.0), ("s2", "a", 2.5, 0.5, 3.0)], "scan string, product string, lat double, lon double, value double")
    polygons = spark.createDataFrame([("s1", 0, 1, {"VIL": "4"}), ("s2", 0, 1, {"VIL": "5"})], "scan string, ordinal int, id long, props map<string,string>")
    got = {(r.scan, r.id): (r.a, r.VIL) for r in pipeline.integrate(cells, gates, polygons, ["a"]).collect()}
    assert got == {("s1", 1): (7.0, 4.0), ("s1", 2): (None, None), ("s2", 1): (9.0, 5.0), ("s2", 2): (3.0, None)}
    # a grid without scans counts for all
    got = {(r.scan, r.id): r.a for r in pipeline.integrate(cells, gates.drop("scan").where("value > 8"), polygons, ["a"]).collect()}
    assert got == {("s1", 1): 9.0, ("s1", 2): None, ("s2", 1): 9.0, ("s2", 2): None}


def test_no_query_is_defined_twice():
    with pytest.raises(ValueError, match="two queries"):
        catalog.query()(catalog.QUERIES["source_catalog"])


# --- tiles ---------------------------------------------------------------------------------------------------------------------


def test_boxes_of_six_orders_of_magnitude_cover_few_tiles(spark):
    rnd = np.random.default_rng(5)
    rows = [("s", k, 1, float(a), float(a + w), float(b), float(b + h)) for k, (a, b, w, h) in enumerate(zip(rnd.random(300) * 50, rnd.random(300) * 50, 10 ** rnd.uniform(-5, -1, 300), 10 ** rnd.uniform(-5, -1, 300)))]
    rows += [("s", 900, 1, 0.0, 50.0, 0.0, 50.0), ("s", 901, 1, -1e9, 1e9, -1e9, 1e9), ("s", 902, 1, 3.0, 3.0, 4.0, 4.0)]
    cells = boxes(spark, rows)
    box = tuple(F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
    tiles = spatial._dealt(spatial._whole(cells, box), box, F.col("_own")).groupBy("id").count()
    assert tiles.agg(F.max("count")).first()[0] <= 9
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(rnd.random((300, 2)) * 50)] + [(1000 + k, r[3], r[5]) for k, r in enumerate(rows[:100])]
    got = spatial.range_join(spark.createDataFrame(points, "k long, lat double, lon double"), cells.select("id", "lat_min", "lat_max", "lon_min", "lon_max"))
    assert sorted((r.k, r.id) for r in got.collect()) == sorted((k, r[1]) for k, y, x in points for r in rows if r[3] <= y <= r[4] and r[5] <= x <= r[6])
    want = sorted((min(p[1], q[1]), max(p[1], q[1])) for p, q in itertools.combinations(rows, 2) if p[3] < q[4] and q[3] < p[4] and p[5] < q[6] and q[5] < p[6])
    assert sorted((r.a, r.b) for r in spatial.overlapping(cells).collect()) == want
    small, large = cells.where("id % 2 = 0"), cells.where("id % 2 = 1").select("scan", F.col("id").alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in ("lat_min", "lat_max", "lon_min", "lon_max")])
    got = {(r.id, r.l_id) for r in spatial.beside(small.where("id < 901"), large, 5.0).collect()}
    lat = 5.0 / scalars.DEGREE_KM
    lon = lambda r: 5.0 / (scalars.DEGREE_KM * np.cos(np.radians((r[3] + r[4]) / 2)))
    assert got == {(p[1], q[1]) for p in rows if p[1] % 2 == 0 and p[1] < 901 for q in rows if q[1] % 2 and not (p[6] + lon(p) < q[5] or p[5] - lon(p) > q[6] or p[4] + lat < q[3] or p[3] - lat > q[4])}


# --- termination, merging, assignment --------------------------------------------------------------------------------------------


def slow_covered(rows, percent):
    out = set()
    for scan in {r[0] for r in rows}:
        alive = []
        for k, r in sorted(((k, r) for k, r in enumerate(rows) if r[0] == scan), key=lambda x: (-x[1][2], x[0])):
            area = (r[4] - r[3]) * (r[6] - r[5])
            share = lambda o: 100 * max(0, min(r[4], o[4]) - max(r[3], o[3])) * max(0, min(r[6], o[6]) - max(r[5], o[5])) / area  # noqa: B023, E731
            if not any(share(o) >= percent for o in alive):
                alive.append(r)
                out.add((scan, r[1]))
    return out


def test_termination_peels_scans_in_rounds(spark):
    rows = random_scans(7, 3, 60, 3.0, [0.2, 0.5, 1.0])
    rounds = []
    got = {(r.scan, r.id) for r in match.covered(boxes(spark, rows), 60.0, rounds=rounds).collect()}
    assert got == slow_covered(rows, 60.0) and len(got) < 180
    assert 1 <= len(rounds) <= 8 and rounds == sorted(rounds, reverse=True)
    chain = [("s", k, 100 - k, 0.0, 1.0, 0.2 * k, 0.2 * k + 1.0) for k in range(9)]  # each covers the next by 80 %, none the one after
    rounds = []
    assert sorted(r.id for r in match.covered(boxes(spark, chain), 75.0, rounds=rounds).collect()) == [0, 2, 4, 6, 8] and len(rounds) == 4
    with pytest.raises(ValueError):
        match.covered(boxes(spark, chain), 0.0)


def slow_merged(rows, ratio=0.9):
    """All cells of a scan in one list, as the rule says it; small cells have no large neighbour here."""
    out = []
    for scan in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == scan]
        floor = ratio * max(r[2] for r in own)
        rest = [[r[1], r[2], np.array([(r[5], r[3]), (r[5], r[4]), (r[6], r[4]), (r[6], r[3])])] for r in (*[r for r in own if r[2] >= floor], *[r for r in own if r[2] < floor])]
        while pair := next(((i, j) for i, j in itertools.combinations(range(len(rest)), 2) if geometry.overlap_percent(rest[i][2], rest[j][2])[0] > 0), None):
            i, j = pair if rest[pair[0]][1] >= rest[pair[1]][1] else pair[::-1]
            rest[i][1:] = rest[i][1] + rest[j][1], geometry.convex_hull(np.concatenate([rest[i][2], rest[j][2]]))
            del rest[j]
        out += [(scan, i, n) for i, n, _ in rest]
    return sorted(out)


def test_merging_by_parts_equals_whole_scans(spark):
    rows = random_scans(11, 3, 40, 4.0, [0.1, 0.3, 0.6])
    rows += [(f"s{k}", 99, 1000, 50.0, 50.1, 50.0, 50.1) for k in range(3)]  # the only large cell of each scan, far away
    cells = boxes(spark, rows)
    assert sorted((r.scan, r.id, r.num_gates) for r in match.merge_cells(cells).collect()) == slow_merged(rows)
    keyed = scratch.cut(cells.withColumn("_k", F.monotonically_increasing_id()))
    parts = match.separate(keyed, 1.0)
    assert parts.count() == len(rows) and 3 < parts.select("part").distinct().count() < len(rows)


def test_large_scans_fall_into_many_parts(spark):
    rnd = np.random.default_rng(2)
    rows = [("s", k, int(n), float(a), float(a + 0.02), float(b), float(b + 0.02)) for k, (n, a, b) in enumerate(zip(rnd.integers(1, 60, 4000), rnd.random(4000) * 60, rnd.random(4000) * 60))]
    cells = scratch.cut(boxes(spark, rows).withColumn("_k", F.monotonically_increasing_id()))
    sizes = [r["count"] for r in match.separate(cells, 1.0).groupBy("part").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 2000 and max(sizes) < 100


def test_sparse_assignment_is_the_cheapest():
    rnd = np.random.default_rng(8)
    for n, m in ((1, 1), (3, 5), (6, 4), (5, 5), (6, 6)):
        for _ in range(40):
            cost = np.where(rnd.random((n, m)) < 0.6, np.round(rnd.random((n, m)), rnd.integers(1, 4)), 1.0)
            r, c = np.nonzero(cost < 1)
            got = match.assign_sparse(r, c, cost[r, c], 1.0)
            assert len(set(r[got])) == len(got) == len(set(c[got]))
            tall = cost if n <= m else cost.T
            k = min(n, m)
            best = min(tall[range(k), list(p)].sum() for p in itertools.permutations(range(max(n, m)), k))
            assert abs(cost[r[got], c[got]].sum() + k - len(got) - best) < 1e-9
    cost = rnd.random((120, 150))
    r, c = np.indices(cost.shape).reshape(2, -1)
    dense = match.assign(cost)
    assert abs(cost[r, c].reshape(cost.shape)[range(120), dense].sum() - cost.ravel()[match.assign_sparse(r, c, cost.ravel(), 1.0)].sum()) < 1e-9


def test_matches_of_several_scans(spark):
    rnd = np.random.default_rng(9)
    schema = "scan string, id long, lat double, lon double, num_gates long, max_refl double"
    place = lambda n: [(f"s{s}", k, 60 + float(rnd.random() * 0.5), 359.9 + float(rnd.random()), int(rnd.integers(1, 90)), 50.0) for s in range(2) for k in range(n)]
    old, new = place(40), place(45)
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    pairs = {(r.scan, r.old_id, r.new_id): r.cost for r in match.candidate_pairs(a, b).collect()}
    near = {(p[0], p[1], q[1]) for p in old for q in new if p[0] == q[0] and abs(p[2] - q[2]) * 111 <= 10 and abs(p[3] - q[3]) * 111 * np.cos(np.radians((p[2] + q[2]) / 2)) <= 10}
    assert set(pairs) == near and 50 < len(near) < 3600
    total = 0.0
    for s in ("s0", "s1"):
        cost = np.ones((40, 45))
        for (scan, i, j), c in pairs.items():
            if scan == s:
                cost[i, j] = c
        total += cost[range(40), match.assign(cost)].sum()
    found = match.best_matches(a, b).collect()
    assert abs(sum(r.cost for r in found) + 80 - len(found) - total) < 1e-9
    assert len({(r.scan, r.old_id) for r in found}) == len(found) == len({(r.scan, r.new_id) for r in found})
    taken, used = set(), set()
    for (s, i, j), c in sorted(pairs.items(), key=lambda x: (x[1], x[0][1], x[0][2])):
        if c < 1 and not {(s, "old", i), (s, "new", j)} & used:
            used |= {(s, "old", i), (s, "new", j)}
            taken.add((s, i, j))
    assert {(r.scan, r.old_id, r.new_id) for r in match.greedy_matches(match.candidate_pairs(a, b)).collect()} == taken


# --- times to come ------------------------------------------------------------------------------------------------------------------


def write(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_a_time_to_come_does_not_stop_polling(spark, tmp_path):
    folder, schema, seen = str(tmp_path / "in"), "product string, url string, ts timestamp_ntz", []
    run = lambda: jobs.poll(spark.readStream.schema(schema).parquet(folder), lambda s, m: seen.append(m), str(tmp_path / "cp"), every=None).awaitTermination()
    write(spark, [("a", "x", T[1]), ("b", "x", T[1]), ("a", "x", FUTURE), ("b", "x", FUTURE)], schema, folder)
    run()
    write(spark, [("a", "y", T[3]), ("b", "y", T[3])], schema, folder)
    run()
    assert seen == [T[1], T[3]]


def test_a_time_to_come_moves_no_watermark(spark, tmp_path):
    schema = "product string, url string, cell_id long, ts timestamp_ntz"

    def run(name, of):
        folder, found = str(tmp_path / name), []
        for k, rows in enumerate(([("a", "u", 1, T[0]), ("b", "u", 2, T[0]), ("a", "z", 9, FUTURE)], [("a", "v", 3, T[1]), ("b", "v", 4, T[1])], [("a", "w", 5, T[29])])):
            write(spark, rows, schema, folder)
            of(spark.readStream.schema(schema).parquet(folder)).writeStream.foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()
        return found

    assert sorted(r.url for r in run("retained", jobs.retained)) == ["u", "u", "v", "v", "w"]
    assert sorted(r.cell_id for r in run("once", jobs.once)) == [1, 2, 3, 4, 5]
    assert [r.start for r in run("windows", lambda s: jobs.complete_windows(s, 2, "1 minute", "5 minutes"))] == [T[0], T[1]]


# --- streams --------------------------------------------------------------------------------------------------------------------------


def test_streams_leave_no_scratch_tables(spark, tmp_path):
    scratch.place(spark)
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    folder = str(tmp_path / "in")
    schema = "cell_id long, ts timestamp_ntz, max_refl double, num_gates long, lat double, lon double"
    for k in range(20):
        write(spark, [(1, T[k], 50.0 + k, 5, 40.0, 280.0)], schema, folder)
    before = set(os.listdir(top.removeprefix("file:")))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.track(stream, str(tmp_path / "state"), str(tmp_path / "cp"), every=None).awaitTermination()
    assert set(os.listdir(top.removeprefix("file:"))) <= before
    assert jobs._stored(spark, str(tmp_path / "state"), 99).count() == 20


def test_tracks_survive_a_restart_and_forget_what_ended(spark, tmp_path):
    folder, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "cell_id long, ts timestamp_ntz, max_refl double, num_gates long, lat double, lon double"
    entry = lambda i, t, refl=50.0, lat=40.0: (i, T[t], refl, 5, lat, 280.0)
    scans = [
        [entry(1, 0), entry(2, 0), entry(None, 0)],
        [entry(1, 1), entry(2, 1, 51.0), entry(3, 1), entry(3, 1, 60.0), (None, None, None, None, None, None)],  # an equal entry, one of two counts
        [entry(2, 2, 51.0, 40.1), entry(1, 0, 70.0)],  # 1 and 3 end; an older scan changes nothing
        [],
        [entry(1, 4), entry(2, 4, None), (5, FUTURE, 1.0, 1, 1.0, 1.0), (None, FUTURE, 1.0, 1, 1.0, 1.0)],
    ]
    for k, rows in enumerate(scans):
        spark.createDataFrame([*rows, (None, T[k], None, None, None, None)], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.01)
        query = jobs.start_tracks(spark.readStream.schema(schema).parquet(folder), path, checkpoint, every=None, shards=3)
        query.awaitTermination()
    got = sorted(((r.cell_id, r.life.minute, r.seq, r.ts.minute, r.max_refl, r.dt, r.ended) for r in spark.read.parquet(path).collect()), key=str)
    want = [
        (1, 0, 0, 0, 50.0, None, False), (2, 0, 0, 0, 50.0, None, False), (2, 0, 1, 1, 51.0, 60.0, False), (3, 1, 0, 1, 50.0, None, False), (1, 0, 0, 1, 50.0, None, True), (3, 1, 0, 1, 50.0, None, True),
        (2, 0, 2, 2, 51.0, 60.0, False), (2, 0, 2, 2, 51.0, None, True), (1, 4, 0, 4, 50.0, None, False), (2, 4, 0, 4, None, None, False),
    ]
    assert got == sorted(want, key=str)
    moved = spark.read.parquet(path).where("cell_id = 2 AND seq = 2 AND NOT ended").first()
    assert abs(moved.dy - 0.1 * scalars.DEGREE_M) < 1e-6 and abs(moved.dx) < 1e-6
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 3 + 2 + 3  # a time for each shard, and two living cells


# --- growth and picks in time ------------------------------------------------------------------------------------------------------------


def test_competing_regions_by_tiles_equal_whole_scans(spark):
    from cellcast.operators import grow

    rnd = np.random.default_rng(12)
    rows = [(f"s{s}", i, j, v) for s in range(2) for i in range(40) for j in range(37) if (v := float(rnd.choice([20, 42, 45, 55], p=[0.25, 0.35, 0.32, 0.08]))) > 20 or rnd.random() < 0.5]
    gates = spark.createDataFrame([*rows, ("s0", 99, 99, None), ("s1", -7, -5, 60.0), ("s1", -8, -6, 44.0)], "scan string, i int, j int, value double")
    for rounds, tile in ((100, 8), (2, 8), (100, 16)):
        got = {tuple(r) for r in grow.competing_regions(gates, rounds=rounds, tile=tile).collect()}
        want = set()
        for s in ("s0", "s1"):
            pdf = gates.where(f"scan = '{s}' AND value IS NOT NULL").toPandas()
            want |= {(s, *map(int, r)) for r in grow.compete(pdf, rounds=rounds).itertuples(index=False)}
        assert got == want and len({(s, i, j) for s, _, i, j in want}) < len(want)
    assert grow.competing_regions(gates.where("value < 50")).count() == 0


def test_as_of_picks_carry_over_buckets(spark):
    from cellcast.operators import schedule

    rnd = np.random.default_rng(13)
    start = dt.datetime(2025, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=int(s))
    files = [("hot", f"h{k}", at(s)) for k, s in enumerate(rnd.integers(0, 90_000, 600))] + [("rare", f"r{k}", at(s)) for k, s in enumerate(rnd.integers(0, 90_000, 6))]
    files += [("hot", "tie a", at(500)), ("hot", "tie b", at(500)), ("none", "x", None), ("far", "f", at(0))]
    times = [at(s) for s in (*rnd.integers(-5000, 100_000, 80), 0, 500, 21_600, 21_601, 500)]
    for hours in (6, 1):
        back = dt.timedelta(hours=hours)
        want = set()
        for t in times:
            for product in ("hot", "rare", "none", "far"):
                found = [(ts, url) for p, url, ts in files if p == product and ts is not None and t - back <= ts <= t]
                if found:
                    want.add((product, t, max(found)[1], max(found)[0]))
        got = schedule.as_of(spark.createDataFrame(files, "product string, url string, ts timestamp_ntz"), spark.createDataFrame([(t,) for t in times] + [(None,)], "t timestamp_ntz"), back)
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)


# --- copies ------------------------------------------------------------------------------------------------------------------------


def test_copies_of_boxes_are_linked_once(spark):
    rows = [("s", 100 * c + k, 5, float(k), k + 1.2, 0.0, 1.0) for k in range(4) for c in range(50)]
    rows += [("s", 900 + k, 5, 20.0, 20.0, 0.0, 1.0) for k in range(3)] + [("s", 950 + k, 5, 30.0, 30.0, 0.5, 0.5) for k in range(2)] + [("s", 960, 5, 29.0, 31.0, 0.0, 1.0)]
    cells = boxes(spark, rows)
    links = spatial.linked(cells)
    # lines without area overlap boxes around them, but not their own copies
    assert links.count() == 4 * 49 + 3 + 2
    groups = lambda pairs: sorted((r.id, r.group) for r in match.overlap_groups(pairs, cells).collect())
    assert groups(links) == groups(spatial.overlapping(cells))


def test_copies_are_terminated_by_their_first(spark):
    rows = [("s", k, 50, 0.0, 1.0, 0.0, 1.0) for k in range(60)] + [("s", 100 + k, 40, 0.0, 1.0, 0.2, 1.2) for k in range(60)] + [("s", 200 + k, 30, 5.0, 5.0, 0.0, 1.0) for k in range(3)]
    rounds = []
    got = {(r.scan, r.id) for r in match.covered(boxes(spark, rows), 60.0, rounds=rounds).collect()}
    assert got == {("s", 0), ("s", 200), ("s", 201), ("s", 202)}  # without area nothing covers
    assert sum(rounds) == 1


def test_parts_of_copies_are_found_without_all_pairs(spark, monkeypatch):
    rows = [("s", 100 * c + k, 5, 2.0 * k, 2.0 * k + 1, 0.0, 1.0) for k in range(3) for c in range(40)]
    links, parts = [], graph.parts
    monkeypatch.setattr(graph, "parts", lambda pairs: links.append(pairs.count()) or parts(pairs))
    cells = boxes(spark, rows).withColumn("_k", F.col("id"))
    named = {r._k: r.part for r in match.separate(cells, 1.0).collect()}
    assert named == {100 * c + k: k for k in range(3) for c in range(40)} and links[0] == 3 * 39
