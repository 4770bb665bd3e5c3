import numpy as np
from pyspark.sql import functions as F

from cellcast.functions import geometry as G
from cellcast.operators import contours, graph, shapes
from cellcast.plans import catalog

SF = "/root/testdata/sf0.001"


def contour(rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int] | None = None) -> np.ndarray:
    """In plain Python: the longest boundary at half height around a set of gates, as (row, col) points, closed.

    The line runs through the middles between gates inside and outside, keeping the inside on its left; where two
    gates touch at a corner only, the line separates them. It isn't drawn beyond `shape`, so a set that fills the
    grid has none, and a set that meets the rim has an open line.
    """
    if not len(rows):
        return np.zeros((0, 2))
    r0, c0 = rows.min() - 1, cols.min() - 1
    mask = np.zeros((rows.max() - r0 + 2, cols.max() - c0 + 2), bool)
    mask[rows - r0, cols - c0] = True
    follow: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for r, c in np.argwhere(mask[:-1, :-1] | mask[1:, :-1] | mask[:-1, 1:] | mask[1:, 1:]):
        if shape and not (0 <= r + r0 and r + r0 + 1 < shape[0] and 0 <= c + c0 and c + c0 + 1 < shape[1]):
            continue
        a, b, d, e = mask[r, c], mask[r, c + 1], mask[r + 1, c + 1], mask[r + 1, c]  # clockwise corners
        middle = [(r, c + 0.5), (r + 0.5, c + 1.0), (r + 1.0, c + 0.5), (r + 0.5, float(c))]  # top, right, bottom, left
        corner = [a, b, d, e]
        # each inside-to-outside change along the clockwise corners is where a line enters, the next change is where it leaves
        enter = [k for k in range(4) if corner[k] and not corner[(k + 1) % 4]]
        leave = [k for k in range(4) if not corner[k] and corner[(k + 1) % 4]]
        for k in enter:
            other = min(leave, key=lambda m: (k - m) % 4)  # around the inside corner just passed
            follow.setdefault(middle[k], []).append(middle[other])
    starts = set(follow) - {q for x in follow.values() for q in x}
    best: list[tuple[float, float]] = []
    for start in [*sorted(starts), *sorted(follow)]:
        line = [start]
        while follow.get(line[-1]):
            line.append(follow[line[-1]].pop(0))
        if len(line) > len(best):
            best = line
    return np.array(best) + [r0, c0] if len(best) > 1 else np.zeros((0, 2))


SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]


def ring(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


def test_point_in_polygon(spark):
    hole = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]
    rings = F.array(ring(SQUARE), ring(hole))
    points = [(0.2, 0.2), (0.5, 0.5), (0.0, 0.5), (1.0, 1.0), (0.4, 0.5), (2.0, 0.5), (0.5, 1.0), (0.2, 0.4)]
    df = spark.createDataFrame(points, "x double, y double").coalesce(1).select(G.contains(rings, F.col("x"), F.col("y")).alias("c"))
    assert [r.c for r in df.collect()] == [True, False, False, False, False, False, False, True]


def test_areas_and_bounds(spark):
    r = ring(SQUARE)
    tenth = ring([(280.0, 40.0), (280.1, 40.0), (280.1, 40.1), (280.0, 40.1)])
    row = spark.range(1).select(G.area_square_degrees(r).alias("a"), G.area_km2(tenth).alias("k"), G.area_km2(F.slice(r, 1, 2)).alias("two"), G.area_mixed(r).alias("m"), G.area_mixed(tenth).alias("n"), F.array(*G.bounds(r)).alias("b")).first()
    assert (row.a, row.two, row.b) == (1.0, 0.0, [0.0, 1.0, 0.0, 1.0])
    assert abs(row.m - 111.1928096635) < 1e-6 and abs(row.n - 0.9815638821) < 1e-6
    assert abs(row.k - 111**2 * 0.01 * np.cos(np.radians(40.05))) < 1e-6


def test_any_vertex(spark):
    around = ring([(-10.0, -10.0), (20.0, -10.0), (20.0, 20.0), (-10.0, 20.0)])
    row = spark.range(1).select(G.any_vertex_within(ring(SQUARE), (1.0, 2.0), (1.0, 2.0)).alias("a"), G.any_vertex_within(around, (0.0, 5.0), (0.0, 5.0)).alias("b")).first()
    assert (row.a, row.b) == (True, False)


def test_overlap_and_validity():
    moved = [(x + 0.5, y + 0.5) for x, y in SQUARE]
    assert np.allclose(G.overlap_percent(SQUARE, moved), (0.25, 25, 25))
    assert np.allclose(G.overlap_percent(SQUARE, [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]), (0.25, 25, 100))
    assert G.overlap_percent(SQUARE, [(5, 5), (6, 5), (6, 6)]) == (0, 0, 0)
    assert G.overlap_percent(SQUARE, [(0, 0)]) == (0, 0, 0)
    concave = [(0, 0), (2, 0), (2, 2), (1, 0.5), (0, 2)]
    rnd = np.random.default_rng(0).random((200_000, 2)) * 2
    for other in ([(0, 1), (2, 1), (2, 3), (0, 3)], [(0.5, -1), (1.5, -1), (1.0, 3.0)]):
        inside = np.ones(len(rnd), bool)
        for poly in (concave, other):
            p = np.array(poly, float)
            odd = np.zeros(len(rnd), bool)
            for a, b in zip(p, np.roll(p, -1, 0)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    odd ^= ((a[1] > rnd[:, 1]) != (b[1] > rnd[:, 1])) & (rnd[:, 0] < (b[0] - a[0]) * (rnd[:, 1] - a[1]) / (b[1] - a[1]) + a[0])
            inside &= odd
        assert abs(G.overlap_area(np.array(concave), np.array(other)) - 4 * inside.mean()) < 0.02
    assert G.is_simple(SQUARE) and G.is_simple(concave) and G.is_simple([*SQUARE, SQUARE[0]])
    assert not G.is_simple([(0, 0), (1, 1), (1, 0), (0, 1)]) and not G.is_simple([(0, 0), (1, 1), (2, 2)]) and not G.is_simple([(0, 0), (1, 0)])


def test_hull_and_contour():
    hull = G.convex_hull([*SQUARE, (0.5, 0.5), (0.5, 0.0), (1, 1)])
    assert sorted(map(tuple, hull)) == sorted(SQUARE)
    assert len(G.convex_hull([(1, 1)])) == 1 and len(G.convex_hull([(0, 0), (1, 1), (2, 2)])) == 2
    mask = np.zeros((10, 12), bool)
    mask[2:6, 3:9] = True
    line = contour(*np.nonzero(mask), mask.shape)
    assert (line[0] == line[-1]).all() and len(line) == 21
    assert line.min(0).tolist() == [1.5, 2.5] and line.max(0).tolist() == [5.5, 8.5]
    assert len(contour(*np.nonzero(np.ones((4, 4), bool)), (4, 4))) == 0
    assert len(contour(np.array([3]), np.array([3]), (9, 9))) == 5


def test_outline_or_box(spark):
    p = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    bow = F.array(p(0.0, 0.0), p(1.0, 1.0), p(0.0, 1.0), p(1.0, 0.0))
    fine = F.array(p(0.0, 0.0), p(0.0, 1.0), p(1.0, 1.0))
    row = spark.range(1).select(*[F.size(shapes.cell_polygon(b, F.lit(40.0), F.lit(280.0))).alias(n) for b, n in ((bow, "a"), (fine, "b"), (F.slice(fine, 1, 2), "c"))], shapes.cell_polygon(F.slice(fine, 1, 2), F.lit(None).cast("double"), F.lit(1.0)).alias("d"), shapes.hull(F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in [*SQUARE, (0.5, 0.5)]])).alias("h"), shapes.overlap(ring(SQUARE), ring(SQUARE)).alias("o")).first()
    assert (row.a, row.b, row.c, row.d, len(row.h), row.o.percent_a) == (4, 3, 4, None, 4, 100.0)


def test_contours_run_between_all_gates_inside_and_outside():
    """Unions of boxes: the outline's points are the middles of all pairs of a gate inside and one of the outside around."""
    rnd = np.random.default_rng(12)
    done = 0
    while done < 60:
        mask = np.zeros((16, 18), bool)
        for _ in range(rnd.integers(1, 5)):
            r, c, h, w = rnd.integers(1, 10), rnd.integers(1, 12), rnd.integers(1, 6), rnd.integers(1, 6)
            mask[r : r + h, c : c + w] = True
        corner = mask[:-1, :-1] & mask[1:, 1:] & ~mask[1:, :-1] & ~mask[:-1, 1:] | mask[1:, :-1] & mask[:-1, 1:] & ~mask[:-1, :-1] & ~mask[1:, 1:]
        outside, inside = _reached(~mask, (0, 0)), _reached(mask, tuple(np.argwhere(mask)[0]))
        if corner.any() or (inside != mask).any():  # one piece, whose gates touch at sides
            continue
        around = lambda r, c: [(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)]
        want = {((r + y) / 2, (c + x) / 2) for r, c in np.argwhere(mask).tolist() for y, x in around(r, c) if outside[y, x]}
        line = [tuple(p) for p in contour(*np.nonzero(mask), mask.shape).tolist()]
        holes = (~outside & ~mask).any()
        if not holes or len(want) > 40:
            assert set(line) == want and line[0] == line[-1] and len(line) == len(want) + 1
            assert all(abs(a - c) + abs(b - d) <= 1.0 for (a, b), (c, d) in zip(line, line[1:]))
            done += 1


def _reached(open_, start):
    seen, todo = np.zeros(open_.shape, bool), [start]
    while todo:
        r, c = todo.pop()
        if 0 <= r < open_.shape[0] and 0 <= c < open_.shape[1] and open_[r, c] and not seen[r, c]:
            seen[r, c] = True
            todo += [(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)]
    return seen


def test_outlines_of_all_labels(spark):
    """The registered query's outlines are every eighth point of each label's contour, at the gates that hold them."""
    gates, labels = catalog._labels(spark, SF)
    gate = {(r.i, r.j): (r.lat, r.lon) for r in gates.collect()}
    size = (max(i for i, _ in gate) + 1, max(j for _, j in gate) + 1)
    own = {}
    for r in labels.collect():
        own.setdefault(r.poly_id, []).append((r.i, r.j))
    want = {}
    for p, places in own.items():
        line = contour(*np.array(places).T, size)[::8].astype(int).tolist()
        points = [gate[i, j] for i, j in line if (i, j) in gate]
        if points:
            want[p] = points
    got = {r.poly_id: [(p.lat, p.lon) for p in r.bbox] for r in catalog.QUERIES["label_outlines"](spark, SF).collect()}
    assert got == want and got


def test_contours_by_tiles(spark):
    """Random labels of two scans with shared ids, holes, corners that touch and open lines at the rim, on tiles of 3 to 50 gates."""
    rnd = np.random.default_rng(5)
    rows, want = [], set()
    for scan in ("a", "b"):
        grid = np.zeros((34, 29), int)
        for _ in range(14):
            r, c, h, w = rnd.integers(0, 30), rnd.integers(0, 25), rnd.integers(1, 14), rnd.integers(1, 14)
            grid[r : r + h, c : c + w] = rnd.integers(0, 6)
        grid[rnd.random(grid.shape) < 0.06] = 2
        rows += [(scan, int(r), int(c), int(grid[r, c])) for r in range(34) for c in range(29)]
        for p in set(grid.ravel().tolist()) - {0}:
            line = contour(*np.nonzero(grid == p), grid.shape)
            want |= {(scan, p, k, int(r), int(c)) for k, (r, c) in enumerate(line.tolist()) if k % 2 == 0}
    # a scan that one label fills has no line, and one without labels no row
    rows += [("full", r, c, 1) for r in range(3) for c in range(3)] + [("none", r, c, 0) for r in range(3) for c in range(3)] + [("none", 0, 1, None)]
    gates = spark.createDataFrame(rows, "scan string, i int, j int, poly_id long").cache()
    for tile in (3, 8, 50):
        got = [tuple(r) for r in contours.points(gates.unionByName(gates.limit(40)), gates, 2, tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert contours.points(gates.where("false"), gates).count() == 0


def test_lists_are_ranked():
    before = np.array([0, 0, 1, 5, 3, 4, 6])  # 0-1-2, the ring 3-4-5, 6
    first, rank = contours.ranked(before)
    assert first.tolist() == [0, 0, 0, 3, 3, 3, 6] and rank.tolist() == [0, 1, 2, 0, 1, 2, 0]
    assert [x.tolist() for x in contours.ranked(np.zeros(0, int))] == [[], []]


def test_a_long_line_runs_through_many_tiles(spark, monkeypatch):
    """A comb of 20 teeth: one line of a thousand segments, which crosses tiles a hundred times; rounds stay few."""
    mask = np.zeros((42, 50), bool)
    mask[1:41, 2] = True
    mask[1:41:2, 2:48] = True
    gates = spark.createDataFrame([("s", r, c, int(mask[r, c])) for r in range(42) for c in range(50)], "scan string, i int, j int, poly_id long")
    line = contour(*np.nonzero(mask), mask.shape)
    assert len(line) > 1_500
    stored = []
    for module in (contours, graph):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: stored.append(1) or cut(df))
    got = {(r.k, r.i, r.j) for r in contours.points(gates, gates, 1, 12).collect()}
    assert got == {(k, int(r), int(c)) for k, (r, c) in enumerate(line.tolist())}
    assert len(stored) < 50


def test_parts_of_rising_chains_take_few_rounds(spark, monkeypatch):
    """Chains of 400 and 3 nodes that rise from link to link, a star, a repeated link and one to itself."""
    links = [(k, k + 1) for k in range(399)] + [(1000, 1001), (1002, 1001)] + [(2000, k) for k in range(2001, 2020)] + [(2000, 2001), (5, 5), (7000, 7000)]
    stored = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: stored.append(1) or cut(df))
    got = {r.node: r.root for r in graph.parts(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(400)} | {k: 1000 for k in range(1000, 1003)} | {k: 2000 for k in range(2000, 2020)}
    assert len(stored) < 40


def test_rings_that_cross_are_repaired(spark):
    """Bow tie, star, a ring run twice, a spike, a hole by a bridge, and random rings against windings on a raster."""
    signed = lambda r: float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum()) / 2
    bow = [(0, 0), (1, 1), (1, 0), (0, 1)]
    assert sorted(sorted(map(tuple, np.round(r, 6).tolist())) for r in G.repaired(bow)) == [[(0, 0), (0, 1), (0.5, 0.5)], [(0.5, 0.5), (1, 0), (1, 1)]]
    assert all(abs(signed(r) - 0.25) < 1e-6 for r in G.repaired(bow))
    assert np.allclose(G.overlap_percent(bow, SQUARE), (0.5, 100, 50))
    assert [len(r) for r in G.repaired(SQUARE * 2)] == [4] and np.allclose(G.overlap_percent(SQUARE * 2, SQUARE), (1, 100, 100))
    assert np.allclose(G.overlap_percent([*SQUARE, (0, 3), (0, 1)], SQUARE), (1, 100, 100))
    assert G.repaired([]) == G.repaired([(0, 0), (1, 1)]) == G.repaired([(0, 0), (1, 1), (2, 2)]) == []
    bridge = [(0, 0), (3, 0), (3, 3), (0, 3), (0, 0), (1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
    assert sorted(round(signed(r), 6) for r in G.repaired(bridge)) == [-1, 9]
    rnd = np.random.default_rng(3)
    at = (np.stack(np.meshgrid(np.arange(150), np.arange(150)), -1).reshape(-1, 2) + 0.5) / 150

    def windings(ring):
        p = np.array(ring, float) - at[:, None, :]
        angle = np.arctan2(p[..., 1], p[..., 0])
        return np.round(((np.roll(angle, -1, 1) - angle + np.pi) % (2 * np.pi) - np.pi).sum(1) / (2 * np.pi))

    for n in (4, 5, 6, 8, 12) * 4:
        a, b = rnd.random((n, 2)), rnd.random((5, 2))
        in_a, in_b = windings(a) != 0, windings(b) != 0
        assert abs(G.overlap_area(a, b) - (in_a & in_b).mean()) < 0.01
        parts = G.repaired(a)
        assert abs(sum(map(signed, parts)) - G.overlap_area(a, a)) < 1e-6 and all(G.is_simple(r) for r in parts)
    got = spark.range(1).select(shapes.repair(ring(bow)).alias("r"), shapes.repair(F.lit(None).cast("array<struct<lon:double,lat:double>>")).alias("none")).first()
    assert [len(r) for r in got.r] == [3, 3] and got.none == []


def test_rings_many_at_a_time_equal_one_by_one(spark):
    rnd = np.random.default_rng(3)
    rings = [rnd.integers(0, 5, (k, 2)).astype(float) if k % 2 else rnd.random((k, 2)) for k in rnd.integers(0, 8, 600)] + [rnd.random((30, 2))]
    rings = [np.concatenate([r, r[:1]]) if len(r) > 2 and n % 5 == 0 else r for n, r in enumerate(rings)]
    size, xy = np.array([len(r) for r in rings]), np.concatenate(rings)
    first, other = np.cumsum(size) - size, rnd.permutation(len(rings))
    got = G.overlap_percents(xy, first, size, xy, first[other], size[other])
    assert np.allclose(got, [G.overlap_percent(rings[a], rings[b]) for a, b in enumerate(other)], rtol=1e-9, atol=1e-9)
    assert G.all_repaired(xy, first, size) == [[[tuple(p) for p in part.tolist()] for part in G.repaired(r)] for r in rings]
    for group in G.same_sizes(size):
        assert G.are_simple(G.rings_at(xy, first[group], size[group[0]])).tolist() == [G.is_simple(rings[k]) for k in group]
    rows = spark.createDataFrame([([{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 0.0, "lat": 1.0}],), (None,)], "r array<struct<lon:double,lat:double>>")
    assert sorted(len(r[0]) for r in rows.select(shapes.repair("r")).collect()) == [0, 2]
    assert sorted(r[0] for r in rows.select(shapes.overlap("r", "r")["percent_a"]).collect()) == [0.0, 100.0]
