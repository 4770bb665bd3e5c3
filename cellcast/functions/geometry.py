"""Polygon expressions on arrays of structs (lon, lat), and the few polygon algorithms that need Python."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import DEGREE_KM, EARTH_KM


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """(lat_min, lat_max, lon_min, lon_max) of a ring's points."""
    lat, lon = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    return F.array_min(lat), F.array_max(lat), F.array_min(lon), F.array_max(lon)


def box_points(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """A box as a ring of four points."""
    point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    return F.array(point(lon_min, lat_min), point(lon_min, lat_max), point(lon_max, lat_max), point(lon_max, lat_min))


def any_vertex_within(ring: Column, lat: tuple[float, float], lon: tuple[float, float]) -> Column:
    """Whether any point of a ring lies in a window, edges included."""
    return F.exists(ring, lambda p: p["lat"].between(*lat) & p["lon"].between(*lon))


def sides(rings: Column) -> Column:
    """The edges (a, b) of all rings, the last of each closing it. Worth computing before a join, once for a polygon."""
    return F.flatten(F.transform(rings, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))


def contains(rings: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies strictly inside: an odd number of crossings over all rings, and on no edge."""
    return within(sides(rings), lon, lat)


def within(sides: Column, lon: Column, lat: Column) -> Column:
    """`contains` by edges."""

    def turn(e: Column) -> Column:
        return (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) - (e["b"]["lat"] - e["a"]["lat"]) * (lon - e["a"]["lon"])

    def crossed(e: Column) -> Column:
        up = e["b"]["lat"] > lat
        spans = (e["a"]["lat"] > lat) != up
        return spans & ((turn(e) > 0) == up)

    def on(e: Column) -> Column:
        level = lat.between(F.least(e["a"]["lat"], e["b"]["lat"]), F.greatest(e["a"]["lat"], e["b"]["lat"]))
        return level & lon.between(F.least(e["a"]["lon"], e["b"]["lon"]), F.greatest(e["a"]["lon"], e["b"]["lon"])) & (turn(e) == 0)

    return (F.size(F.filter(sides, crossed)) % 2 == 1) & ~F.exists(sides, on)


def _shoelace(ring: Column, x, y) -> Column:
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, after, lambda a, b: x(a) * y(b) - x(b) * y(a))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def _mean_lat(ring: Column) -> Column:
    return F.aggregate(F.transform(ring, lambda p: p["lat"]), F.lit(0.0), lambda s, t: s + t) / F.size(ring)


def area_km2(ring: Column) -> Column:
    """Area of a ring in square kilometres on a plane at its mean latitude; under three points 0."""
    scale = DEGREE_KM * DEGREE_KM * F.cos(F.radians(_mean_lat(ring)))
    area = _shoelace(ring, lambda p: p["lon"], lambda p: p["lat"]) * scale
    return F.when(F.size(ring) >= 3, area).otherwise(0.0)


def area_mixed(ring: Column) -> Column:
    """An area in degrees times kilometres, for results that were stored in this unit; ratios of areas are the same.

    Half the sum of lon * dy - lat * dx over the edges, with dx and dy in kilometres at the mean latitude.
    """
    km = EARTH_KM * math.pi / 180
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    shrink = F.cos(F.radians(_mean_lat(ring)))
    term = lambda a, b: a["lon"] * km * (b["lat"] - a["lat"]) - a["lat"] * km * shrink * (b["lon"] - a["lon"])
    total = F.abs(F.aggregate(F.zip_with(ring, after, term), F.lit(0.0), lambda s, t: s + t)) / 2
    return F.when(F.size(ring) >= 3, total).otherwise(0.0)


def area_square_degrees(ring: Column) -> Column:
    return F.when(F.size(ring) >= 3, _shoelace(ring, lambda p: p["lon"], lambda p: p["lat"])).otherwise(0.0)


def least_area(ring: Column) -> Column:
    """Square degrees that a ring winds around at the least; NULL for 0: its shoelace counts them once for each turn, of which n corners make fewer than n / 2."""
    return F.nullif(_shoelace(ring, lambda p: p["lon"], lambda p: p["lat"]) / F.greatest(F.lit(1), F.floor((F.size(ring) - 1) / 2)), F.lit(0.0))


def is_simple(points: np.ndarray) -> bool:
    """Whether a ring of (x, y) has area and no two of its edges cross or touch beyond common ends."""
    p = np.asarray(points, float)
    if len(p) > 1 and (p[0] == p[-1]).all():
        p = p[:-1]
    n = len(p)
    if n < 3 or len(np.unique(p, axis=0)) < n or area(p) == 0:
        return False
    q = np.roll(p, -1, 0)
    side = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
    i, j = np.triu_indices(n, 1)
    apart = (j - i > 1) & ~((i == 0) & (j == n - 1))
    i, j = i[apart], j[apart]
    a, b, c, d = p[i], q[i], p[j], q[j]
    s1, s2, s3, s4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    within = lambda a, b, c: ((np.minimum(a, b) <= c) & (c <= np.maximum(a, b))).all(-1)
    crossing = (s1 * s2 < 0) & (s3 * s4 < 0)
    touching = ((s1 == 0) & within(a, b, c)) | ((s2 == 0) & within(a, b, d)) | ((s3 == 0) & within(c, d, a)) | ((s4 == 0) & within(c, d, b))
    return not bool((crossing | touching).any())


def area(points: np.ndarray) -> float:
    x, y = np.asarray(points, float).T
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the lowest x; up to two points come back as they are."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) <= 2:
        return p

    def chain(rows):
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def _crossings(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, hit) of all edges p-q against all edges r-s: where along p-q they meet, and whether they do; parallel ones don't."""
    d, e = (q - p)[:, None, :], (s - r)[None, :, :]
    cross = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    gap = r[None, :, :] - p[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * e[..., 1] - gap[..., 1] * e[..., 0]) / cross
        u = (gap[..., 0] * d[..., 1] - gap[..., 1] * d[..., 0]) / cross
        return t, (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)


def _winding(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How often the edges p-q of closed lines wind around the points, counter-clockwise."""
    up, down = (p[:, 1] <= y[:, None]) & (q[:, 1] > y[:, None]), (p[:, 1] > y[:, None]) & (q[:, 1] <= y[:, None])
    left = (q[:, 0] - p[:, 0]) * (y[:, None] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x[:, None] - p[:, 0])
    return (up & (left > 0)).sum(1) - (down & (left < 0)).sum(1)


def repaired(points: np.ndarray) -> list[np.ndarray]:
    """Rings that don't cross, of all that a ring of (x, y) winds around: parts counter-clockwise, their holes clockwise.

    The ring is split where its edges meet; pieces with an inside on one side only are its border, joined by the
    sharpest left turn, so parts that touch at a point are apart. A ring without area has no parts.
    """
    p = np.asarray(points, float).reshape(-1, 2)
    p = p[np.any(p != np.roll(p, 1, 0), axis=1)] if len(p) else p  # without repeats and a closing point
    if len(p) < 3:
        return []
    q, size = np.roll(p, -1, 0), float(np.ptp(p, axis=0).max())
    t, hit = _crossings(p, q, p, q)
    span = ((q - p) ** 2).sum(1)
    pieces: list[tuple[tuple[float, float], tuple[float, float]]] = []
    snap = lambda x: tuple((np.round((x - p.min(0)) / size * 1e9) / 1e9 * size + p.min(0)).tolist())
    for k in range(len(p)):
        # corners that lie on the edge count too: edges on one line have no crossing
        on = ((p - p[k]) @ (q[k] - p[k])) / span[k]
        flat = np.abs((q[k] - p[k])[0] * (p - p[k])[:, 1] - (q[k] - p[k])[1] * (p - p[k])[:, 0]) <= 1e-12 * size * size
        at = np.unique(np.concatenate([[0.0, 1.0], t[k][hit[k]], on[flat & (on > 0) & (on < 1)]]))
        nodes = [snap(p[k] + x * (q[k] - p[k])) for x in at]
        pieces += [(a, b) for a, b in zip(nodes, nodes[1:]) if a != b]
    if not pieces:
        return []
    a, b = (np.array(x) for x in zip(*pieces, strict=True))
    unique = sorted({(min(x), max(x)) for x in pieces})
    u, v = (np.array(x) for x in zip(*unique, strict=True))
    normal = np.stack([u[:, 1] - v[:, 1], v[:, 0] - u[:, 0]], 1) * 1e-4
    near = np.minimum(1.0, 1e-6 * size / np.maximum(np.hypot(*normal.T), 1e-300))[:, None] * normal
    sides = [_winding(*((u + v) / 2 + sign * near).T, a, b) != 0 for sign in (1, -1)]
    return [np.array(r) for r in _traced([(x, y, bool(left)) for (x, y), left, right in zip(unique, *sides, strict=True) if left != right])]

def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection of what two rings wind around, whether they cross themselves or not.

    Both are cut into slabs at every corner and every crossing of edges; within a slab edges don't cross, so the
    intersection is a row of trapezoids whose area the middle of the slab gives exactly.
    """
    rings = [np.asarray(r, float) for r in (a, b)]
    sides = [np.stack([r, np.roll(r, -1, 0)], 1) for r in rings]
    cuts = [r[:, 0] for r in rings]
    for one, other in [(sides[0], sides[1]), *[(x, x) for x, r in zip(sides, rings, strict=True) if not is_simple(r)]]:
        t, hit = _crossings(one[:, 0], one[:, 1], other[:, 0], other[:, 1])
        cuts.append((one[:, None, 0, 0] + np.where(hit, t, 0) * (one[:, 1, 0] - one[:, 0, 0])[:, None])[hit])
    x = np.unique(np.concatenate(cuts))
    total = 0.0
    for left, right in zip(x[:-1], x[1:], strict=True):
        middle, spans = (left + right) / 2, []
        for side in sides:
            lo, hi = np.minimum(side[:, 0, 0], side[:, 1, 0]), np.maximum(side[:, 0, 0], side[:, 1, 0])
            own = side[(lo < middle) & (middle < hi)]
            y = own[:, 0, 1] + (own[:, 1, 1] - own[:, 0, 1]) * (middle - own[:, 0, 0]) / (own[:, 1, 0] - own[:, 0, 0])
            order = np.argsort(y, kind="stable")
            within = np.cumsum(np.sign(own[order, 1, 0] - own[order, 0, 0]))[:-1] != 0
            y = y[order]
            spans.append(np.stack([y[:-1][within], y[1:][within]], 1) if len(y) else np.zeros((0, 2)))
        low = np.maximum(spans[0][:, None, 0], spans[1][None, :, 0])
        high = np.minimum(spans[0][:, None, 1], spans[1][None, :, 1])
        total += float(np.maximum(high - low, 0).sum()) * (right - left)
    return total


def overlap_percent(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(overlap in square degrees, percent of a, percent of b); a ring that crosses itself counts with all it winds around, without area as 0."""
    rings = [np.asarray(r, float).reshape(-1, 2) for r in (a, b)]
    if any(len(r) < 3 for r in rings):
        return 0.0, 0.0, 0.0
    areas = [area(r) if is_simple(r) else overlap_area(r, r) for r in rings]
    if min(areas) == 0:
        return 0.0, 0.0, 0.0
    common = overlap_area(*rings)
    return common, 100 * common / areas[0], 100 * common / areas[1]

#: Up to so many pairs of edges, rings are handled many at a time; about how many numbers an array of theirs holds.
_FEW, _NUMBERS = 400, 1 << 20


def same_sizes(lengths: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Positions of equal lengths (or tuples of lengths), a group for each."""
    order = np.lexsort((lengths, *more))
    new = np.zeros(max(len(order) - 1, 0), bool)
    for x in (lengths, *more):
        new |= np.diff(x[order]) != 0
    return np.split(order, np.flatnonzero(new) + 1) if len(order) else []


def rings_at(xy: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """(rings, size, 2) of the rings of `size` points that begin at places `first` of a table of points."""
    return xy[first[:, None] + np.arange(size)]


def _chunks(n: int, each: int) -> list[slice]:
    step = max(1, _NUMBERS // max(each, 1))
    return [slice(k, k + step) for k in range(0, n, step)]


def areas(rings: np.ndarray) -> np.ndarray:
    """`area` of rings (n, size, 2)."""
    x, y = rings[..., 0], rings[..., 1]
    return np.abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)) / 2


def are_simple(rings: np.ndarray) -> np.ndarray:
    """`is_simple` of rings (n, size, 2)."""
    out = np.zeros(len(rings), bool)
    size = rings.shape[1]
    if size > 1 and (closed := (rings[:, 0] == rings[:, -1]).all(-1)).any():
        out[closed], out[~closed] = _open_simple(rings[closed, :-1]), _open_simple(rings[~closed])
        return out
    return _open_simple(rings)


def _open_simple(rings: np.ndarray) -> np.ndarray:
    n, size = rings.shape[:2]
    if n == 0 or size < 3:
        return np.zeros(n, bool)
    if size * size > _FEW:
        return np.array([is_simple(r) for r in rings], bool)
    out = areas(rings) != 0
    i, j = np.triu_indices(size, 1)
    apart = (j - i > 1) & ~((i == 0) & (j == size - 1))
    for part in _chunks(n, len(i)):
        p = rings[part]
        q = np.roll(p, -1, 1)
        out[part] &= ~(p[:, i] == p[:, j]).all(-1).any(1)
        a, b, c, d = (x[:, k[apart]] for x, k in ((p, i), (q, i), (p, j), (q, j)))
        side = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
        within = lambda a, b, c: ((np.minimum(a, b) <= c) & (c <= np.maximum(a, b))).all(-1)
        s1, s2, s3, s4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
        touching = ((s1 == 0) & within(a, b, c)) | ((s2 == 0) & within(a, b, d)) | ((s3 == 0) & within(c, d, a)) | ((s4 == 0) & within(c, d, b))
        out[part] &= ~((s1 * s2 < 0) & (s3 * s4 < 0) | touching).any(1)
    return out


def _all_crossings(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_crossings` of edges (n, k, 2) against edges (n, m, 2) of the same ring or pair."""
    d, e = (q - p)[:, :, None, :], (s - r)[:, None, :, :]
    cross = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    gap = r[:, None, :, :] - p[:, :, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * e[..., 1] - gap[..., 1] * e[..., 0]) / cross
        u = (gap[..., 0] * d[..., 1] - gap[..., 1] * d[..., 0]) / cross
        return t, (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)


def _overlap_areas(a: np.ndarray, b: np.ndarray, simple: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """`overlap_area` of rings (n, k, 2) with rings (n, m, 2), slab by slab, of all pairs at once; simple: whether they are."""
    sides = [(r, np.roll(r, -1, 1)) for r in (a, b)]
    cuts = [a[..., 0], b[..., 0]]
    for (p, q), (r, s), here in [(*sides, None), *[(x, x, ~y) for x, y in zip(sides, simple, strict=True) if not y.all()]]:
        t, hit = _all_crossings(p, q, r, s)
        hit = hit if here is None else hit & here[:, None, None]
        x = p[:, :, None, 0] + np.where(hit, t, 0) * (q[..., 0] - p[..., 0])[:, :, None]
        cuts.append(np.where(hit, x, np.nan).reshape(len(a), -1))
    x = np.sort(np.concatenate(cuts, 1), 1)
    x = x[:, : max(int((~np.isnan(x)).sum(1).max(initial=0)), 1)]
    left, right = x[:, :-1], x[:, 1:]
    middle, spans = (left + right) / 2, []
    for p, q in sides:
        lo, hi = np.minimum(p[..., 0], q[..., 0])[:, None], np.maximum(p[..., 0], q[..., 0])[:, None]
        m = middle[:, :, None]
        own = (lo < m) & (m < hi)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = p[:, None, :, 1] + (q - p)[:, None, :, 1] * (m - p[:, None, :, 0]) / (q - p)[:, None, :, 0]
        y = np.where(own, y, np.inf)
        order = np.argsort(y, 2, kind="stable")
        y = np.take_along_axis(y, order, 2)
        turn = np.where(own, np.sign((q - p)[:, None, :, 0]), 0)
        within = np.cumsum(np.take_along_axis(turn, order, 2), 2)[..., :-1] != 0
        # edges come in pairs, so beyond the last one nothing is within
        spans.append((np.where(within, y[..., :-1], np.inf), np.where(within, y[..., 1:], -np.inf)))
    low = np.maximum(spans[0][0][..., :, None], spans[1][0][..., None, :])
    high = np.minimum(spans[0][1][..., :, None], spans[1][1][..., None, :])
    with np.errstate(invalid="ignore"):
        held = np.where(high > low, high - low, 0).sum((2, 3)) * (right - left)
    return np.nansum(held, 1)


def overlap_percents(xy_a: np.ndarray, first_a: np.ndarray, size_a: np.ndarray, xy_b: np.ndarray, first_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """`overlap_percent` (n, 3) of rings given by where they begin in a table of points and how many they have."""
    out = np.zeros((len(size_a), 3))
    for group in same_sizes(size_a, size_b):
        k, m = int(size_a[group[0]]), int(size_b[group[0]])
        if min(k, m) < 3:
            continue
        if max(k, m) ** 2 > _FEW:
            for row in group:
                out[row] = overlap_percent(xy_a[first_a[row] : first_a[row] + k], xy_b[first_b[row] : first_b[row] + m])
            continue
        for part in _chunks(len(group), 4 * (k + m + k * m) * k * m):
            rows = group[part]
            rings = rings_at(xy_a, first_a[rows], k), rings_at(xy_b, first_b[rows], m)
            simple = tuple(are_simple(r) for r in rings)
            whole = []
            for r, y in zip(rings, simple, strict=True):
                w = areas(r)
                if not y.all():
                    crossed = r[~y]
                    no = np.zeros(len(crossed), bool)
                    w[~y] = _overlap_areas(crossed, crossed, (no, no))
                whole.append(w)
            some = (whole[0] > 0) & (whole[1] > 0)
            rows, rings, whole = rows[some], tuple(r[some] for r in rings), [w[some] for w in whole]
            common = _overlap_areas(*rings, tuple(y[some] for y in simple))
            out[rows] = np.stack([common, 100 * common / whole[0], 100 * common / whole[1]], 1)
    return out


def _split(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rings (n, k, 2) without repeated points the directed pieces (n, pieces, 2, 2) between places where edges meet.

    Also whether a piece is one (rings have different numbers), and whether left and right of it, seen from its smaller
    end, are wound around.
    """
    n, k = p.shape[:2]
    q, low = np.roll(p, -1, 1), p.min(1)
    size = np.ptp(p, axis=1).max(1)
    t, hit = _all_crossings(p, q, p, q)
    d, gap = (q - p)[:, :, None, :], p[:, None, :, :] - p[:, :, None, :]
    on = (gap * d).sum(-1) / (d * d).sum(-1)
    flat = np.abs(d[..., 0] * gap[..., 1] - d[..., 1] * gap[..., 0]) <= 1e-12 * (size * size)[:, None, None]
    at = np.concatenate([np.zeros((n, k, 1)), np.ones((n, k, 1)), np.where(hit, t, 0), np.where(flat & (on > 0) & (on < 1), on, 0)], 2)
    at.sort(2)
    nodes = p[:, :, None, :] + at[..., None] * d
    span, base = size[:, None, None, None], low[:, None, None, :]
    nodes = np.round((nodes - base) / span * 1e9) / 1e9 * span + base
    pieces = np.stack([nodes[:, :, :-1], nodes[:, :, 1:]], 3).reshape(n, -1, 2, 2)
    real = (pieces[:, :, 0] != pieces[:, :, 1]).any(-1)
    order = np.argsort(~real, 1, kind="stable")[:, : max(int(real.sum(1).max(initial=0)), 1)]
    pieces, real = np.take_along_axis(pieces, order[:, :, None, None], 1), np.take_along_axis(real, order, 1)
    a, b = pieces[:, :, 0], pieces[:, :, 1]
    turned = ((a[..., 0] > b[..., 0]) | ((a[..., 0] == b[..., 0]) & (a[..., 1] > b[..., 1])))[..., None]
    u, v = np.where(turned, b, a), np.where(turned, a, b)
    normal = np.stack([u[..., 1] - v[..., 1], v[..., 0] - u[..., 0]], -1) * 1e-4
    near = np.minimum(1.0, 1e-6 * size[:, None] / np.maximum(np.hypot(normal[..., 0], normal[..., 1]), 1e-300))[..., None] * normal
    held = []
    for sign in (1, -1):
        spot = (u + v) / 2 + sign * near
        x, y = spot[..., 0][:, :, None], spot[..., 1][:, :, None]
        p0, p1, q0, q1 = a[:, None, :, 0], a[:, None, :, 1], b[:, None, :, 0], b[:, None, :, 1]
        left = (q0 - p0) * (y - p1) - (q1 - p1) * (x - p0)
        held.append((((p1 <= y) & (q1 > y) & (left > 0)).sum(2) - ((p1 > y) & (q1 <= y) & (left < 0)).sum(2)) != 0)
    return np.stack([u, v], 2), real, held[0], held[1]


def all_repaired(xy: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[list]:
    """`repaired` of rings given by where they begin in a table of points and how many they have; a ring is a list of points."""
    out: list[list] = [[] for _ in size]
    for group in same_sizes(size):
        k = int(size[group[0]])
        if k < 3:
            continue
        rings = rings_at(xy, first[group], k)
        odd = (rings == np.roll(rings, 1, 1)).all(-1).any(1) if k * k <= _FEW else np.ones(len(group), bool)
        for row, ring in zip(group[odd], rings[odd], strict=True):
            out[row] = [[tuple(x) for x in r.tolist()] for r in repaired(ring)]
        group, rings = group[~odd], rings[~odd]
        for part in _chunks(len(group), 16 * k * k * k):
            ends, real, left, right = _split(rings[part])
            border = (real & (left != right)).tolist()
            for row, pieces, one, inside in zip(group[part], ends.tolist(), border, left.tolist(), strict=True):
                found = {(tuple(u), tuple(v)): x for (u, v), here, x in zip(pieces, one, inside, strict=True) if here}
                out[row] = _traced([(*e, found[e]) for e in sorted(found)])
    return out


def _traced(border: list[tuple[tuple, tuple, bool]]) -> list[list[tuple[float, float]]]:
    """Rings of pieces (end, other end, whether the inside is on the left), joined by the sharpest left turn."""
    leaving: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x, y, left in border:
        leaving.setdefault(x if left else y, []).append(y if left else x)
    rings = []
    while leaving:
        line = [next(iter(leaving))]
        before = None
        while (ends := leaving.get(line[-1])) and (before is None or line[-1] != line[0]):
            here = line[-1]
            turn = lambda z: math.remainder(math.atan2(z[1] - here[1], z[0] - here[0]) - math.atan2(here[1] - before[1], here[0] - before[0]), 2 * math.pi)  # noqa: B023, E731
            best = ends[0] if before is None or len(ends) == 1 else max(ends, key=turn)
            ends.remove(best)
            if not ends:
                del leaving[here]
            before = here
            line.append(best)
        if len(line) > 3 and line[0] == line[-1]:
            rings.append(line[:-1])
    return rings

