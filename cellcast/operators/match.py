"""Matching, merging and terminating cells.

Rules that are sequential within a scan run without bringing a scan together. Termination and greedy matches are decided
in rounds over tables of pairs; assignment and merging are solved in parts that can't touch each other: the connected
parts of candidate pairs, and groups of cells whose boxes, grown as far as merging could take them, never meet.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..sources.scratch import cut
from . import graph, shapes, spatial


#: What decides a pair's cost, and how many ids of cells that are alike in it stand in one row.
_LIKE, _CHUNK = ("lat", "lon", "num_gates", "max_refl"), 256


def _ranked(cells: DataFrame) -> DataFrame:
    """Cells that differ as (scan, id, lat, lon, num_gates, max_refl, kind, rank, n).

    Cells of a scan that are alike in place and size are one kind: its smallest id, a cell's rank by id (from 0) and its size.
    """
    w = W.partitionBy("scan", *_LIKE)
    return cells.select("scan", "id", *_LIKE).distinct().select("*", F.min("id").over(w).alias("kind"), (F.row_number().over(w.orderBy("id")) - 1).alias("rank"), F.count("*").over(w).alias("n"))


def _kinds(ranked: DataFrame) -> DataFrame:
    """One cell for each kind, named by it."""
    return ranked.where("rank = 0").select("scan", F.col("kind").alias("id"), *_LIKE)


def _named(runs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(scan, old_id, new_id, cost) of runs (scan, a, b, cost, a_from, b_from, q): q cells of either kind, rank by rank."""
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1))).select("scan", "a", "b", "cost", (F.col("a_from") + F.col("k")).alias("ra"), (F.col("b_from") + F.col("k")).alias("rb"))
    a = old.select("scan", F.col("kind").alias("a"), F.col("rank").cast("long").alias("ra"), F.col("id").alias("old_id"))
    b = new.select("scan", F.col("kind").alias("b"), F.col("rank").cast("long").alias("rb"), F.col("id").alias("new_id"))
    return each.join(a, ["scan", "a", "ra"]).join(b, ["scan", "b", "rb"]).select("scan", "old_id", "new_id", "cost")


def candidate_pairs(old: DataFrame, new: DataFrame, digits: int | None = None) -> DataFrame:
    """(scan, old_id, new_id, cost) of pairs within 10 km in x and in y. Inputs: scan, id, lat, lon, num_gates, max_refl.

    Place, size and cost are compared once for all cells of a scan that are alike in them; their pairs are then listed
    from rows of ids, some hundreds at a time. Rows that repeat give their pairs as often. `digits` rounds the cost.
    """
    kind = F.struct(*_LIKE)
    one = lambda cells: cells.select("scan", kind.alias("id"), *_LIKE).distinct()
    pairs = _kind_pairs(one(old), one(new))
    if digits is not None:
        pairs = pairs.withColumn("cost", F.round("cost", digits))

    def listed(cells: DataFrame, side: str) -> DataFrame:
        chunk = F.floor(F.row_number().over(W.partitionBy("scan", *_LIKE).orderBy("id")) / _CHUNK)
        placed = cells.select("scan", kind.alias(f"{side}_id"), F.struct("id").alias("one"), chunk.alias("chunk"))
        return placed.groupBy("scan", f"{side}_id", "chunk").agg(F.collect_list("one").alias(f"{side}s")).drop("chunk")

    both = cut(pairs).join(listed(old, "old"), ["scan", "old_id"]).join(listed(new, "new"), ["scan", "new_id"])
    listing = both.select("scan", "news", "cost", F.explode("olds").alias("a")).select("scan", "a", F.explode("news").alias("b"), "cost")
    return listing.select("scan", F.col("a.id").alias("old_id"), F.col("b.id").alias("new_id"), "cost")


def _kind_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """As candidate_pairs, cell by cell.

    Differences are divided by the largest value of either side, at least 1. The pairs come from an equi-join on tiles:
    latitude bands of 10 km, and in each stretches of longitude that are 10 km at the band's narrower edge or more.
    """
    top = old.select("scan", "num_gates", "max_refl").unionByName(new.select("scan", "num_gates", "max_refl")).groupBy("scan")
    most = top.agg(F.greatest(F.lit(1.0), F.max("num_gates")).alias("top_gates"), F.greatest(F.lit(1.0), F.max("max_refl")).alias("top_refl"))
    band = scalars.MATCH_KM / scalars.DEGREE_KM
    a = old.select("scan", *[F.col(c).alias(f"{c}0") for c in ("id", "lat", "lon", "num_gates", "max_refl")])
    b = new.select("scan", *[F.col(c).alias(f"{c}1") for c in ("id", "lat", "lon", "num_gates", "max_refl")]).withColumn("band", F.floor(F.col("lat1") / band))
    # a pair's middle latitude is up to half a band poleward of the new cell's band, where 10 km are more degrees
    edge = (F.greatest(F.abs("band"), F.abs(F.col("band") + 1)) + 1) * band
    width = F.least(F.lit(360.0), band / F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-6)))
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: k.cast("long"))
    a = a.withColumn("band", F.explode(F.transform(around, lambda k: F.floor(F.col("lat0") / band) + k)))
    a = a.withColumn("part", F.explode(F.transform(around, lambda k: F.floor(F.col("lon0") / width) + k)))
    b = b.withColumn("part", F.floor(F.col("lon1") / width))
    pairs = a.join(b, ["scan", "band", "part"]).join(most, "scan")
    dlat, dlon = F.abs(F.col("lat0") - F.col("lat1")), F.abs(F.col("lon0") - F.col("lon1"))
    dx = dlon * scalars.DEGREE_KM * F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2))
    near = pairs.where((dx <= scalars.MATCH_KM) & (dlat * scalars.DEGREE_KM <= scalars.MATCH_KM))
    cost = scalars.degree_cost(dlat, dlon, F.abs(F.col("num_gates0") - F.col("num_gates1")) / F.col("top_gates"), F.abs(F.col("max_refl0") - F.col("max_refl1")) / F.col("top_refl"))
    return near.select("scan", F.col("id0").alias("old_id"), F.col("id1").alias("new_id"), cost.alias("cost"))


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least total cost (-1: none), by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        out = np.full(cost.shape[0], -1)
        back = assign(cost.T)
        out[back] = np.arange(cost.shape[1])
        return out
    n, m = cost.shape
    # rows begin with their cheapest column if it is free; only the others need a path
    u, v, owner, nearest = cost.min(1), np.zeros(m + 1), np.full(m + 1, -1), cost.argmin(1)
    firsts = np.unique(nearest, return_index=True)
    owner[firsts[0]] = firsts[1]
    for row in np.setdiff1d(np.arange(n), firsts[1]):
        owner[m], at = row, m  # the virtual column m starts the path
        least, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            r = owner[at]
            reach = cost[r] - u[r] - v[:m]
            better = ~done[:m] & (reach < least)
            least[better], via[better] = reach[better], at
            at_next = int(np.argmin(np.where(done[:m], np.inf, least)))
            step = least[at_next]
            u[owner[done]] += step
            v[done] -= step
            least[~done[:m]] -= step
            at = at_next
        while at != m:
            owner[at] = owner[via[at]]
            at = via[at]
    out = np.full(n, -1)
    out[owner[:m][owner[:m] >= 0]] = np.flatnonzero(owner[:m] >= 0)
    return out


def assign_sparse(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, alone: float) -> np.ndarray:
    """Which of the pairs (row, column, cost <= alone) make up the cheapest assignment if a row without one costs `alone`.

    Shortest augmenting paths over the pairs that exist, nearest first: memory follows the pairs, and a path only visits
    what lies closer than its end, so a large part of local pairs is many short searches.
    """
    n, m = int(rows.max(initial=-1)) + 1, int(cols.max(initial=-1)) + 1
    order = np.argsort(rows, kind="stable")
    bound = np.searchsorted(rows[order], np.arange(n + 1))
    # each row has a column of its own behind the m shared ones, where it stays alone
    near = [[(int(cols[k]), float(cost[k]), int(k)) for k in order[bound[r] : bound[r + 1]]] + [(m + r, alone, -1)] for r in range(n)]
    u, v = np.zeros(n), np.zeros(m + n)
    owner, taken = np.full(m + n, -1), np.full(n, -1)
    for start in range(n):
        done: dict[int, float] = {}
        entered: dict[int, int] = {}  # the column by which a row was reached
        best: dict[int, tuple[float, int, int]] = {}  # column: (distance, from row, pair)
        queue: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for c, w, k in near[row]:
                d = base + w - u[row] - v[c]
                if c not in done and d < best.get(c, (np.inf,))[0]:
                    best[c] = (d, row, k)
                    heapq.heappush(queue, (d, c))
            while queue[0][1] in done or queue[0][0] > best[queue[0][1]][0]:
                heapq.heappop(queue)
            base, c = heapq.heappop(queue)
            done[c] = base
            if owner[c] < 0:
                break
            row = int(owner[c])
            entered[row] = c
        u[start] += base
        for x, d in done.items():
            if x != c:
                u[owner[x]] += base - d
                v[x] -= base - d
        while True:  # along the path, each row takes the column it was reached from
            _, row, k = best[c]
            owner[c], taken[row] = row, k
            if row == start:
                break
            c = entered[row]
    return np.sort(taken[taken >= 0])


def transport(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, alone: float, supply: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """How often each of the pairs (row, column, cost <= alone) is used in the cheapest assignment of `supply` copies of rows to `demand` ones of columns.

    As assign_sparse, which this equals where all copies are single: a copy without a column costs `alone`. A search
    hands on as many copies as its path carries, so work follows the kinds of cells, not their copies.
    """
    n, m = len(supply), len(demand)
    order = np.argsort(rows, kind="stable")
    bound = np.searchsorted(rows[order], np.arange(n + 1))
    to, price = cols[order], cost[order].astype(float)
    u, v = np.zeros(n), np.zeros(m)
    room, flow = demand.astype(np.int64).copy(), np.zeros(len(to), np.int64)
    users: list[dict[int, int]] = [{} for _ in range(m)]  # of each column the rows in it, and their pairs
    best, via = np.full(m, np.inf), np.full(m, -1)
    for start in range(n):
        left = int(supply[start])
        while left:
            reached, entered = {start: 0.0}, {}  # rows and their distances, and the columns by which they were reached
            done: dict[int, float] = {}
            touched: list[np.ndarray] = []
            queue: list[tuple[float, int]] = []
            limit, end, last = np.inf, -1, start  # the nearest place with room so far: a column's, or alone (-1)
            fresh = [start]
            while True:
                for r in fresh:
                    near = slice(bound[r], bound[r + 1])
                    c, base = to[near], reached[r]
                    if base + alone - u[r] < limit:
                        limit, end, last = base + alone - u[r], -1, r
                    d = base + np.maximum(price[near] - u[r] - v[c], 0.0)
                    on = np.flatnonzero((d < best[c]) & (d < limit))
                    best[c[on]], via[c[on]] = d[on], bound[r] + on
                    touched.append(c[on])
                    free = on[room[c[on]] > 0]
                    if len(free):
                        k = free[np.argmin(d[free])]
                        limit, end = d[k], int(c[k])
                    for k in on[(room[c[on]] == 0) & (d[on] < limit)].tolist():
                        heapq.heappush(queue, (float(d[k]), int(c[k])))
                while queue and (queue[0][1] in done or queue[0][0] > best[queue[0][1]]):
                    heapq.heappop(queue)
                if not queue or queue[0][0] >= limit:
                    break
                base, c = heapq.heappop(queue)
                done[c] = base
                fresh = [r for r in users[c] if r not in reached]
                for r in fresh:
                    reached[r], entered[r] = base, c
            taken, given = [], []  # pairs that get copies, and pairs that give them up
            row, c = last, end
            if end >= 0:
                taken.append(int(via[end]))
                row = int(np.searchsorted(bound, via[end], "right")) - 1
            while row != start:
                c = entered[row]
                given.append((c, row))
                taken.append(int(via[c]))
                row = int(np.searchsorted(bound, via[c], "right")) - 1
            many = min([left, *([int(room[end])] if end >= 0 else []), *[int(flow[users[c][r]]) for c, r in given]])
            for c, r in given:
                k = users[c][r]
                flow[k] -= many
                if not flow[k]:
                    del users[c][r]
            for k in taken:
                flow[k] += many
                users[int(to[k])][int(np.searchsorted(bound, k, "right")) - 1] = k
            if end >= 0:
                room[end] -= many
            left -= many
            for r, d in reached.items():
                u[r] += limit - d
            for c, d in done.items():
                v[c] -= limit - d
            for c in touched:
                best[c] = np.inf
    out = np.zeros(len(to), np.int64)
    out[order] = flow
    return out


def best_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """(scan, old_id, new_id, cost) of the one-to-one assignment of least total cost; (scan, id) is a cell's key on either side.

    Pairs that aren't candidates cost the penalty and count in the total; only pairs below it are returned. As no
    candidate costs more than the penalty, cells that no chain of candidates connects never decide each other's match:
    each connected part is solved by itself, as a group of its own, whatever its scan. Cells that are alike in place and
    size are one node with as many copies, so neither pairs nor parts grow with the copies.
    """
    a, b = cut(_ranked(old)), cut(_ranked(new))
    pairs = cut(_kind_pairs(_kinds(a), _kinds(b)).where(F.col("cost") < scalars.MATCH_PENALTY))
    side = lambda k, id: F.struct("scan", F.lit(k).alias("side"), F.col(id).alias("id"))
    parts = graph.parts(pairs.select(side(0, "old_id").alias("a"), side(1, "new_id").alias("b")))
    size = lambda ranked, id, n: ranked.where("rank = 0").select("scan", F.col("kind").alias(id), F.col("n").alias(n))
    named = pairs.withColumn("node", side(0, "old_id")).join(parts, "node").join(size(a, "old_id", "na"), ["scan", "old_id"]).join(size(b, "new_id", "nb"), ["scan", "new_id"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["old_id", "new_id"]).reset_index(drop=True)
        (_, at, x), (_, to, y) = (np.unique(pdf[c], return_index=True, return_inverse=True) for c in ("old_id", "new_id"))
        pdf["q"] = transport(x, y, pdf.cost.to_numpy(), scalars.MATCH_PENALTY, pdf.na.to_numpy()[at], pdf.nb.to_numpy()[to])
        pdf = pdf[pdf.q > 0]
        before = lambda c: pdf.groupby(c).q.cumsum() - pdf.q
        return pdf.assign(a=pdf.old_id, b=pdf.new_id, a_from=before("old_id"), b_from=before("new_id"))[["scan", "a", "b", "cost", "a_from", "b_from", "q"]]

    ids = [pairs.schema[c].dataType.simpleString() for c in ("scan", "old_id", "new_id")]
    schema = f"scan {ids[0]}, a {ids[1]}, b {ids[2]}, cost double, a_from long, b_from long, q long"
    dealt = named.select("root", "scan", "old_id", "new_id", "cost", "na", "nb")
    return _named(cut(dealt.groupBy("root").applyInPandas(solve, schema)), a, b)


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """Pairs (scan, old_id, new_id, cost) taken by rising cost (equal costs by ids), each id once.

    In rounds: a pair that comes first for both of its cells is taken, whatever comes later, and pairs that share a
    cell with it go. Each round's pairs are stored; none needs a scan together.
    """
    rest = cut(pairs.where(F.col("cost") < scalars.MATCH_PENALTY).distinct())
    taken = None
    while not rest.isEmpty():
        first = lambda id: rest.groupBy("scan", id).agg(F.min(F.struct("cost", "old_id", "new_id")).alias("p")).select("scan", "p.*")  # noqa: B023, E731
        now = cut(first("old_id").join(first("new_id"), ["scan", "cost", "old_id", "new_id"], "left_semi"))
        taken = now if taken is None else taken.unionByName(now)
        rest = cut(rest.join(now.select("scan", "old_id"), ["scan", "old_id"], "left_anti").join(now.select("scan", "new_id"), ["scan", "new_id"], "left_anti"))
    return (taken if taken is not None else rest).select(*pairs.columns)


def greedy_cells(old: DataFrame, new: DataFrame) -> DataFrame:
    """greedy_matches of candidate_pairs, without listing them: (scan, id) is a cell's key on either side.

    Cells that are alike in place and size are one kind, of which those with the smallest ids go first. In rounds: where
    two kinds come first for each other and nothing else costs them the same, as many cells are matched, rank by rank,
    as both have left; among equal costs, the pair of cells that comes first for both kinds.
    """
    ranked = {"a": cut(_ranked(old)), "b": cut(_ranked(new))}
    pairs = _kind_pairs(_kinds(ranked["a"]), _kinds(ranked["b"])).where(F.col("cost") < scalars.MATCH_PENALTY).select("scan", F.col("old_id").alias("a"), F.col("new_id").alias("b"), "cost")
    # of each kind: how many there are, how many are matched, and the first of the others
    for s in ("a", "b"):
        size = ranked[s].where("rank = 0").select("scan", F.col("kind").alias(s), F.col("n").alias(f"{s}_n"))
        pairs = pairs.join(size, ["scan", s]).withColumns({f"{s}_from": F.lit(0).cast("long"), f"{s}_head": F.col(s)})
    rest = cut(pairs)
    runs = None
    while not rest.isEmpty():

        def first(own: str, other: str) -> DataFrame:
            """Of each kind the pair that comes first, how many cost the same, and what it has left."""
            same = rest.groupBy("scan", own, "cost").agg(F.min(F.struct(f"{other}_head", other)).alias("p"), F.count("*").alias("k"), F.min(f"{own}_n").alias("n"), F.min(f"{own}_from").alias("from"))  # noqa: B023
            one = same.groupBy("scan", own).agg(F.min(F.struct("cost", "p", "k", "n", "from")).alias("m"))
            return one.select("scan", own, "m.cost", F.col(f"m.p.{other}").alias(other), F.col("m.k").alias(f"{own}_k"), (F.col("m.n") - F.col("m.from")).alias(f"{own}_left"), F.col("m.from").alias(f"{own}_from"))

        both = first("a", "b").join(first("b", "a"), ["scan", "a", "b", "cost"])
        many = F.when((F.col("a_k") == 1) & (F.col("b_k") == 1), F.least("a_left", "b_left")).otherwise(1)
        now = cut(both.select("scan", "a", "b", "cost", "a_from", "b_from", many.cast("long").alias("q")))
        runs = now if runs is None else runs.unionByName(now)
        for s in ("a", "b"):
            rest = rest.join(now.select("scan", s, F.col("q").alias("more")), ["scan", s], "left").withColumn(f"{s}_from", F.col(f"{s}_from") + F.coalesce("more", F.lit(0))).drop("more")
        rest = rest.where("a_from < a_n AND b_from < b_n").drop("a_head", "b_head")
        for s in ("a", "b"):
            head = ranked[s].select("scan", F.col("kind").alias(s), F.col("rank").cast("long").alias(f"{s}_from"), F.col("id").alias(f"{s}_head"))
            rest = rest.join(head, ["scan", s, f"{s}_from"])
        rest = cut(rest)
    if runs is None:
        return rest.select("scan", F.col("a").alias("old_id"), F.col("b").alias("new_id"), "cost")
    return _named(runs, ranked["a"], ranked["b"])


def apply_matches(tracked: DataFrame, old: DataFrame, new: DataFrame, matches: DataFrame, fields: list[str]) -> DataFrame:
    """Tracked cells after a scan: matched ones take the new fields, matched but untracked old ones and unmatched new ones are added.

    `source` says where a row's fields come from. Tracked cells without a match stay as they are; ids may collide.
    """
    found = matches.select(F.col("old_id").alias("id"), "new_id").join(new.select(F.col("id").alias("new_id"), *[F.col(c).alias(f"_{c}") for c in fields]), "new_id")
    kept = tracked.join(found, "id", "left").select("id", *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in fields], F.when(F.col("new_id").isNotNull(), "updated").otherwise("kept").alias("source"))
    added = old.join(matches.select(F.col("old_id").alias("id")), "id", "left_semi").join(tracked.select("id"), "id", "left_anti").select("id", *fields, F.lit("old").alias("source"))
    fresh = new.join(matches.select(F.col("new_id").alias("id")), "id", "left_anti").select("id", *fields, F.lit("new").alias("source"))
    return kept.unionByName(added).unionByName(fresh)


def _ring_boxes(cells: DataFrame) -> DataFrame:
    """(scan, id, lat_min, ..., ring) by the row key `_k`, of cells with a ring."""
    limits = geometry.bounds(F.col("ring"))
    return cells.where(F.size("ring") > 0).select("scan", F.col("_k").alias("id"), *[c.alias(n) for c, n in zip(limits, ("lat_min", "lat_max", "lon_min", "lon_max"), strict=True)])


def covered(cells: DataFrame, percent: float = 67.0, order: str = "num_gates", strict: bool = False, rounds: list[int] | None = None) -> DataFrame:
    """Cells (scan, ordinal, id, ring, order) that a larger one doesn't cover by `percent` (more than it, if strict).

    Cells are compared from the largest down, equals in their given order; one that has gone covers nothing. Which cell
    covers which is a table of pairs of cells whose boxes meet. It is peeled in rounds: cells that nothing covers stay,
    those they cover go, and neither decides anything after that. Rounds are as many as the longest chain of cells each
    of which covers the next; their sizes are added to the list `rounds`, if there is one. Rows that repeat are cells of
    their own, but only the first of cells of equal ring and order is paired with others; cells without a ring neither
    cover nor are covered.
    """
    if percent < 0 or (percent == 0 and not strict):
        raise ValueError("percent must be above 0")
    whole = cut(cells.withColumn("_k", F.monotonically_increasing_id()))
    enough = F.col("share") > percent if strict else F.col("share") >= percent
    # of copies the first one stands for all: it covers the others, and what covers it comes before them and covers them
    named = whole.where("scan IS NOT NULL AND size(ring) > 0").select("scan", "ring", F.col(order).alias("order"), "ordinal", "_k")
    first = named.groupBy("scan", "ring", "order").agg(F.min(F.struct("ordinal", "_k"))["_k"].alias("stands"), F.count("*").alias("n")).where("n > 1")
    first = first.withColumn("share", shapes.overlap("ring", "ring")["percent_a"]).where(enough).select(F.col("scan").alias("s"), F.col("ring").alias("r"), F.col("order").alias("o"), "stands")
    copies = named.join(first, (F.col("scan") == F.col("s")) & (F.col("ring") == F.col("r")) & F.col("order").eqNullSafe(F.col("o")) & (F.col("_k") != F.col("stands")), "left_semi")
    rows = cut(whole.join(copies.select("_k"), "_k", "left_anti"))
    met = spatial.overlapping(_ring_boxes(rows))
    limits = lambda ring: geometry.bounds(F.col(ring))
    one = lambda side: rows.select("scan", F.col("_k").alias(side), F.struct((-F.col(order)).alias("order"), "ordinal", F.col("_k").alias("k")).alias(f"{side}_rank"), F.col("ring").alias(f"{side}_ring"), F.array(*limits("ring")).alias(f"{side}_box"), geometry.least_area(F.col("ring")).alias(f"{side}_least"))
    both = met.join(one("a"), ["scan", "a"]).join(one("b"), ["scan", "b"])
    before = F.col("a_rank") < F.col("b_rank")
    pick = lambda x, y: F.when(before, x).otherwise(y)
    # what both boxes share bounds what the rings share, so most pairs need no ring
    side = lambda k: F.least(F.col("a_box")[k + 1], F.col("b_box")[k + 1]) - F.greatest(F.col("a_box")[k], F.col("b_box")[k])
    most = 100 * side(0) * side(2) / pick(F.col("b_least"), F.col("a_least")) * (1 + 1e-9) + 1e-9
    near = both.where(F.coalesce(most >= percent, F.lit(True)))
    pairs = near.select(pick(F.col("a"), F.col("b")).alias("over"), pick(F.col("b"), F.col("a")).alias("under"), shapes.overlap(pick(F.col("b_ring"), F.col("a_ring")), pick(F.col("a_ring"), F.col("b_ring")))["percent_a"].alias("share"))
    rest = cut(pairs.where(enough).select("over", "under"))
    gone = None
    while not rest.isEmpty():
        if rounds is not None:
            rounds.append(rest.count())
        stays = rest.select("over").distinct().join(rest.select(F.col("under").alias("over")), "over", "left_anti")
        now = cut(rest.join(stays, "over", "left_semi").select("under").distinct())
        gone = now if gone is None else gone.unionByName(now)
        rest = cut(rest.join(now, "under", "left_anti").join(now.select(F.col("under").alias("over")), "over", "left_anti"))
    left = rows if gone is None else rows.join(gone.select(F.col("under").alias("_k")), "_k", "left_anti")
    return left.select(*cells.columns)


def nearest_large(cells: DataFrame, ratio: float = 0.9, km: float = 1.0) -> DataFrame:
    """(scan, id, large_id) of small cells within `km` of large ones' boxes: the nearest by centroid, if it is larger by the ratio.

    Large: at least `ratio` of the most gates of the scan. Cells: scan, id, num_gates, lat, lon and a box.
    """
    most = cells.groupBy("scan").agg((F.max("num_gates") * ratio).alias("floor"))
    ranked = cells.join(most, "scan")
    small = ranked.where("num_gates < floor")
    box = ("lat_min", "lat_max", "lon_min", "lon_max")
    large = ranked.where("num_gates >= floor").select("scan", *[F.col(c).alias(f"l_{c}") for c in ("id", "num_gates", "lat", "lon", *box)])
    near = spatial.beside(small, large, km)
    distance = F.sqrt(F.pow(F.col("lat") - F.col("l_lat"), 2) + F.pow(F.col("lon") - F.col("l_lon"), 2))
    best = near.groupBy("scan", "id", "num_gates").agg(F.min(F.struct(distance.alias("d"), F.col("l_id").alias("large_id"), F.col("l_num_gates").alias("gates"))).alias("b"))
    return best.where(F.col("num_gates") < F.col("b.gates") * ratio).select("scan", "id", "b.large_id")


def separate(cells: DataFrame, km: float) -> DataFrame:
    """(_k, part) of cells (scan, _k, a box, ring): cells of different parts can never be merged, whatever is merged before.

    Whatever comes of a part lies in its cells' common box. Parts begin as cells, and those whose boxes, widened by
    `km`, meet become one with their common box, until none meet.
    """
    limits = geometry.bounds(F.col("ring"))
    ends = [F.least, F.greatest, F.least, F.greatest]
    box = dict(zip(("lat_min", "lat_max", "lon_min", "lon_max"), [f(F.col(n), F.coalesce(c, F.col(n))) for f, n, c in zip(ends, ("lat_min", "lat_max", "lon_min", "lon_max"), limits, strict=True)], strict=True))
    names = cells.select("_k", F.col("_k").alias("part"))
    boxes = cut(cells.select("scan", F.col("_k").alias("id"), *[c.alias(n) for n, c in box.items()]))
    while True:
        edge = F.least(F.greatest(F.abs("lat_min"), F.abs("lat_max")) + km / scalars.DEGREE_KM, F.lit(89.9))
        lat, lon = F.lit(km / scalars.DEGREE_KM + 1e-9), km / (scalars.DEGREE_KM * F.cos(F.radians(edge))) + 1e-9
        wide = boxes.select("scan", "id", (F.col("lat_min") - lat).alias("lat_min"), (F.col("lat_max") + lat).alias("lat_max"), (F.col("lon_min") - lon).alias("lon_min"), (F.col("lon_max") + lon).alias("lon_max"))
        found = graph.parts(spatial.linked(wide).select("a", "b"))
        if found.isEmpty():
            return names
        names = cut(names.join(found.select(F.col("node").alias("part"), "root"), "part", "left").select("_k", F.coalesce("root", "part").alias("part")))
        named = boxes.join(found.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("id", F.coalesce("root", "id"))
        boxes = cut(named.groupBy("scan", "id").agg(*[f(n).alias(n) for n, f in zip(box, (F.min, F.max, F.min, F.max), strict=True)]))


def merge_cells(cells: DataFrame, ratio: float = 0.9, km: float = 1.0) -> DataFrame:
    """Cells of each scan after small ones joined large neighbours, repeatedly, and overlapping ones were merged.

    Cells: scan, ordinal, id, num_gates, lat, lon, a box and ring (lon, lat). The hull of both rings is the merged ring.
    Small and large go by the most gates of the whole scan; the rest is done part by part (see `separate`).
    """
    names = [f.name for f in cells.schema]
    rows = cut(cells.withColumn("_k", F.monotonically_increasing_id()))
    floors = cells.groupBy("scan").agg((F.max("num_gates") * ratio).alias("_floor"))
    placed = rows.join(separate(rows, km), "_k").join(floors, "scan")

    def join(a: dict, b: dict) -> None:
        n = a["num_gates"] + b["num_gates"]
        for c in ("lat", "lon"):
            a[c] = (a[c] * a["num_gates"] + b[c] * b["num_gates"]) / n
        a["num_gates"] = n
        for c, pick in (("lat_min", min), ("lat_max", max), ("lon_min", min), ("lon_max", max)):
            a[c] = pick(a[c], b[c])
        a["ring"] = geometry.convex_hull(np.concatenate([a["ring"], b["ring"]]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1:
            return pdf[names]
        rows = pdf.sort_values(["ordinal", "_k"]).to_dict("records")
        for r in rows:
            r["ring"] = np.array([(p["lon"], p["lat"]) for p in r["ring"]]).reshape(-1, 2)
        large, small = [r for r in rows if r["num_gates"] >= r["_floor"]], [r for r in rows if r["num_gates"] < r["_floor"]]
        spot = lambda r: [r[c] for c in ("lat_min", "lat_max", "lon_min", "lon_max", "lat", "lon")]
        at = np.array([spot(r) for r in large], float).reshape(-1, 6)
        again = True
        while again and small and large:
            again, left = False, []
            for s in small:
                dlat, dlon = km / scalars.DEGREE_KM, km / (scalars.DEGREE_KM * np.cos(np.radians(s["lat"])))
                near = np.flatnonzero((s["lon_max"] + dlon >= at[:, 2]) & (s["lon_min"] - dlon <= at[:, 3]) & (s["lat_max"] + dlat >= at[:, 0]) & (s["lat_min"] - dlat <= at[:, 1]))
                best = near[np.argmin(np.hypot(at[near, 4] - s["lat"], at[near, 5] - s["lon"]))] if len(near) else None
                if best is None or s["num_gates"] >= ratio * large[best]["num_gates"]:
                    left.append(s)
                else:
                    join(large[best], s)
                    at[best] = spot(large[best])
                    again = True
            small = left
        rest = large + small
        ring = lambda r: r["ring"] if len(r["ring"]) >= 3 else np.array([(r["lon_min"], r["lat_min"]), (r["lon_min"], r["lat_max"]), (r["lon_max"], r["lat_max"]), (r["lon_max"], r["lat_min"])])
        rings = [ring(r) for r in rest]
        limits = np.array([(*r.min(0), *r.max(0)) for r in rings])
        alive = np.ones(len(rest), bool)

        def partner(k: int, low: int, high: int) -> int | None:
            """The first cell from `low` to before `high` that overlaps k; only those whose boxes meet are compared."""
            x0, y0, x1, y1 = limits[k]
            meet = alive & (limits[:, 0] <= x1) & (limits[:, 2] >= x0) & (limits[:, 1] <= y1) & (limits[:, 3] >= y0)
            meet[:low] = meet[high:] = meet[k] = False
            return next((int(m) for m in np.flatnonzero(meet) if geometry.overlap_percent(rings[min(k, m)], rings[max(k, m)])[0] > 0), None)

        def merge(i: int, j: int) -> int:
            i, j = (i, j) if rest[i]["num_gates"] >= rest[j]["num_gates"] else (j, i)
            join(rest[i], rest[j])
            alive[j], rings[i] = False, ring(rest[i])
            limits[i] = (*rings[i].min(0), *rings[i].max(0))
            return i

        # always the first pair that overlaps is merged: no cell before i overlaps another, and a merge changes one cell
        for i in range(len(rest)):
            while alive[i] and (j := partner(i, i + 1, len(rest))) is not None:
                k = merge(i, j)
                while (m := partner(k, 0, len(rest) if k < i else i)) is not None:
                    k = merge(min(k, m), max(k, m))
        rest = [r for r, here in zip(rest, alive, strict=True) if here]
        for r in rest:
            r["ring"] = [{"lon": float(x), "lat": float(y)} for x, y in r["ring"]]
        return pd.DataFrame(rest, columns=names)

    return placed.groupBy("scan", "part").applyInPandas(run, cells.schema)


def overlap_groups(pairs: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("scan",)) -> DataFrame:
    """(keys..., id, group) by connected overlap pairs (keys..., a, b) of equal keys: the smallest id that is reached.

    Ids repeat from scan to scan; a group never reaches over two of them. keys=() takes all cells together.
    """
    node = lambda id: F.struct(*keys, F.col(id).alias("id"))
    found = graph.parts(pairs.select(node("a").alias("a"), node("b").alias("b"))).select(*[F.col(f"node.{c}").alias(c) for c in (*keys, "id")], F.col("root.id").alias("group"))
    return cells.select(*keys, "id").join(found, [*keys, "id"], "left").select(*keys, "id", F.coalesce("group", "id").alias("group"))
