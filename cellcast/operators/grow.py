"""Region growing on grids.

Growth by synchronous rounds with the highest id winning ties gives each gate the lexicographically smallest (rounds,
-id) over all seeds that reach it, and that can be relaxed in any order. The grid is therefore cut into square tiles;
a step brings every tile to its own fixpoint in one vectorised pass and hands the rims to the neighbouring tiles. The
number of steps is the number of tiles that a region crosses, not the number of rounds, and no task holds more than a
tile and its rim.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut

TILE = 256
_FAR = np.iinfo(np.int64).max // 4
_ROUND = 1 << 44  # one round outweighs every id


def _relaxed(key: np.ndarray, fixed: np.ndarray, open_: np.ndarray, cost: int, most: int, diagonal: bool = False) -> np.ndarray:
    """Keys after relaxing open gates from their four (eight, if diagonal) neighbours until nothing changes."""
    while True:
        padded = np.pad(key, 1, constant_values=_FAR)
        beside = [padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]]
        near = np.minimum.reduce(beside + [padded[:-2, :-2], padded[:-2, 2:], padded[2:, :-2], padded[2:, 2:]] * diagonal) + cost
        new = np.where(open_ & ~fixed & (near < key) & (near < most), near, key)
        if (new == key).all():
            return key
        key = new


def _beyond(tile: int, diagonal: bool = False) -> Column:
    """The other tiles (ti, tj) that gate (i, j) borders on, as an array."""
    low, high = (lambda c: F.pmod(c, F.lit(tile)) == 0), (lambda c: F.pmod(c, F.lit(tile)) == tile - 1)
    sides = [(low("i"), -1, 0), (high("i"), 1, 0), (low("j"), 0, -1), (high("j"), 0, 1)]
    corners = [(a & b, x, y) for a, x, _ in sides[:2] for b, _, y in sides[2:]] if diagonal else []
    return F.array_compact(F.array(*[F.when(c, F.struct((F.col("ti") + a).alias("ti"), (F.col("tj") + b).alias("tj"))) for c, a, b in sides + corners]))


def _by_tiles(state: DataFrame, cost: int, most: int, tile: int, diagonal: bool = False) -> DataFrame:
    """Relaxes state (scan, i, j, key, fixed, open) over all tiles until no rim changes."""
    schema = "scan string, ti int, tj int, i int, j int, key long, fixed boolean, open boolean, moved boolean"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        i0, j0 = pdf.i.min(), pdf.j.min()
        shape = (pdf.i.max() - i0 + 1, pdf.j.max() - j0 + 1)
        at = (pdf.i.to_numpy() - i0, pdf.j.to_numpy() - j0)
        key, fixed, open_ = np.full(shape, _FAR), np.ones(shape, bool), np.zeros(shape, bool)
        key[at], fixed[at], open_[at] = pdf.key, pdf.fixed | ~pdf.own, pdf.open
        new = _relaxed(key, fixed, open_, cost, most, diagonal)[at]
        return pdf.assign(moved=new != pdf.key, key=new)[pdf.own.to_numpy()].drop(columns="own")

    state = state.withColumn("ti", F.floor(F.col("i") / tile).cast("int")).withColumn("tj", F.floor(F.col("j") / tile).cast("int"))
    state = state.select("scan", "ti", "tj", "i", "j", "key", "fixed", "open", F.lit(True).alias("moved"))
    while True:
        rims = state.where("key < " + str(_FAR)).select("scan", F.explode(_beyond(tile, diagonal)).alias("o"), "i", "j", "key", "fixed", "open")
        rims = rims.select("scan", "o.ti", "o.tj", "i", "j", "key", "fixed", "open", F.lit(False).alias("own"))
        both = state.drop("moved").withColumn("own", F.lit(True)).unionByName(rims)
        state = cut(both.groupBy("scan", "ti", "tj").applyInPandas(settle, schema))
        if state.where("moved").where(F.size(_beyond(tile)) > 0).isEmpty():
            return state


def expand(gates: DataFrame, labels: DataFrame, threshold: float = 40.0, rounds: int = 100, tile: int = TILE) -> DataFrame:
    """(scan, i, j, poly_id) after growing labels (scan, i, j, poly_id) through gates (scan, i, j, value >= threshold).

    Four neighbours, synchronous rounds, the first claim stays, and in one round the highest id wins. Seeds keep their
    id and needn't reach the threshold; only ids above zero spread, others block. NULL values are never grown into.
    """
    if threshold is None:
        raise ValueError("a threshold is needed")
    limit = _ROUND >> 1
    seed = F.col("poly_id").isNotNull() & (F.col("poly_id") != 0)
    spreads = F.when(F.col("poly_id") > 0, F.lit(limit) - F.col("poly_id")).otherwise(_FAR)
    state = gates.select("scan", "i", "j", "value").join(labels.select("scan", "i", "j", "poly_id"), ["scan", "i", "j"], "full")
    state = state.select("scan", "i", "j", F.when(seed, spreads).otherwise(_FAR).alias("key"), seed.alias("fixed"), F.coalesce(F.col("value") >= threshold, F.lit(False)).alias("open"))
    done = _by_tiles(cut(state), _ROUND, rounds * _ROUND + limit, tile).where(f"key < {_FAR}")
    grown = done.select("scan", "i", "j", (F.lit(limit) - F.col("key") % _ROUND).alias("poly_id"))
    return grown.unionByName(labels.where("poly_id < 0").select("scan", "i", "j", "poly_id"))


def components(gates: DataFrame, threshold: float = 50.0, tile: int = TILE) -> DataFrame:
    """(scan, i, j, root_i, root_j): four-connected regions of value >= threshold, named by their first gate (row by row)."""
    own = gates.where(F.col("value") >= threshold)
    name = F.col("i").cast("long") * (1 << 21) + F.col("j")
    state = own.select("scan", "i", "j", name.alias("key"), F.lit(False).alias("fixed"), F.lit(True).alias("open"))
    done = _by_tiles(cut(state), 0, _FAR, tile)
    return done.select("scan", "i", "j", F.floor(F.col("key") / (1 << 21)).cast("int").alias("root_i"), F.pmod("key", F.lit(1 << 21)).cast("int").alias("root_j"))


def compete(pdf: pd.DataFrame, seed: float = 50.0, grow: float = 40.0, rounds: int = 100) -> pd.DataFrame:
    """Regions (region, i, j) of one scan: components of value >= seed, grown through eight neighbours of value >= grow.

    A gate can be claimed if no region held it before the round; regions that reach it in one round all get it.
    Regions are numbered from 1 in row order of their first gates.
    """
    pdf = pdf[pdf.value >= grow]
    if not len(pdf):
        return pd.DataFrame({"region": [], "i": [], "j": []}).astype("int64")
    i0, j0 = pdf.i.min(), pdf.j.min()
    shape = (pdf.i.max() - i0 + 1, pdf.j.max() - j0 + 1)
    value = np.full(shape, -np.inf)
    value[pdf.i - i0, pdf.j - j0] = pdf.value
    core = value >= seed
    key = _relaxed(np.where(core, np.arange(value.size).reshape(shape), _FAR), ~core, core, 0, _FAR)
    roots = np.unique(key[core])
    gate = np.flatnonzero(core)
    region = np.searchsorted(roots, key.ravel()[gate]) + 1
    claimed, can = np.pad(core, 1), np.pad(value >= grow, 1)
    wide = shape[1] + 2
    gate = (gate // shape[1] + 1) * wide + gate % shape[1] + 1  # in the padded grid every gate has eight neighbours
    found = [(region, gate)]
    around = np.array([dy * wide + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    for _ in range(rounds):
        other = (gate[:, None] + around).ravel()
        owner = np.repeat(region, len(around))
        free = can.ravel()[other] & ~claimed.ravel()[other]
        pairs = np.unique(np.stack([owner[free], other[free]], 1), axis=0)
        if not len(pairs):
            break
        region, gate = pairs.T
        claimed.ravel()[gate] = True
        found.append((region, gate))
    region, gate = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"region": region, "i": gate // wide - 1 + i0, "j": gate % wide - 1 + j0})


def competing_regions(gates: DataFrame, seed: float = 50.0, grow: float = 40.0, rounds: int = 100, tile: int = TILE) -> DataFrame:
    """(scan, region, i, j): components of value >= seed of each scan, grown through eight neighbours of value >= grow.

    A gate can be claimed if no region held it before the round; regions that reach it in one round all get it. Regions
    are numbered from 1 in row order of their first gates. NULL values are never grown into.

    A gate's round is its distance from the nearest core, whichever it is, so rounds are relaxed by tiles first. A
    region has a gate if it has a neighbour of it that is one round nearer: sets of owners go down the rounds, tile by
    tile, and over the rims until nothing is new. No task holds more than a tile, its rim and their owners.
    """
    own = cut(gates.where(F.col("value") >= grow).select("scan", "i", "j", "value"))
    core = F.col("value") >= seed
    state = own.select("scan", "i", "j", F.when(core, 0).otherwise(_FAR).cast("long").alias("key"), core.alias("fixed"), F.lit(True).alias("open"))
    near = _by_tiles(cut(state), 1, rounds + 1, tile, diagonal=True).where(f"key < {_FAR}").select("scan", "ti", "tj", "i", "j", F.col("key").alias("round"))
    cores = components(own, seed, tile).select("scan", "i", "j", (F.col("root_i").cast("long") * (1 << 21) + F.col("root_j")).alias("root"))
    owners = _owners(cut(near), cores, tile)
    number = F.row_number().over(W.partitionBy("scan").orderBy("root"))  # a row for each region of a scan
    names = cores.select("scan", "root").distinct().withColumn("region", number.cast("long"))
    return owners.join(names, ["scan", "root"]).select("scan", "region", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def _owners(near: DataFrame, cores: DataFrame, tile: int) -> DataFrame:
    """(scan, ti, tj, i, j, round, root, fresh) of all owners of gates `near` (scan, ti, tj, i, j, round), from those of round 0."""
    schema = "scan string, ti int, tj int, i int, j int, round long, root long, fresh boolean"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        i0, j0 = int(pdf.i.min()) - 1, int(pdf.j.min()) - 1
        wide = int(pdf.j.max()) - j0 + 2
        around = np.array([dy * wide + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
        place = ((pdf.i - i0) * wide + pdf.j - j0).to_numpy()
        level = np.full((int(pdf.i.max()) - i0 + 2) * wide, -1)
        gate, turn = (pdf.kind == 0).to_numpy(), pdf["round"].to_numpy()
        level[place[gate]] = turn[gate]
        roots, root = np.unique(pdf.root.to_numpy()[~gate].astype(np.int64), return_inverse=True)
        pair, turn, mine = place[~gate] * max(1, len(roots)) + root, turn[~gate], (pdf.kind == 1).to_numpy()[~gate]
        had = np.unique(pair[mine])
        all_, front = [], np.zeros(0, np.int64)
        for step in range(int(level.max()) + 1):
            front = np.unique(np.concatenate([front, pair[turn == step]]))
            at = front // max(1, len(roots))
            all_.append(front[level[at] == step])  # others are the rim's
            other = (at[:, None] + around).ravel()
            good = level[other] == step + 1
            front = (other * max(1, len(roots)) + np.repeat(front % max(1, len(roots)), len(around)))[good]
        found = np.concatenate(all_) if all_ else front
        at, root = found // max(1, len(roots)), found % max(1, len(roots))
        return pd.DataFrame({"scan": pdf.scan.iloc[0], "ti": pdf.ti.iloc[0], "tj": pdf.tj.iloc[0], "i": at // wide + i0, "j": at % wide + j0, "round": level[at], "root": roots[root], "fresh": ~np.isin(found, had)})

    gates = near.withColumn("root", F.lit(None).cast("long")).withColumn("kind", F.lit(0))
    owned = cut(near.join(cores, ["scan", "i", "j"]).select("scan", "ti", "tj", "i", "j", "round", "root", F.lit(True).alias("fresh")))
    while True:
        rims = owned.where("fresh").withColumn("o", F.explode(_beyond(tile, diagonal=True))).select("scan", "o.ti", "o.tj", "i", "j", "round", "root", F.lit(2).alias("kind"))
        both = gates.unionByName(owned.drop("fresh").withColumn("kind", F.lit(1))).unionByName(rims)
        owned = cut(both.groupBy("scan", "ti", "tj").applyInPandas(settle, schema))
        if owned.where("fresh").where(F.size(_beyond(tile, diagonal=True)) > 0).isEmpty():
            return owned
