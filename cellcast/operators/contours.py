"""Contours of labelled regions as rows: segments of lines, chains of them within tiles, and chains ranked along lines.

Each square of four gates gives a label's line one or two segments, by the square's own gates alone. A task joins the
segments of one tile into chains by pointer doubling, so a line within a tile is done there. Chains that cross tiles are
ranked by pointer doubling over stored tables of chains: rounds are as many as the logarithm of the tiles that the
longest line crosses, and neither a label nor a line is ever brought together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import graph

TILE = 256
#: Sides of a square of gates (top, right, bottom, left), where a line meets them, in half steps from its first gate.
_SIDES = ((0, 1), (1, 2), (2, 1), (1, 0))
#: Of a node's number, the bits of its column.
_BITS = 32


def _turns(mask: int) -> list[tuple[int, int]]:
    """(side where the line enters, side where it leaves) of a square whose gates inside are the bits, clockwise.

    Clockwise, a line enters between a gate inside and one outside, and leaves around the gate inside just passed.
    """
    inside = [mask >> k & 1 for k in range(4)]
    leave = [k for k in range(4) if not inside[k] and inside[(k + 1) % 4]]
    return [(k, min(leave, key=lambda m: (k - m) % 4)) for k in range(4) if inside[k] and not inside[(k + 1) % 4]]


def segments(labels: DataFrame, gates: DataFrame) -> DataFrame:
    """(scan, poly_id, r, c, start, end) of labels (scan, i, j, poly_id), all of them gates: the squares' line segments.

    A node is the middle between a gate inside and one outside, numbered by twice its row and column. Lines keep the
    inside on their left and aren't drawn beyond the gates' largest i and j or below 0.
    """
    size = gates.groupBy("scan").agg(F.max("i").alias("max_i"), F.max("j").alias("max_j"))
    square = lambda di, dj, bit: F.struct((F.col("i") - di).alias("r"), (F.col("j") - dj).alias("c"), F.lit(bit).alias("bit"))
    met = labels.where("poly_id <> 0").select("scan", "poly_id", F.inline(F.array(square(0, 0, 1), square(0, 1, 2), square(1, 1, 4), square(1, 0, 8))))
    masks = met.groupBy("scan", "poly_id", "r", "c").agg(F.bit_or("bit").alias("mask")).where("mask < 15 AND r >= 0 AND c >= 0").join(size, "scan").where("r < max_i AND c < max_j")
    turn = lambda k, m: F.struct(*[F.lit(x).alias(n) for n, x in zip(("fr", "fc", "tr", "tc"), (*_SIDES[k], *_SIDES[m]), strict=True)])
    none = F.filter(F.array(turn(0, 0)), lambda _: F.lit(False))
    table = F.array(*[F.array(*[turn(k, m) for k, m in _turns(mask)]) if _turns(mask) else none for mask in range(16)])
    node = lambda dr, dc: F.shiftleft((2 * F.col("r") + F.col(dr)).cast("long"), _BITS) + 2 * F.col("c") + F.col(dc)
    return masks.select("scan", "poly_id", "r", "c", F.inline(F.get(table, F.col("mask")))).select("scan", "poly_id", "r", "c", node("fr", "fc").alias("start"), node("tr", "tc").alias("end"))


def ranked(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element of linked lists the first element of its list and how many lie before it.

    before: the previous element, a first one's is itself. A ring's smallest element counts as its first.
    """
    here, rounds = np.arange(len(before)), len(before).bit_length()
    low, jump = here, before
    for _ in range(rounds):
        low, jump = np.minimum(low, low[jump]), jump[jump]
    ring = before[jump] != jump  # only on a ring a jump never comes to rest
    before = np.where(ring & (low == here), here, before)
    rank, jump = (before != here).astype(np.int64), before
    for _ in range(rounds):
        rank, jump = rank + rank[jump], jump[jump]
    return jump, rank


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile's segments, each with the first node of its chain and the number of segments before it."""
    pdf = pdf.sort_values(["poly_id", "start"], ignore_index=True)
    ends = pd.Series(pdf.index, pd.MultiIndex.from_frame(pdf[["poly_id", "end"]]))
    found = ends.reindex(pd.MultiIndex.from_frame(pdf[["poly_id", "start"]])).to_numpy()
    first, rank = ranked(np.where(np.isnan(found), pdf.index, found).astype(np.int64))
    return pdf.assign(chain=pdf.start.to_numpy()[first], rank=rank)[["scan", "poly_id", "start", "end", "chain", "rank"]]


def _placed(chains: DataFrame) -> DataFrame:
    """Chains with their line (any value, the same for all of a line), n_before: segments of the line before the chain, and whether it is a ring."""
    key = F.struct("scan", "poly_id", "chain")
    links = chains.where("tail <> chain").select("scan", "poly_id", F.col("tail").alias("chain"), F.col("chain").alias("prev"), F.col("n").alias("n_prev"))
    linked = cut(chains.join(links, ["scan", "poly_id", "chain"], "left"))
    parts = graph.parts(linked.where("prev IS NOT NULL").select(key.alias("a"), F.struct("scan", "poly_id", F.col("prev").alias("chain")).alias("b")))
    named = linked.withColumn("node", key).join(parts, "node", "left").withColumn("line", F.coalesce("root", "node")).drop("root")
    # a line's first chain is the one without another before it, on a ring that with the smallest node
    first = named.groupBy("line").agg(F.min(F.struct(F.col("prev").isNotNull().alias("ring"), "low", "chain")).alias("first"))
    state = cut(named.join(first, "line").withColumn("at_first", F.col("chain") == F.col("first.chain")).select(
        "*", F.when(~F.col("at_first"), F.col("prev")).alias("jump"), F.when(F.col("at_first"), 0).otherwise(F.col("n_prev")).cast("long").alias("n_before")
    ).select("scan", "poly_id", "chain", "tail", "n", "low", "low_rank", "line", (F.col("first.ring") | (F.col("tail") == F.col("chain"))).alias("ring"), "at_first", "jump", "n_before"))
    while not state.where("jump IS NOT NULL").isEmpty():
        far = state.select("scan", "poly_id", F.col("chain").alias("jump"), F.col("jump").alias("next"), F.col("n_before").alias("more"))
        there = state.join(far, ["scan", "poly_id", "jump"], "left")
        state = cut(there.withColumn("n_before", F.col("n_before") + F.coalesce("more", F.lit(0))).withColumn("jump", F.col("next")).select(*state.columns))
    return state.drop("jump")


def points(labels: DataFrame, gates: DataFrame, step: int = 8, tile: int = TILE) -> DataFrame:
    """(scan, poly_id, k, i, j): every step-th point of each label's longest line, k its place on it, at the gate that holds it.

    A line starts where it comes from the grid's rim, or, if it is closed, at its smallest (row, column), which is then
    its last point too. Of equally long lines open ones come first, then those with the smallest start. A label that
    fills the grid has no line and no row. Labels must be gates; null and 0 are no label, repeated rows count once.
    """
    side = lambda c: F.floor(F.col(c) / tile).cast("int")
    tiles = segments(labels, gates).withColumn("ti", side("r")).withColumn("tj", side("c")).select("scan", "ti", "tj", "poly_id", "start", "end")
    own = cut(tiles.groupBy("scan", "ti", "tj").applyInPandas(_chains, "scan string, poly_id long, start long, end long, chain long, rank long"))
    chains = own.groupBy("scan", "poly_id", "chain").agg(F.count("*").alias("n"), F.max_by("end", "rank").alias("tail"), F.min("start").alias("low"), F.min_by("rank", "start").alias("low_rank"))
    placed = _placed(chains)
    origin = lambda on_ring, open_: F.max(F.when(F.col("at_first"), F.when(F.col("ring"), F.col(on_ring)).otherwise(open_)))
    lines = placed.groupBy("scan", "poly_id", "line").agg(F.sum("n").alias("total"), F.max("ring").alias("ring"), origin("low", F.col("chain")).alias("from"), origin("low_rank", F.lit(0)).alias("shift"))
    best = lines.groupBy("scan", "poly_id").agg(F.min(F.struct((-F.col("total")).alias("total"), "ring", "from", "line", "shift")).alias("best"))
    drawn = placed.join(best, ["scan", "poly_id"]).where("line = best.line").select("scan", "poly_id", "chain", (F.col("n_before") - F.col("best.shift")).alias("ahead"), (-F.col("best.total")).alias("total"))
    placed_own = own.join(drawn, ["scan", "poly_id", "chain"]).withColumn("k", F.pmod(F.col("ahead") + F.col("rank"), F.col("total")))
    point = lambda k, node: F.struct(k.alias("k"), node.alias("node"))
    here = point(F.col("k"), F.col("start"))
    both = F.when(F.col("k") == F.col("total") - 1, F.array(here, point(F.col("k") + 1, F.col("end")))).otherwise(F.array(here))
    found = placed_own.select("scan", "poly_id", F.inline(both)).where(F.col("k") % step == 0)
    half = lambda x: F.floor(x / 2).cast("int")
    return found.select("scan", "poly_id", "k", half(F.shiftright("node", _BITS)).alias("i"), half(F.col("node").bitwiseAND((1 << _BITS) - 1)).alias("j"))
