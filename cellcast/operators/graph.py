"""Connected parts of graphs given as tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def parts(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b) of any orderable type: root is the smallest node reachable.

    Each round points every node at the neighbour that comes first in an order by hashes, another one each round, and
    contracts the graph along these pointers. As the order knows nothing of the nodes', about half of them are left
    after a round, also on chains whose nodes rise from link to link. Rounds are stored. Links of a node to itself,
    repeated links and either order of ends are fine; without links there are no rows.
    """
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    rest = cut(links.select("a", "b").where("a <> b").select(*ordered("a", "b")).distinct())
    names: DataFrame | None = None
    turn = 0
    while not rest.isEmpty():
        turn += 1
        place = lambda c, seed=turn: F.struct(F.xxhash64(F.lit(seed), c).alias("at"), F.col(c).alias("node"))
        first = rest.unionByName(rest.selectExpr("b AS a", "a AS b")).groupBy("a").agg(F.min(place("b")).alias("first"))
        step = cut(first.select(F.col("a").alias("node"), F.least(place("a"), F.col("first"))["node"].alias("root")))
        rest = cut(rest.join(step.selectExpr("node AS a", "root AS ra"), "a").join(step.selectExpr("node AS b", "root AS rb"), "b").where("ra <> rb").select(*ordered("ra", "rb")).distinct())
        names = step if names is None else names.join(step.selectExpr("node AS root", "root AS next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    if names is None:
        return rest.selectExpr("a AS node", "b AS root")
    smallest = names.groupBy("root").agg(F.min("node").alias("smallest"))
    return names.join(smallest, "root").select("node", F.col("smallest").alias("root"))
