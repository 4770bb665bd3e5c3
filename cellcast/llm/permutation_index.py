"""Nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its nearest pivots in order; it is posted in
the inverted files of the first few of them. A query reads the files of its own nearest pivots, ranks each file's
vectors by Spearman's footrule between the two (truncated) permutations, and reranks the best of them by exact inner
products in double precision.

How many files a query reads is fitted to the table: the true neighbours of a few queries are found by brute force in
one pass, and so many files are read that FOUND of them stand in one. Vectors in clusters need few files; independent
directions need a share of them that doesn't fall with the table, so there the work grows with queries times vectors,
as that of any index.

Equal vectors are one class, of which only the k + 1 smallest ids can be among a query's k nearest. Files, and the
queries that read one, are dealt out in blocks of bounded size, so a crowded pivot is many tasks; results are merged by
a window over at most k rows for each block a query has met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Bounds on the number of pivots (about twice the square root of the classes), and the length of a permutation.
PIVOTS, LENGTH = (16, 4096), 64
#: Files a vector is posted in, vectors and queries of a block, and the least share of a block that is reranked: so
#: much that a query reranks WHOLE files' worth at least, as where it reads few files their vectors are much alike.
POSTED, BLOCK, ASKED, RERANK, WHOLE = 8, 4096, 2048, 0.3, 12
#: Queries whose true neighbours decide how many files are read, the share of them that must stand in a read file, and the fewest files.
TRIED, FOUND, LEAST = 64, 0.985, 8


def permutations(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, by inner product with unit pivots, nearest first."""
    near = vectors @ pivots.T
    length = min(length, len(pivots))
    best = np.argpartition(-near, length - 1, axis=1)[:, :length]
    order = np.lexsort((best, -np.take_along_axis(near, best, 1)), axis=1)
    return np.take_along_axis(best, order, 1)


def footrule(query: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Spearman's footrule of one permutation against many (less a constant), given as [pivot, vector] positions (`length` if absent)."""
    own = position[query]  # a row for each pivot of the query
    # pivots of the other permutation that the query lacks count with their distance to the end: all do, less these
    return (np.abs(own - np.arange(len(query), dtype=np.int16)[:, None]) + own).sum(0, dtype=np.int32) - length * len(query)


def search_block(query_ids: np.ndarray, queries: np.ndarray, q_perm: np.ndarray, ids: np.ndarray, vectors: np.ndarray, perm: np.ndarray, pivots: int, k: int, rerank: float) -> pd.DataFrame:
    length = perm.shape[1]
    position = np.full((pivots, len(ids)), length, np.int16)
    np.put_along_axis(position, perm.T.astype(np.int64), np.arange(length, dtype=np.int16)[:, None], 0)
    rerank = max(4 * k, math.ceil(rerank * len(ids)))
    out_q, out_v, out_s = [], [], []
    for q in range(len(query_ids)):
        if len(ids) > rerank:
            near = np.argpartition(footrule(q_perm[q], position, length), rerank - 1)[:rerank]
        else:
            near = np.arange(len(ids))
        score = vectors[near] @ queries[q]
        best = np.lexsort((ids[near], -score))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_v.append(ids[near][best])
        out_s.append(score[best])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return pd.DataFrame({"q": cat(out_q, np.int64), "v": cat(out_v, np.int64), "s": cat(out_s, float)})


def files_to_read(index: DataFrame, queries: np.ndarray, own: list[int], pivots: np.ndarray, k: int, posted: int) -> int:
    """So many files that FOUND of the true k nearest (other classes than the query's own) of some queries stand in one of them."""
    order = permutations(queries, pivots, len(pivots))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(pivots))[None], 1)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest of a task's vectors, for each query."""
        held = None
        for pdf in batches:
            if len(pdf):
                score = queries @ np.stack(pdf.v).astype(float).T
                score[pdf.c.to_numpy()[None] == np.array(own)[:, None]] = -np.inf
                files = np.stack(pdf.p)[:, :posted]
                top = np.argsort(-score, axis=1)[:, :k]
                found = np.take_along_axis(score, top, 1), place[np.arange(len(own))[:, None, None], files[top]].min(2)
                held = found if held is None else tuple(np.concatenate(x, 1) for x in zip(held, found, strict=True))
                top = np.argsort(-held[0], axis=1)[:, :k]
                held = tuple(np.take_along_axis(x, top, 1) for x in held)
        if held is not None:
            yield pd.DataFrame({"q": np.repeat(np.arange(len(own)), held[0].shape[1]), "s": held[0].ravel(), "r": held[1].ravel().astype("int64")})

    near = index.mapInPandas(best, "q int, s double, r long").where(F.col("s") > float("-inf"))
    ranked = near.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "r"))).where(F.col("n") <= k)
    needed = np.sort([r.r for r in ranked.select("r").collect()])  # k for each query tried
    return int(min(len(pivots), max(LEAST, needed[math.ceil(FOUND * len(needed)) - 1] + 1))) if len(needed) else LEAST


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", posted: int = POSTED, read: int | None = None, rerank: float = RERANK, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for the rows where `is_query`, by largest inner product.

    is_query: a condition on the column of ids. read: files that each query reads, by default fitted to the table. Ties go to the smaller id; a query itself is never its own neighbour.
    Vectors that are null, zero, of another length than the first (by id), or that hold null or non-finite components
    take no part, nor do rows without an id. Rows that repeat an id and a vector count once. Fewer than k candidates
    give fewer rows, an empty table none. Other columns aren't read.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "float" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "double"
    plain = F.transform(F.col(vector), lambda x: x.cast(kind) + F.lit(0).cast(kind))  # turns -0 to 0
    rows = vectors.select(F.col(id).cast("long").alias("i"), plain.alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("i").isNotNull() & v.isNotNull() & fine).distinct()
    head = rows.select("i", F.size("v").alias("n")).orderBy("i").first()
    schema = f"query_id long, rank int, {id} long, score double"
    if head is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == head.n).withColumn("h", F.xxhash64("v"))
    # the k + 1 smallest ids of each class of equal vectors; the limit is applied before rows are exchanged
    some = rows.withColumn("n", F.row_number().over(W.partitionBy("h", "v").orderBy("i"))).where(F.col("n") <= k + 1)
    classes = common.cut(some.groupBy("h", "v").agg(F.min("i").alias("c"), F.sort_array(F.collect_list("i")).alias("ids")))
    total = classes.count()
    m = int(min(total, max(PIVOTS[0], min(PIVOTS[1], round(2 * total**0.5)))))
    sample = np.array([r.v for r in classes.select("h", "c", "v").orderBy("h", "c").limit(m).collect()])
    pivots = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    length = min(LENGTH, m)
    shared = spark.sparkContext.broadcast(pivots)

    def permute(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["c", "v"]].assign(p=list(permutations(np.stack(pdf.v).astype(float), shared.value, length).astype(np.int16)))

    asks = rows.where("asks").select("h", "v", "i")
    askers = asks.groupBy("h", "v").agg(F.count("*").alias("n"))
    index = common.cut(classes.select("c", "v").mapInPandas(permute, f"c long, v array<{kind}>, p array<smallint>"))
    asking = classes.join(askers, ["h", "v"]).select("c")
    asking = common.cut(index.join(asking, "c"))
    if read is None:
        tried = asking.orderBy(F.xxhash64("c"), "c").limit(TRIED).collect()
        read = files_to_read(index, np.array([r.v for r in tried], float), [r.c for r in tried], pivots, k, posted) if tried else LEAST

    rerank = min(1.0, max(rerank, WHOLE / read))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(f=list(permutations(np.stack(pdf.v).astype(float), shared.value, read).astype(np.int16)))

    posts = index.select("c", "v", "p", F.explode(F.slice("p", 1, posted)).alias("f"))
    reads = asking.mapInPandas(choose, f"c long, v array<{kind}>, p array<smallint>, f array<smallint>").withColumn("f", F.explode("f"))
    counted = lambda rows, size, name: rows.groupBy("f").agg(F.ceil(F.count("*") / size).cast("int").alias(name))  # noqa: E731 - a row for each pivot: at most PIVOTS[1]
    blocks = F.broadcast(common.cut(counted(posts, block, "parts").join(counted(reads, asked, "askers"), "f")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("c"), n).cast("int")
    posts = posts.join(blocks, "f").select("f", "c", "v", "p", deal("parts").alias("part"), each("askers").alias("asker"))
    reads = reads.join(blocks, "f").select(F.col("f").alias("qf"), F.col("c").alias("qc"), F.col("v").alias("qv"), F.col("p").alias("qp"), deal("askers").alias("qasker"), each("parts").alias("qpart"))

    def search(posts: pd.DataFrame, reads: pd.DataFrame) -> pd.DataFrame:
        if not len(posts) or not len(reads):
            return pd.DataFrame({"q": [], "v": [], "s": []}).astype({"q": "int64", "v": "int64", "s": "float64"})
        return search_block(reads.qc.to_numpy(), np.stack(reads.qv).astype(float), np.stack(reads.qp), posts.c.to_numpy(), np.stack(posts.v).astype(float), np.stack(posts.p), len(shared.value), k + 1, rerank)

    found = posts.groupBy("f", "part", "asker").cogroup(reads.groupBy("qf", "qpart", "qasker")).applyInPandas(search, "q long, v long, s double")
    top = W.partitionBy("q").orderBy(F.desc("s"), "v")
    best = found.groupBy("q", "v").agg(F.max("s").alias("s")).withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    # classes become ids: at most k + 1 for each class of queries, then each query drops itself
    members = best.select("q", F.col("v").alias("c"), "s").join(classes.select("c", "ids"), "c").select("q", "s", F.explode("ids").alias("i"))
    ranked = members.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "i"))).where(F.col("n") <= k + 1)
    lists = ranked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "i", "s"))).alias("near"))
    named = asks.join(classes.select("h", "v", F.col("c").alias("q")), ["h", "v"]).select("q", F.col("i").alias("query_id"))
    own = named.distinct().join(lists, "q").select("query_id", F.slice(F.filter("near", lambda x: x["i"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.i").alias(id), F.col("x.s").alias("score"))
