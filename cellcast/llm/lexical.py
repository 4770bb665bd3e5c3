"""Ranked lexical search by windowed bucket scoring.

One pass over the documents keeps, for each, its length and the query terms it holds with their counts: these stored
postings are all that scoring reads. Corpus statistics come from them too. Scoring goes shard by shard: a shard's
postings are turned to lists by term, in order of doc_id, and traversed in fixed windows of documents. In a window each
query adds its terms' impacts into one array of sums that fits a core's cache, the windows' occupancy bitsets are joined
by OR, and only occupied places are harvested into the query's heap of best documents. Each task ends with its heaps,
which meet in two rounds of bounded groups. No document and no posting is exchanged.

Queries travel to the tasks in blocks of bounded size, one stored pass over the documents for each (as a rule one).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, fm_index

#: Documents to a window: 64 KB of sums.
WINDOW = 1 << 13
#: Postings to a shard, of which a task holds one; a longer document is a shard of its own.
SHARD = 2_000_000
#: Bytes of query text to a block.
BLOCK = 8 << 20
#: First-round groups to a query.
SALTS = 64
#: The BM25 constants, in whole numbers: b is 75 hundredths, k1 is 8 / 10 (fixed values).
B, SCALE, TOP, K1 = 75, 1000, 1_000_000_000, 8


class Queries:
    """The queries of a block: their distinct terms by hash, and each query's terms with repeats."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        data, offsets = common.flat(pa.array(texts, pa.string()))
        hashes, row, _, _ = common.word_hashes(data, offsets, fm_index.TABLE)
        self.terms, symbol = np.unique(hashes, return_inverse=True)
        self.ids = sorted(set(ids))
        which = np.searchsorted(self.ids, np.array(ids, np.int64))[row] if len(row) else row
        pair, count = np.unique(np.stack([which, symbol], 1), axis=0, return_counts=True) if len(row) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        self.symbol, self.count, self.bound = pair[:, 1], count, np.searchsorted(pair[:, 0], np.arange(len(self.ids) + 1))

    def postings(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each document with repeats, bounds of documents, query terms found, their counts)."""
        data, offsets = common.flat(column)
        hashes, row, _, _ = common.word_hashes(data, offsets, fm_index.TABLE)
        n = np.bincount(row, minlength=len(column))
        if not len(hashes) or not len(self.terms):
            return n, np.zeros(len(column) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[near] == hashes
        key, count = np.unique(row[known] * len(self.terms) + near[known], return_counts=True)
        return n, np.searchsorted(key, np.arange(len(column) + 1) * len(self.terms)), key % len(self.terms), count


class Scorer:
    """Scores shards of postings against the queries of a block, keeping the best documents of each."""

    def __init__(self, queries: Queries, df: np.ndarray, documents: int, terms: int, best: int, window: int = WINDOW):
        self.queries, self.documents, self.terms, self.best, self.window = queries, documents, terms, best, window
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in queries.ids]  # (score, -doc_id), the worst first
        self.sums = np.zeros(window, np.int64)

    def shard(self, ids: np.ndarray, n: np.ndarray, bounds: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        """Takes in the postings of documents with ids and lengths n, those of document k at bounds[k] to bounds[k + 1]."""
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)  # documents in order of doc_id; one that repeats has a place of its own
        place[by_id] = np.arange(len(ids))
        ids = ids[by_id]
        m = 100 - B + (B * n * self.documents) // self.terms
        size = np.diff(bounds)
        at = np.repeat(place, size)
        impact = self.weight[term] * ((TOP * count) // (SCALE * count + K1 * np.repeat(m, size)))
        # lists by window and term, in order of doc_id; a place stands once in a list
        key = (at // self.window) * len(self.weight) + term
        order = np.argsort(key * self.window + at % self.window)
        key, at, impact = key[order], at[order] % self.window, impact[order]
        for k in range(-(-len(ids) // self.window)):
            low, high = np.searchsorted(key, [k * len(self.weight), (k + 1) * len(self.weight)])
            self._window(ids[k * self.window : (k + 1) * self.window], key[low:high] - k * len(self.weight), at[low:high], impact[low:high])

    def _window(self, ids: np.ndarray, term: np.ndarray, at: np.ndarray, impact: np.ndarray) -> None:
        head = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else term
        ends = np.r_[head[1:], len(term)]
        lists = {t: (at[a:b], impact[a:b], _bits(at[a:b], self.window)) for t, a, b in zip(term[head].tolist(), head.tolist(), ends.tolist(), strict=True)}
        for q, heap in enumerate(self.heaps):
            own = range(self.queries.bound[q], self.queries.bound[q + 1])
            held = [(lists[t], int(self.queries.count[x])) for x in own if (t := int(self.queries.symbol[x])) in lists]
            if not held:
                continue
            occupied = np.zeros(self.window // 8, np.uint8)
            for (places, gains, bits), times in held:
                self.sums[places] += gains * times if times > 1 else gains
                occupied |= bits
            places = np.flatnonzero(np.unpackbits(occupied, bitorder="little"))
            self._harvest(heap, ids[places], self.sums[places])
            self.sums[places] = 0

    def _harvest(self, heap: list[tuple[int, int]], ids: np.ndarray, score: np.ndarray) -> None:
        least = heap[0][0] if len(heap) == self.best else 1
        good = score >= least
        ids, score = ids[good], score[good]
        if len(score) > self.best:  # with all ties of the last that could be among the best
            good = score >= np.partition(score, -self.best)[-self.best]
            ids, score = ids[good], score[good]
            order = np.lexsort((ids, -score))[: self.best]
            ids, score = ids[order], score[order]
        for s, i in zip(score.tolist(), ids.tolist(), strict=True):
            if len(heap) < self.best:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))


def _bits(places: np.ndarray, window: int) -> np.ndarray:
    """A bitset of places."""
    flags = np.zeros(window, np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little")


def _blocks(queries: DataFrame, id: str, text: str, block: int) -> Iterator[Queries]:
    """The queries block by block, of about `block` bytes of text each; all rows of an id are in one block."""
    rows = queries.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(size / block))
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k).collect()
        yield Queries([r.i for r in own], [r.t for r in own])


def search(docs: DataFrame, queries: DataFrame, best: int = 10, id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", block: int = BLOCK, shard: int = SHARD, window: int = WINDOW) -> DataFrame:
    """(query_id, rank, id, score): the `best` documents of each query by BM25 in whole numbers, equal scores by rising id.

    Terms are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. Null and empty texts
    have no terms: such documents are never found nor counted, such queries find nothing. Only scores above 0 count.
    Rows that repeat an id are documents of their own; of queries that repeat one, different texts count as one query
    and equal ones once. Rows without an id aren't found, but count in the statistics. Other columns aren't read.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t"))
    parts = []
    for own in _blocks(queries, query_id, query_text, block):
        shared = context.broadcast(own)

        def post(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches):
                n, bounds, term, count = shared.value.postings(batch.column(1))
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *lists], ["i", "n", "terms", "counts"])

        stored = common.cut(rows.mapInArrow(post, "i long, n long, terms array<int>, counts array<int>"))
        total = stored.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()  # one row
        df = np.zeros(len(own.terms), np.int64)
        for r in stored.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a block's terms at most
            df[r.t] = r.n
        state = context.broadcast((df, total.documents, total.terms or 0))

        def score(batches: Iterator[pa.RecordBatch], shared=shared, state=state) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value, *state.value, best, window)
            held, size = [], 0
            for batch in batches:
                for k in range(0, batch.num_rows, window):
                    held.append(_read(batch.slice(k, window)))
                    size += len(held[-1][3])
                    if size >= shard:
                        scorer.shard(*_together(held))
                        held, size = [], 0
            if held:
                scorer.shard(*_together(held))
            out = [(q, -i, s) for q, heap in zip(scorer.queries.ids, scorer.heaps, strict=True) for s, i in heap]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["q", "i", "score"])

        found = stored.where("n > 0 AND i IS NOT NULL AND size(terms) > 0").mapInArrow(score, "q long, i long, score long")
        parts.append(common.cut(_top(_top(found, ["q", F.pmod(F.xxhash64("i"), F.lit(SALTS))], best), ["q"], best)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(F.col("q").alias(query_id), "rank", F.col("i").alias(id), "score")


def _top(rows: DataFrame, keys: list, best: int) -> DataFrame:
    """The best rows of each group with their rank."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "i")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    terms, counts = batch.column(2), batch.column(3)
    size = terms.value_lengths().to_numpy()
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), size, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)


def _together(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    ids, n, size, term, count = (np.concatenate(x) for x in zip(*held, strict=True))
    return ids, n, np.r_[0, np.cumsum(size)], term, count
