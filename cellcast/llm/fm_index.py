"""Benchmark decontamination with an FM-index of each training shard.

A shard is a few megabytes of documents. Its words become symbols: words of the benchmark get ids, and every run of
words that the benchmark doesn't know, or that is too short for a phrase, becomes one separator, so the indexed text
is exactly the part of the shard in which a phrase can occur. The shard's Burrows-Wheeler transform is kept as a
wavelet matrix; all phrases are searched backwards at once by its ranks, rows are turned into positions by walking to
a sampled suffix, and the spans found are merged into runs of words to remove.

Phrases travel to the tasks in blocks of bounded size, one stored pass over the documents for each block (as a rule
one); the driver holds one block at a time. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: UTF-8 bytes of documents to a shard; a longer document is a shard of its own.
SHARD = 12 << 20
#: Bytes of benchmark text to a block of phrases.
BLOCK = 8 << 20
#: Every so many positions of a run, a suffix position is stored.
STEP = 16
#: Words end at bytes below 0x80 that are no digit or letter.
TABLE = common.byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]).translate(None, bytes(range(0x41, 0x5B))), lower=True)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of `symbols`; 0 is a separator, smaller than every symbol and distinct at each place (by position)."""
    n = len(symbols)
    stops = symbols == 0
    n_stops = int(stops.sum())
    rank = symbols.astype(np.int64) + n_stops
    rank[stops] = np.arange(n_stops)
    bits = int(rank.max()).bit_length()
    width = max(1, 63 // bits)  # so many places fit into one key
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: n - k] |= rank[k:] if k < n else 0
    # a separator is unique, so what stands after it never decides; the last place is a separator
    order = np.argsort(key, kind="stable")
    rank = _ranks(key, order, np.zeros(n, np.int64))
    reach = width
    while True:
        sorted_rank = rank[order]
        tied = np.flatnonzero(np.r_[False, sorted_rank[1:] == sorted_rank[:-1]])
        if not len(tied):
            return order
        member = np.unique(np.r_[tied - 1, tied])  # only rows of ties are sorted again
        own = order[member]
        later = rank[np.minimum(own + reach, n - 1)]
        again = np.lexsort((later, sorted_rank[member]))
        order[member] = own[again]
        rows = order[member]
        first, second = rank[rows], rank[np.minimum(rows + reach, n - 1)]
        fresh = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[rows] = np.maximum.accumulate(np.where(fresh, member, 0))
        reach *= 2


def _ranks(key: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each place, the first row of its group of equal keys."""
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return rank


class WaveletMatrix:
    """Ranks of any symbol in a sequence, by one bit vector for each bit of the symbols."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels, self.bits, self.counts, self.zeros = max(1, (sigma - 1).bit_length()), [], [], []
        for level in reversed(range(self.levels)):
            bit = ((values >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))])
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & below).astype(np.int64)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level)) & 1
            ones = self._ones(level, at)
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.start[symbol]

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = (self.bits[level][at >> 6] >> (at & 63).astype(np.uint64)).astype(np.int64) & 1
            ones = self._ones(level, at)
            symbol = 2 * symbol + one
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
        return symbol, at - self.start[symbol]


class FMIndex:
    """Backward search over symbols 1..sigma-1, with separators 0 before, between and after the runs."""

    def __init__(self, symbols: np.ndarray, sigma: int, step: int = STEP):
        n = len(symbols)
        order = suffix_order(symbols)
        bwt = symbols[order - 1]  # the text is a ring, and its last place is a separator
        self.matrix = WaveletMatrix(bwt, sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(symbols, minlength=sigma))]
        run = np.arange(n) - np.maximum.accumulate(np.where(symbols == 0, np.arange(n), -1))
        # a run's first place is sampled, so a walk never meets a separator
        sampled = (run % step == 1 % step) | (symbols == 0)
        marked = sampled[order]
        self.marked, self.stored, self.nth = marked, order[marked], np.cumsum(marked) - 1

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of phrases (right-aligned in a table of symbols)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.before[-1])
        for k in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((sizes >= k) & (low < high))
            if not len(on):
                break
            symbol = phrases[on, -k]
            low[on] = self.before[symbol] + self.matrix.rank(symbol, low[on])
            high[on] = self.before[symbol] + self.matrix.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of suffix rows."""
        at, back = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[at])
        while len(todo):
            symbol, count = self.matrix.step(at[todo])
            at[todo] = self.before[symbol] + count
            back[todo] += 1
            todo = todo[~self.marked[at[todo]]]
        return self.stored[self.nth[at]] + back


class Phrases:
    """The windows of some benchmark items: the items' words by hash, and each distinct window with its items."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int):
        column = pa.array(texts, pa.string())
        data, offsets = common.flat(column)
        hashes, row, _, _ = common.word_hashes(data, offsets, TABLE)
        self.words, symbol = np.unique(hashes, return_inverse=True)
        bound = np.searchsorted(row, np.arange(len(ids) + 1))
        size = np.minimum(np.diff(bound), width)
        count = np.where(size > 0, np.diff(bound) - size + 1, 0)
        item = np.repeat(np.arange(len(ids)), count)
        start = bound[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        table = np.zeros((len(item), width), np.int32)  # right-aligned, 0 where a short window has no word
        for k in range(1, width + 1):
            on = size[item] >= k
            table[on, -k] = symbol[start[on] + size[item[on]] - k] + 1
        self.table, which = np.unique(table, axis=0, return_inverse=True)
        self.sizes = (self.table > 0).sum(1)
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0
        pair = np.unique(np.stack([which.ravel(), np.array(ids, np.int64)[item]], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.items, self.first = pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(self.sizes) + 1))

    def items_of(self, window: int) -> list[int]:
        return self.items[self.first[window] : self.first[window + 1]].tolist()

    def occurrences(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """In a shard, given as (word hashes, rows) with rows rising: (place of the first word, window) of all occurrences."""
        kept, where, at = [], [], 0
        for hashes, row in parts:
            near = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            symbol = np.where(self.words[near] == hashes, near + 1, 0)
            cut = (symbol[1:] == 0) | (symbol[:-1] == 0) | (row[1:] != row[:-1])
            start = np.flatnonzero(np.r_[True, cut])
            size = np.diff(np.r_[start, len(symbol)])
            good = np.repeat((size >= self.shortest) & (symbol[start] > 0), size) if len(symbol) else np.zeros(0, bool)
            place = np.flatnonzero(good)
            first = np.zeros(len(symbol), bool)
            first[start] = True
            text = np.insert(symbol[place], np.flatnonzero(first[place]), 0)  # a separator before each run
            kept.append(text)
            where.append(np.insert(at + place, np.flatnonzero(first[place]), -1))
            at += len(symbol)
        text, where = np.concatenate([*kept, [0]]), np.concatenate([*where, [-1]])
        if len(text) == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = FMIndex(text, len(self.words) + 1)
        low, high = index.search(self.table, self.sizes)
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low, count) + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        return where[index.locate(rows)], window


def _blocks(benchmark: DataFrame, id: str, text: str, width: int, block: int) -> Iterator[tuple[Phrases, bool]]:
    """The benchmark's phrases block by block, of about `block` bytes of text each, and whether a block is the last."""
    rows = benchmark.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(size / block))
    for k in range(parts):
        own = rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k).collect()
        yield Phrases([r.i for r in own], [r.t for r in own], width), k == parts - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """`docs` without the words that lie in an occurrence of a benchmark window, and what was found.

    All columns of `docs` come back, the text cut, followed by n_words, n_hit, n_items, items_sha256, contaminated and
    items (those that aren't columns of `docs` already: for such names the input's column stays). Runs of hit words
    leave with what stands between them. Null and empty texts have no words and come back as they are; repeated rows
    and ids are rows like any other; items without an id or without words match nothing.
    """
    rows = common.pack(docs, id, text)
    plain = rows
    more = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>"
    context = docs.sparkSession.sparkContext
    first = True
    for phrases, last in _blocks(benchmark, item_id, item_text, width, block):
        shared = context.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            phrases, held, size = shared.value, [], 0
            for batch in common.slices(batches):
                held.append(batch)
                size += batch.column(1).nbytes
                if size >= shard:
                    yield from _search(held, phrases, first, last)
                    held, size = [], 0
            if held:
                yield from _search(held, phrases, first, last)

        rows = rows.mapInArrow(run, common.extended(plain, more if last else "spans array<long>, items array<long>"))
        if not last:  # a pass is done before the next block of phrases is read
            rows = common.cut(rows)
            shared.destroy()
        first = False
    return common.unpack(rows, docs, id, text, [m.split()[0] for m in more.split(", ")])


def _search(held: list[pa.RecordBatch], phrases: Phrases, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    words = []
    for batch in held:
        data, offsets = common.flat(batch.column(1))
        words.append((data, offsets, *common.word_hashes(data, offsets, TABLE)))
    place, window = phrases.occurrences([(w[2], w[3]) for w in words]) if len(phrases.sizes) else (np.zeros(0, np.int64),) * 2
    by_place = np.argsort(place, kind="stable")
    place, window, at = place[by_place], window[by_place], 0
    for batch, (data, offsets, hashes, row, start, end) in zip(held, words, strict=True):
        n, total = batch.num_rows, len(hashes)
        own = slice(*np.searchsorted(place, [at, at + total]))
        begin, which = place[own] - at, window[own]
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + phrases.sizes[which], -1)
        hit = np.cumsum(edge)[:total] > 0
        first_word = np.searchsorted(row, np.arange(n + 1))
        if not first:  # what earlier passes have found, as places in the document
            for k, spans in enumerate(batch.column(3).to_pylist()):
                hit[first_word[k] + np.array(spans, np.int64)] = True
        items: list[set[int]] = [set(x) for x in batch.column(4).to_pylist()] if not first else [set() for _ in range(n)]
        for r, w in set(zip(row[begin].tolist(), which.tolist(), strict=True)):
            items[r].update(phrases.items_of(w))
        at += total
        if not last:
            spans = [np.flatnonzero(hit[a:b]) for a, b in zip(first_word, first_word[1:], strict=False)]
            out = [*batch.columns[:3], pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["i", "t", "r", "spans", "items"])
            continue
        n_hit = np.bincount(row[hit], minlength=n)
        texts = common.raw(batch.column(1))
        cut = batch.column(1).to_pylist() if n_hit.any() else batch.column(1)
        for k in np.flatnonzero(n_hit):
            own = np.arange(first_word[k], first_word[k + 1])
            cut[k] = remove(texts[k], start[own] - offsets[k], end[own] - offsets[k], hit[own]).decode()
        joined = [sorted(map(str, x)) for x in items]
        out = [
            batch.column(0), pa.array(cut, pa.string()) if n_hit.any() else cut, batch.column(2), pa.array(np.diff(first_word)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in joined]), pa.array(n_hit > 0), pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(out, ["i", "t", "r", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def remove(text: bytes, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between neighbours of them."""
    edge = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1]])
    parts, at = [], 0
    for a, b in zip(edge, np.r_[edge[1:], len(hit)], strict=True):
        if hit[a]:
            parts.append(text[at : start[a]])
            at = end[b - 1]
    return b"".join([*parts, text[at:]])
