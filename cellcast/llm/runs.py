"""Periodic runs of words by Crochemore's partition refinement.

At level k the positions of a document are partitioned into classes of equal k-word factors. Level k+1 follows from
level k by splitting each class by the classes of the positions one further, and only the classes that the last step
made anew, all but the largest part of each (the smaller-half strategy), need to be looked at. So a position is touched
at most log n times, however many levels there are. Class members are linked in order of position: where neighbours at
level k lie k apart, a square of period k begins, and squares that begin one after another make up a run. Neighbours
only ever reveal squares of primitive roots, so a run is found under its smallest period alone.

All documents of a batch are refined together, a level being a handful of array operations; each ends with a separator
of its own, so no factor reaches over two of them. Documents are never exchanged, and the only state is a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, fm_index

#: UTF-8 bytes of documents that are refined together; a longer document is a batch of its own.
BATCH = 8 << 20
#: Least words of a run.
LEAST = 12
_TABLE = common.byte_table(common.SPACES, lower=False)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges [first, first + size), one range after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Partition:
    """Classes of equal factors of all documents of a batch, refined level by level.

    A class is a stretch of slots, named by its first; `elems` has the positions in slots and `loc` the slots of
    positions. `nxt` and `prv` link the members of a class by position, `birth` is the level from which a link to the
    next member holds. A link between members g apart reveals a square if it holds at level g.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        """symbols: one number for each word, those of document r at bounds[r] to bounds[r + 1]."""
        counts = np.diff(bounds)
        n = len(symbols) + len(counts)  # a separator after each document
        self.row = np.repeat(np.arange(len(counts)), counts + 1)
        self.half = counts // 2
        word = np.ones(n, bool)
        word[bounds[1:] + np.arange(len(counts))] = False
        key = np.full(n, -1, np.int64)
        key[word] = self.row[word] * (int(symbols.max(initial=0)) + 1) + symbols
        self.elems = np.argsort(key, kind="stable")
        ordered = key[self.elems]
        fresh = np.ones(n, bool)  # separators stay alone
        fresh[1:] = (ordered[1:] != ordered[:-1]) | (ordered[1:] < 0)
        first = np.flatnonzero(fresh)
        size = np.diff(np.r_[first, n])
        self.loc, self.start, self.size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
        self.loc[self.elems] = np.arange(n)
        self.start[self.elems] = np.repeat(first, size)
        self.size[first] = size
        self.nxt, self.prv, self.birth = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
        linked = np.flatnonzero(~fresh)
        self.nxt[self.elems[linked - 1]] = self.elems[linked]
        self.prv[self.elems[linked]] = self.elems[linked - 1]
        self.moved = np.zeros(n, bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def _report(self, at: np.ndarray, level: int | np.ndarray) -> None:
        """The squares at positions whose link to the next member has held up to `level`."""
        gap = self.nxt[at] - at
        hit = (self.nxt[at] >= 0) & (self.birth[at] <= gap) & (gap <= level)
        if hit.any():
            self.found.append((at[hit], gap[hit]))

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) of all squares of primitive roots; positions count separators."""
        splitters, level = np.arange(1, len(self.elems)), 1
        while len(splitters):
            splitters = self._refine(splitters, level)
            level += 1
        alive = np.flatnonzero(self.nxt >= 0)
        self._report(alive, self.half[self.row[alive]])  # a document's levels end at half its length
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.found, strict=True))

    def _refine(self, splitters: np.ndarray, level: int) -> np.ndarray:
        """From this level to the next by the members of classes that are new at it; the next step's splitters (rising)."""
        at = splitters - 1
        good = (self.size[self.start[at]] > 1) & (level < self.half[self.row[at]])
        at, by = at[good], self.start[splitters[good]]
        if not len(at):
            return at
        # members of one class and one splitter make up a group; positions rise within groups
        own = self.start[at]
        key = own * len(self.elems) + by
        order = np.argsort(key, kind="stable")
        at, own, key = at[order], own[order], key[order]
        group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[group, len(at)])
        parent = own[group]
        stays = many == self.size[parent]  # a class that moves as a whole isn't split
        if stays.any():
            keep = np.repeat(~stays, many)
            at, own, many, parent = at[keep], own[keep], many[~stays], parent[~stays]
            group = np.cumsum(many) - many
            if not len(at):
                return at
        head = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])  # first group of each class
        classes = parent[head]
        gone = np.add.reduceat(many, head)
        rest = self.size[classes] - gone
        largest = np.maximum.reduceat(many, head)
        self._relink(at, own, group, level)
        # the groups take the last slots of their class; what stands there and stays goes to the slots they leave
        slots = _ranges(classes + rest, gone)
        self.moved[at] = True
        there = self.elems[slots]
        staying = there[~self.moved[there]]
        self.moved[at] = False
        left = self.loc[at]
        left = left[left < np.repeat(classes + rest, gone)]
        self.elems[left] = staying
        self.loc[staying] = left
        self.elems[slots] = at
        self.loc[at] = slots
        self.size[classes] = rest
        self.start[at] = np.repeat(slots[group], many)
        self.size[slots[group]] = many
        # all parts but a largest one of each class split the next level
        per = np.diff(np.r_[head, len(many)])
        rest_each, largest_each = np.repeat(rest, per), np.repeat(largest, per)
        top = (many == largest_each) & (largest_each > rest_each)
        nth = np.cumsum(top)
        top &= nth == np.repeat(nth[head] - top[head] + 1, per)  # the first of equals
        small = at[np.repeat(~top, many)]
        over = (rest > 0) & (rest < largest)
        if over.any():
            small = np.concatenate([small, self.elems[_ranges(classes[over], rest[over])]])
        small.sort()
        return small[small > 0]

    def _relink(self, at: np.ndarray, own: np.ndarray, group: np.ndarray, level: int) -> None:
        """Takes members out of their classes' lists and links them in their groups, reporting links that end."""
        order = np.lexsort((at, own))
        lost = at[order]
        joined = self.nxt[lost[:-1]] == lost[1:]
        begin, end = lost[np.r_[True, ~joined]], lost[np.r_[~joined, True]]
        before, after = self.prv[begin], self.nxt[end]
        near = before[before >= 0]
        self._report(np.concatenate([lost, near]), level)
        self.nxt[near], self.birth[near] = after[before >= 0], level + 1
        self.prv[after[after >= 0]] = before[after >= 0]
        self.nxt[at[:-1]], self.nxt[at[-1]] = at[1:], -1
        self.prv[at[1:]] = at[:-1]
        self.nxt[at[group[1:] - 1]] = -1
        self.prv[at[group]] = -1
        self.birth[at] = level + 1


def find(symbols: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs of at least `least` words, by document, start and period.

    A run is a stretch with smallest period q, of 2 q words at least, that can't be extended either way.
    """
    at, period = Partition(symbols, bounds).squares()
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    row = np.searchsorted(bounds[1:] + np.arange(1, len(bounds)), at, "right")  # where each document's separator ends it
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1]) | (row[1:] != row[:-1])]) if len(at) else at
    last = np.r_[first[1:], len(at)] - 1 if len(at) else at
    row, period = row[first], period[first]
    length = at[last] + 2 * period - at[first]
    start = at[first] - row - bounds[row]
    long = length >= least
    row, start, length, period = row[long], start[long], length[long], period[long]
    order = np.lexsort((period, start, row))
    return row[order], start[order], length[order], period[order]


def repeated(row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    edge = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(edge, bounds[row] + start + period, 1)
    np.add.at(edge, bounds[row] + start + length, -1)
    return np.cumsum(edge)[:-1] > 0


def collapse(docs: DataFrame, least: int = LEAST, id: str = "doc_id", text: str = "text", batch: int = BATCH) -> DataFrame:
    """`docs` with each run cut down to its first period, and the runs themselves.

    Words are what stands between white space (space, tab, line feed and the like). All columns of `docs` come back, the
    text without the words that lie in a run after its first period (neighbours leave with what stands between them),
    followed by n_words and runs, an array of (start, length, period) in words, by start and then period (names that are
    columns of `docs` already stay the input's). Null and empty texts have no words and come back as they are; repeated
    rows and ids are rows like any other. A text of any length is refined as one, with about 150 bytes of memory a word.
    """
    rows = common.pack(docs, id, text)
    more = "n_words long, runs array<struct<start:long,length:long,period:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in common.slices(batches):
            held.append(part)
            size += part.column(1).nbytes
            if size >= batch:
                yield _collapsed(held)
                held, size = [], 0
        if held:
            yield _collapsed(held)

    def _collapsed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        texts = whole.column(1).combine_chunks() if whole.num_rows else pa.array([], pa.string())
        data, offsets = common.flat(texts)
        hashes, at, begin, end = common.word_hashes(data, offsets, _TABLE)
        bounds = np.searchsorted(at, np.arange(whole.num_rows + 1))
        symbols = np.unique(hashes, return_inverse=True)[1] if len(hashes) else np.zeros(0, np.int64)
        row, start, length, period = find(symbols, bounds, least)
        if len(row):
            gone = repeated(row, start, length, period, bounds)
            out = texts.to_pylist()
            for r in np.unique(row):
                own = slice(bounds[r], bounds[r + 1])
                plain = data[offsets[r] : offsets[r + 1]].tobytes()
                out[r] = fm_index.remove(plain, begin[own] - offsets[r], end[own] - offsets[r], gone[own]).decode()
            texts = pa.array(out, pa.string())
        each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(whole.num_rows + 1)).astype(np.int32)), each)
        columns = [whole.column(0).combine_chunks(), texts, whole.column(2).combine_chunks(), pa.array(np.diff(bounds).astype(np.int64)), runs]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["i", "t", "r", "n_words", "runs"])

    return common.unpack(rows.mapInArrow(run, common.extended(rows, more)), docs, id, text, ["n_words", "runs"])
