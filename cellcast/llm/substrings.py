"""Removal of long repeated passages by recompression.

Every text is rewritten in rounds. A round names runs of equal symbols and then pairs of neighbours, a pair being
named if its first symbol falls left and its second right in a random split of the alphabet. A name is a fixed function
of what it stands for, so every round names alike in all documents and tasks, without an exchange, and equal passages
get equal symbols away from their ends. Symbols of at least GROWN words are finished. Each symbol carries the range of
words that decided its existence: wherever these words stand, the symbol stands too.

A window of words can only repeat in another document if each symbol whose range lies inside the window occurs in
another document. The symbols of all documents are therefore counted, unshared symbols rule out the windows around
them, and only the windows left (few outside real repeats) are compared. Names of 64 bits only choose what is compared:
should two meet, a window more is compared, and none is lost. What is removed is decided by 128-bit digests of the
windows' own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fm_index import remove

#: Words from which a symbol takes part in no further round, and the number of rounds.
GROWN, ROUNDS = 8, 8
_U = np.uint64
_TABLE = common.byte_table(common.SPACES, lower=False)


class Symbols:
    """A slice of documents as a sequence of symbols: name, words [lo, hi), deciding words [dl, dr), document."""

    def __init__(self, words: np.ndarray, row: np.ndarray):
        n = len(words)
        self.words, self.row, self.name = words, row, words.copy()
        self.lo, self.hi = np.arange(n), np.arange(n) + 1
        self.dl, self.dr = self.lo.copy(), self.hi.copy()

    def _take(self, index: np.ndarray) -> None:
        self.name, self.row, self.lo, self.hi, self.dl, self.dr = (x[index] for x in (self.name, self.row, self.lo, self.hi, self.dl, self.dr))

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a symbol has a left and a right neighbour in its document."""
        same = self.row[1:] == self.row[:-1]
        return np.r_[False, same], np.r_[same, False]

    def runs(self, level: int) -> None:
        grown = self.hi - self.lo >= GROWN
        left, right = self._neighbours()
        equal = right.copy()
        equal[:-1] &= (self.name[1:] == self.name[:-1]) & ~grown[:-1]
        starts = np.flatnonzero(~np.r_[False, equal[:-1]])
        ends = np.r_[starts[1:], len(self.name)] - 1
        size = ends - starts + 1
        dl, dr = np.minimum.reduceat(self.dl, starts), np.maximum.reduceat(self.dr, starts)
        lo, hi, last = self.lo[starts], self.hi[ends], len(self.words) - 1
        # a neighbour is another symbol: seen by one word if the end words differ, else by all that decided the neighbour
        first_word, last_word = self.words[lo], self.words[self.hi[starts] - 1]
        plain = ~grown[starts]
        alike = plain & left[starts] & (self.words[np.maximum(lo - 1, 0)] == last_word)
        dl = np.where(plain, np.minimum(dl, lo - 1), dl)
        dl = np.where(alike, np.minimum(dl, self.dl[starts - 1]), dl)
        dr = np.where(alike, np.maximum(dr, self.dr[starts - 1]), dr)
        after = np.minimum(ends + 1, len(self.name) - 1)
        alike = plain & right[ends] & (self.words[np.minimum(hi, last)] == first_word)
        dr = np.where(plain, np.maximum(dr, hi + 1), dr)
        dr = np.where(alike, np.maximum(dr, self.dr[after]), dr)
        dl = np.where(alike, np.minimum(dl, self.dl[after]), dl)
        name = self.name[starts]
        name = np.where(size > 1, common.mix(name + size.astype(_U) * _U(0xA0761D6478BD642F) + _U(level)), name)
        self.name, self.row, self.lo, self.hi, self.dl, self.dr = name, self.row[starts], lo, hi, dl, dr

    def pairs(self, level: int) -> None:
        grown = self.hi - self.lo >= GROWN
        left, right = self._neighbours()
        # the side of a symbol is drawn from its first word, which a left neighbour sees without knowing more of it
        second = (common.mix(self.words[self.lo] + _U(level * 0xE7037ED1A0B428DB % 2**64)) & _U(1)).astype(bool)
        free = ~grown
        join = np.zeros(len(self.name), bool)
        join[:-1] = right[:-1] & free[:-1] & free[1:] & ~second[:-1] & second[1:]
        joined = np.r_[False, join[:-1]]
        dl, dr = self.dl.copy(), self.dr.copy()
        alone = free & ~join & ~joined
        k = np.flatnonzero(alone & ~second)  # no partner on the right
        dr[k] = np.maximum(dr[k], self.hi[k] + 1)
        k = k[right[k]]
        k = k[second[k + 1]]  # it would fit but is finished
        dl[k], dr[k] = np.minimum(dl[k], self.dl[k + 1]), np.maximum(dr[k], self.dr[k + 1])
        k = np.flatnonzero(alone & second)  # no partner on the left
        dl[k] = np.minimum(dl[k], self.lo[k] - 1)
        k = k[left[k]]
        dl[k], dr[k] = np.minimum(dl[k], self.dl[k - 1]), np.maximum(dr[k], self.dr[k - 1])
        k = np.flatnonzero(join)
        name, hi = self.name.copy(), self.hi.copy()
        name[k] = common.mix(common.mix(self.name[k] + _U(level)) * _U(0x8EBC6AF09C88C6E3) + self.name[k + 1])
        hi[k] = self.hi[k + 1]
        dl[k], dr[k] = np.minimum(self.dl[k], self.dl[k + 1]), np.maximum(self.dr[k], self.dr[k + 1])
        self.name, self.hi, self.dl, self.dr = name, hi, dl, dr
        self._take(np.flatnonzero(~joined))


def recompress(words: np.ndarray, row: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    symbols = Symbols(words, row)
    if len(words):
        for level in range(1, rounds + 1):
            symbols.runs(level)
            symbols.pairs(level)
    return symbols


def window_starts(row: np.ndarray, width: int) -> np.ndarray:
    """The places where a window of `width` words of one document starts."""
    start = np.arange(max(0, len(row) - width + 1))
    return start[row[start] == row[start + width - 1]] if len(start) else start


class Windows:
    """128-bit digests of the windows of one document."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.joined = b" ".join(self.words)
        self.end = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1

    def whole(self) -> np.ndarray:
        return np.frombuffer(xxhash.xxh3_128_digest(self.joined), "<i8")

    def digests(self, start: np.ndarray, width: int) -> np.ndarray:
        """[window, half] of the windows from each word in `start`."""
        begin = np.where(start > 0, self.end[start - 1] + 1, 0).tolist()
        digest, joined = xxhash.xxh3_128_digest, memoryview(self.joined)
        found = [digest(joined[a:b]) for a, b in zip(begin, self.end[start + width - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def _unmarked(parse: Symbols, use: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that hold no usable symbol (long runs of one word). Their documents share symbol 0."""
    start = window_starts(row, width)
    edge = np.zeros(len(row) + 2, np.int64)
    first, last = np.maximum(parse.dr[use] - width, 0), np.minimum(parse.dl[use], len(row))
    ok = first <= last
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, last[ok] + 1, -1)
    return start[np.cumsum(edge)[start] == 0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def deduplicate(docs: DataFrame, window: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the words covered by a window that also starts in a document with a smaller id, and counts.

    All columns of `docs` come back, the text cut, followed by n_words, n_removed and kept_sha256 (for names that
    `docs` has already, its column stays). Windows are judged on the input. Null texts have no words and stay null.
    Rows without an id are left as they are and are no earlier copy of anything. Rows that repeat an id don't count
    as earlier copies of each other. Windows are compared by 128-bit digests of their words.
    """
    rows = common.pack(docs, id, text)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words, row, *_ = common.word_hashes(*common.flat(batch.column(1)), _TABLE)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parse = recompress(words, row)
            # symbols without a window that holds all that decided them rule nothing out
            use = parse.dr - parse.dl <= window
            bound = np.searchsorted(row, np.arange(len(ids) + 1))
            long = np.flatnonzero(np.diff(bound) >= window)
            use &= (np.diff(bound) >= window)[parse.row] if len(parse.row) else use
            bare = np.unique(row[_unmarked(parse, use, row, window)])
            texts = common.raw(batch.column(1))
            whole = np.array([Windows(texts[k]).whole() for k in long], np.int64).reshape(-1, 2)
            name = np.r_[parse.name[use].view(np.int64), np.zeros(len(bare), np.int64), whole[:, 0]]
            more = np.r_[np.zeros(len(name) - len(long), np.int64), whole[:, 1]]
            owner = ids.astype(np.int64)[np.r_[parse.row[use], bare, long]]
            kind = np.arange(len(name)) >= len(name) - len(long)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(more), pa.array(owner), pa.array(kind)], ["s", "x", "i", "whole"])

    known = rows.where("i IS NOT NULL").select("i", "t")
    seen = common.cut(known.mapInArrow(symbols, "s long, x long, i long, whole boolean"))
    # stored before they are joined: a join of two plain exchanges can split a very common symbol or window
    several = common.cut(seen.groupBy("whole", "s", "x").agg(F.min("i").alias("low"), F.max("i").alias("high")).where("low < high"))
    shared = seen.join(several, ["whole", "s", "x"])
    # per document: its shared symbols, and its own hash if an earlier document has the very same words
    facts = common.cut(shared.where("NOT whole OR i > low").groupBy("i").agg(F.collect_set(F.when(~F.col("whole"), F.col("s"))).alias("s"), F.collect_set(F.when(F.col("whole"), F.col("s"))).alias("copy")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words, row, *_ = common.word_hashes(*common.flat(batch.column(1)), _TABLE)
            n = batch.num_rows
            bound = np.searchsorted(row, np.arange(n + 1))
            parse = recompress(words, row)
            edge = np.zeros(len(words) + 2, np.int64)
            shared = np.concatenate([_pairs(batch.column(2), k) for k in range(n)]) if n else np.zeros(0, _U)
            lone = (parse.dr - parse.dl <= window) & ~np.isin(common.mix(parse.name ^ _row_salt(parse.row)), shared)
            first, last = np.maximum(parse.dr[lone] - window, 0), np.minimum(parse.dl[lone], len(words))
            ok = first <= last
            np.add.at(edge, first[ok], 1)
            np.add.at(edge, last[ok] + 1, -1)
            ruled_out = np.cumsum(edge)[: len(words)] > 0
            start = window_starts(row, window)
            start = start[~ruled_out[start]]
            first, last = np.searchsorted(start, bound[:-1]), np.searchsorted(start, bound[1:])
            texts, own, ids = common.raw(batch.column(1)), batch.column(3).to_pylist(), batch.column(0).to_pylist()
            value, owner = [np.zeros((0, 2), np.int64)], []
            for k in np.flatnonzero(last > first):
                document = Windows(texts[k])
                if int(document.whole()[0]) not in own[k]:  # a copy of an earlier document goes as a whole
                    value.append(document.digests(start[first[k] : last[k]] - bound[k], window))
                    owner.append(np.full(len(value[-1]), ids[k], np.int64))
            value = np.concatenate(value)
            yield pa.RecordBatch.from_arrays([pa.array(value[:, 0]), pa.array(value[:, 1]), pa.array(np.concatenate(owner) if owner else np.zeros(0, np.int64))], ["w", "x", "i"])

    left = common.cut(known.join(facts, "i").select("i", "t", "s", "copy").mapInArrow(windows, "w long, x long, i long"))
    first = common.cut(left.groupBy("w", "x").agg(F.min("i").alias("low"), F.max("i").alias("high")).where("low < high").select("w", "x", "low"))
    later = left.join(first, ["w", "x"]).where("i > low").groupBy("i").agg(F.collect_set("w").alias("gone"))
    copies = facts.where(F.size("copy") > 0).select("i", "copy")
    gone = common.cut(later.join(copies, "i", "full"))
    schema = common.extended(rows, "n_words long, n_removed long, kept_sha256 string")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield _apply(batch, window)

    done = rows.join(gone, "i", "left").select("i", "t", "r", "gone", "copy").mapInArrow(final, schema)
    return common.unpack(done, docs, id, text, ["n_words", "n_removed", "kept_sha256"])


def _row_salt(row: np.ndarray) -> np.ndarray:
    return common.mix(row.astype(_U) + _U(1))


def _pairs(column: pa.Array, k: int) -> np.ndarray:
    """The symbols listed in row k, tied to that row."""
    own = column[k].values
    if own is None or not len(own):
        return np.zeros(0, _U)
    values = own.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
    return common.mix(values ^ _row_salt(np.array([k])))


def _apply(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    n, texts = batch.num_rows, common.raw(batch.column(1))
    gone, copy = batch.column(3), batch.column(4).to_pylist()
    cut = batch.column(1).to_pylist()
    n_words, n_removed, kept = [], [], []
    for k, body in enumerate(texts):
        document = Windows(body)
        words = document.words
        n_words.append(len(words))
        taken = np.zeros(len(words), bool)
        listed = gone[k].values
        if len(words) >= window and copy[k] and int(document.whole()[0]) in copy[k]:
            taken[:] = True
        elif len(words) >= window and listed is not None and len(listed):
            value = document.digests(np.arange(len(words) - window + 1), window)[:, 0]
            hit = np.flatnonzero(np.isin(value, listed.to_numpy(zero_copy_only=False)))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            taken = np.cumsum(edge)[:-1] > 0
        count = int(taken.sum())
        n_removed.append(count)
        if count:
            data = np.frombuffer(body, np.uint8)
            start = common.word_hashes(data, np.array([0, len(data)]), _TABLE)[2]
            cut[k] = remove(body, start, np.r_[start[1:], len(body)], taken).decode()
            words = [w for w, t in zip(words, taken.tolist(), strict=True) if not t]
        kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
    out = [batch.column(0), pa.array(cut, pa.string()), batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept)]
    return pa.RecordBatch.from_arrays(out, ["i", "t", "r", "n_words", "n_removed", "kept_sha256"])
