"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint of 64 bits is a majority vote over the XXH64 hashes of a text's word shingles. Two fingerprints that
differ in at most three bits agree on at least b - 3 of any b blocks of bits, so each choice of b - 3 blocks is one
hash table, and only fingerprints of one bucket are compared. A bucket is compared bit-sliced: 64 fingerprints stand
in the lanes of 64 vertical bit planes; a query is XORed with each plane, the differences run through carry-save
counters of two bits and a sticky overflow, and a block of lanes is abandoned once every lane has overflowed.

Copies of one fingerprint are one node, so no group of copies is ever compared with itself; a bucket with many
fingerprints is split into chunks that are compared chunk against chunk, and each comparison emits a spanning forest
of its links, never all pairs.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Most fingerprints of a bucket that are compared in one piece.
CHUNK = 4096
#: Bytes of a text that are split at a time, and hashes that are held.
PIECE = 1 << 20
_U = np.uint64
_SPACE = re.compile(rb"[ \t-\r]")


def _counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[text, bit]: how many of a text's shingle hashes have the bit; texts without hashes have none."""
    out = np.zeros((len(sizes), 64), np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    size = sizes[full]
    # byte counters hold at most 255 hashes, so texts are summed in pieces of 255
    pieces = -(-size // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    begin = np.repeat(np.cumsum(size) - size, pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin + 255 * within
    bound = np.searchsorted(owner, np.arange(len(full)))
    for k in range(8):
        lanes = (hashes >> _U(k)) & _U(0x0101010101010101)
        counts = np.add.reduceat(lanes, start).view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[full, k::8] = np.add.reduceat(counts, bound, axis=0)
    return out


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, PIECE bytes and the word they end in at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint_batch(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints: a bit is set if over half of a text's shingle hashes have it. A long text is voted on piece by piece."""
    digest = xxhash.xxh64_intdigest
    votes, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)

    def count() -> None:
        votes[:] += _counts(np.array(hashes, _U), sizes)
        total[:] += sizes
        hashes.clear()
        sizes[:] = 0

    for k, text in enumerate(texts):
        tail: list[bytes] = []
        for words in _pieces(text):
            words = tail + words
            before = len(hashes)
            hashes += [digest(x, seed) for x in map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))]
            sizes[k] += len(hashes) - before
            tail = words[-(width - 1) :] if width > 1 else []
            if len(hashes) > PIECE:
                count()
        if tail and not total[k] and not sizes[k]:  # fewer words than a shingle has
            hashes.append(digest(b" ".join(tail), seed))
            sizes[k] = 1
    count()
    return np.packbits(2 * votes > total[:, None], axis=1, bitorder="little").view(_U)[:, 0] if len(texts) else np.zeros(0, _U)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) of every row. Null and empty texts have fingerprint zero; rows and ids may repeat or be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            fp = fingerprint_batch(common.raw(batch.column(1)), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints, 64 lanes a block: [block, bit] holds that bit of the block's 64 values (padded by 0)."""
    blocks = -(-len(values) // 64)
    padded = np.zeros(blocks * 64, _U)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")  # block, lane, bit
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(blocks, 64, 8).copy().view(_U)[:, :, 0]


def near(stored: np.ndarray, block: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For tasks (block of planes, query fingerprint, lanes that count): the lanes within `radius`, and the kept tasks."""
    assert radius == 3, "the counters are two bits wide"
    kept = np.arange(len(block))
    one, two, over = (np.zeros(len(block), _U) for _ in range(3))
    over |= ~lanes
    for bit in range(64):
        diff = stored[block, bit] ^ (_U(0) - ((query >> _U(bit)) & _U(1)))
        carry = one & diff
        one ^= diff
        again = two & carry
        two ^= carry
        over |= again
        if bit % 8 == 7:
            live = over != _U(0xFFFFFFFFFFFFFFFF)
            if not live.all():
                kept, block, query, one, two, over = (x[live] for x in (kept, block, query, one, two, over))
                if not len(kept):
                    break
    return ~over, kept


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Roots of the nodes 0..n-1 under links (a, b), by repeated minimum and pointer jumps."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links_of_sorted(group: np.ndarray, side: np.ndarray, fp: np.ndarray, tasks: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of consecutive rows; side 0: all pairs of the group, sides 1 and 2: pairs across.

    The links of a group are reduced to a spanning forest before they leave.
    """
    n = len(fp)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    end = np.r_[start[1:], n]
    which = np.cumsum(np.r_[False, group[1:] != group[:-1]]) if n else start
    last = end[which]
    # row i is compared with the rows after it (across: only of side 2) in its group
    first = np.arange(n) + 1
    ask = (side != 2) & (first < last)
    rows = np.flatnonzero(ask)
    low, high = first[rows] // 64, (last[rows] - 1) // 64
    stored, count = planes(fp), high - low + 1
    second = np.zeros(-(-n // 64) * 64, np.uint8)
    second[:n] = side == 2
    second = np.packbits(second, bitorder="little").view(_U)
    root = np.arange(n)
    for at in np.split(np.arange(len(rows)), np.searchsorted(np.cumsum(count), np.arange(tasks, count.sum(), tasks))) if len(rows) else []:
        if not len(at):
            continue
        c = count[at]
        task = np.repeat(at, c)
        block = low[task] + np.arange(len(task)) - np.repeat(np.cumsum(c) - c, c)
        i = rows[task]
        ones = _U(0xFFFFFFFFFFFFFFFF)
        lo = np.clip(first[i] - 64 * block, 0, 63).astype(_U)
        hi = np.clip(last[i] - 64 * block, 1, 64)
        lanes = (ones << lo) & (ones >> (64 - hi).astype(_U))
        lanes &= np.where(side[i] == 1, second[block], ones)
        found, kept = near(stored, block, fp[i], lanes)
        if len(kept):
            bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            hit, lane = np.nonzero(bits)
            a, b = i[kept[hit]], 64 * block[kept[hit]] + lane
            root = _forest(root[a], root[b], n)[root]
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def links(nodes: DataFrame, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `nodes` (fp) within three bits, without the pairs they imply.

    blocks: the bits are cut into so many blocks; by default the fewest that leave a few hundred to a bucket. A bucket
    of n fingerprints is dealt out as n / chunk chunks, each compared with each, so a fingerprint is copied n / chunk
    times: 64 bits spread over a few hundred to a bucket keep that at one but for buckets made to be crowded.
    """
    if blocks is None:
        total = nodes.count()
        blocks = next((b for b in (4, 5, 6) if total >> (64 * (b - 3) // b) < 256), 7)
    edge = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in c) for c in itertools.combinations(range(blocks), blocks - 3)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)]))
    rows = nodes.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = rows.join(sizes, ["t", "key"]).withColumn("parts", parts).withColumn("c", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d")
    rows = rows.select("t", "key", "fp", "c", other).select("t", "key", "fp", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2).alias("side"))
    keys = ["t", "key", "lo", "hi"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(part: list[np.ndarray]) -> pa.RecordBatch:
            t, key, lo, hi, side, fp = part
            new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            # chunks that stand for a bucket's diagonal hold side 0 only; across, side 1 comes first
            a, b = links_of_sorted(np.cumsum(new), side, fp.view(_U))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "side", "fp")]
            part = [np.concatenate(x) for x in zip(held, part, strict=True)] if held else part
            if not len(part[0]):
                continue
            same = np.logical_and.reduce([x == x[-1] for x in part[:4]])
            at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on
            held = [x[at:] for x in part]
            if at:
                yield emit([x[:at] for x in part])
        if held and len(held[0]):
            yield emit(held)

    return dealt.select(*keys, "side", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long, component_id): component_id is the smallest id reachable over fingerprints within three bits.

    Every row comes back once, repeated rows too. Null and empty texts share fingerprint zero. Null ids get a
    fingerprint and their component's smallest id that isn't null (null if there is none). No other column is read,
    so names can't clash; an empty table gives an empty result.
    """
    rows = common.cut(fingerprints(docs, id, text, width))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    found = common.components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select(F.col("id").alias(id), "fp", "component_id")


def hexed(fp: str = "fp") -> F.Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
