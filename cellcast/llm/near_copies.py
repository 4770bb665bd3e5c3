"""Near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more, by SimHash and exact sets.

At that similarity fingerprints of 64 bits differ in ten bits on average, so tables of equal bit blocks, as for three
bits, find few of them. Here bands of MinHash values make the buckets, fingerprints of the same shingles screen a
bucket's members bit-sliced with wider counters, and the similarity of the whole sets decides.

Texts with one set of shingles are one node. A bucket's members are first compared with one pivot of the bucket, those
of large buckets with another one each round, and linked parts are found after each: a group of near copies costs a
comparison a member. Only members
that are still in different parts are then compared with each other, chunk against chunk, and what leaves a task is a
spanning forest of its links. So no cap is put on a bucket and no pair within a group is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Words of a shingle, and the least similarity of near copies.
WIDTH, SIMILARITY = 5, 0.8
#: Bands of so many MinHash values each: sets of similarity 0.8 miss each other in all bands with odds of 2 in 10,000.
BANDS, VALUES = 16, 4
#: Bits in which fingerprints of near copies may differ: ten on average, five standard deviations more at 24.
RADIUS = 24
#: Rounds of pivots before the rest of a bucket is compared chunk by chunk, and members of a chunk.
ROUNDS, CHUNK = 3, 256
_U = np.uint64
_FACTOR = common.mix(np.arange(1, BANDS * VALUES + 1, dtype=np.uint64)) | _U(1)
_LOWER = common.byte_table(common.SPACES, lower=True)


def sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as rising 32-bit values, text after text, and how many each has.

    A-Z count as a-z. A text with fewer words than a shingle has one of all its words; one without words has none.
    """
    words, row, _, _ = common.word_hashes(data, offsets, _LOWER)
    count = np.bincount(row, minlength=len(offsets) - 1)
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    at = np.flatnonzero((place + width <= count[row]) | (place == 0))
    size, value = np.minimum(count[row[at]], width), words[at]
    for k in range(1, width):
        on = np.flatnonzero(size > k)
        value[on] = common.joined(value[on], words[at[on] + k])
    both = np.unique((row[at].astype(_U) << _U(32)) | (value >> _U(32)))
    return both.astype(np.uint32), np.bincount((both >> _U(32)).astype(np.int64), minlength=len(count))


def sketch(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of sets, and [text, band] keys of their MinHash bands (zero where a set is empty)."""
    hashes = common.mix(values.astype(_U) + common._SALT)
    votes = simhash._counts(hashes, sizes)
    fp = np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view(_U)[:, 0] if len(sizes) else np.zeros(0, _U)
    bands = np.zeros((len(sizes), BANDS), _U)
    full = np.flatnonzero(sizes)
    if len(full):
        start = (np.cumsum(sizes) - sizes)[full]
        for band in range(BANDS):
            key = np.full(len(full), band, _U)
            for factor in _FACTOR[VALUES * band : VALUES * (band + 1)]:
                key = common.joined(key, np.minimum.reduceat(hashes * factor, start))
            bands[full, band] = key
    return fp, bands


def sketches(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, sig, n, fp, bands, vals) of every row: sig is a digest of the text's set of n shingles, vals the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2):
            values, sizes = sets(*common.flat(batch.column(2)))
            fp, bands = sketch(values, sizes)
            end = np.cumsum(sizes)
            held = [values[e - s : e].tobytes() for s, e in zip(sizes.tolist(), end.tolist(), strict=True)]
            keys = pa.ListArray.from_arrays(np.arange(0, BANDS * len(sizes) + 1, BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(v) for v in held], pa.binary()), pa.array(sizes), pa.array(fp.view(np.int64)), keys, pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "sig", "n", "fp", "bands", "vals"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "row long, id long, sig binary, n long, fp long, bands array<long>, vals binary")


def within(stored: np.ndarray, block: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """For tasks (block of bit planes, query fingerprint): a word whose bits are the block's lanes within `radius`.

    Carry-save counters start so far below their end that they overflow at radius + 1 differences; a block is abandoned
    once all its lanes have.
    """
    wide = int(radius).bit_length()
    before = (1 << wide) - 1 - radius
    out, kept = np.zeros(len(block), _U), np.arange(len(block))
    full = _U(0xFFFFFFFFFFFFFFFF)
    counter = [np.full(len(block), full if before >> k & 1 else 0, _U) for k in range(wide)]
    over = np.zeros(len(block), _U)
    for bit in range(64):
        carry = stored[block, bit] ^ (_U(0) - ((query >> _U(bit)) & _U(1)))
        for k in range(wide):
            carry, counter[k] = counter[k] & carry, counter[k] ^ carry
        over |= carry
        if bit >= radius and bit % 8 == 7:
            live = over != full
            if not live.all():
                kept, block, query, over, counter = kept[live], block[live], query[live], over[live], [c[live] for c in counter]
    out[kept] = ~over
    return out


def alike(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    """Whether two sets (rising 32-bit values) have at least that Jaccard similarity; two empty ones have."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    least = round(1000 * similarity)
    if 1000 * min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common_ = int(np.count_nonzero(both[1:] == both[:-1]))
    return 1000 * common_ >= least * (len(both) - common_)


def _sizes_fit(a: str, b: str, similarity: float) -> F.Column:
    return F.least(a, b) * 1000 >= F.greatest(a, b) * round(1000 * similarity)


def _verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, salt) whose sets are alike; a pivot b of many pairs is dealt out by salt."""
    held = nodes.select("node", "vals")
    pivots = pairs.select("b", "salt").distinct().join(held.withColumnsRenamed({"node": "b", "vals": "vb"}), "b")
    both = pairs.join(held.withColumnsRenamed({"node": "a", "vals": "va"}), "a").join(pivots, ["b", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([alike(x.as_buffer(), y.as_buffer(), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _rest(members: DataFrame, nodes: DataFrame, similarity: float, radius: int, chunk: int) -> DataFrame:
    """Links between members of one bucket that are in different parts: all of them, reduced to spanning forests.

    The largest part of a bucket is compared with the others only, the others with all.
    """
    parts = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    buckets = parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    pieces = lambda c: F.ceil(c / chunk).cast("int")
    minor = F.col("root") != F.col("top.root")
    spread = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    rows = members.join(buckets, "key").withColumns({"pm": pieces(F.col("total") - F.col("top.c")), "pt": pieces(F.col("top.c")), "minor": minor})
    rows = rows.withColumn("c", F.when(F.col("minor"), spread("pm")).otherwise(F.col("pm") + spread("pt")))
    rows = rows.select("key", "node", "root", "fp", "c", "minor", "pm", "pt").join(nodes.select("node", "vals"), "node")
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.when(F.col("minor"), F.col("pm") + F.col("pt") - 1).otherwise(F.col("pm") - 1))))
    side = F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2)
    rows = rows.select("key", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), side.alias("side"), "node", "root", "fp", "vals")

    def links(table: pa.Table) -> pa.Table:
        node, root, fp, which = (table.column(c).to_numpy() for c in ("node", "root", "fp", "side"))
        vals, fp = table.column("vals").to_pylist(), fp.view(_U)
        stored = simhash.planes(fp)
        asked = np.flatnonzero(which != 2)
        task, block = np.repeat(asked, len(stored)), np.tile(np.arange(len(stored)), len(asked))
        bits = np.unpackbits(within(stored, block, fp[task], radius).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, lane = np.nonzero(bits)
        a, b = task[hit], 64 * block[hit] + lane
        ok = b < len(fp)
        a, b = a[ok], b[ok]
        ok = (root[a] != root[b]) & np.where(which[a] == 1, which[b] == 2, a < b)
        up = {r: r for r in root.tolist()}

        def find(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        found: list[tuple[int, int]] = []
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y and alike(vals[i], vals[j], similarity):
                up[x] = y
                found.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("key", "lo", "hi").applyInArrow(links, "a long, b long")


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """(id, sig, component_id): component_id is the smallest id reachable over texts of that similarity.

    Every row comes back once, repeated rows too; sig is the digest of its text's set of shingles. Null texts and texts
    without words are copies of each other. Null ids have the smallest id of their component that isn't null, or null.
    No other column is read, so names can't clash; an empty table gives an empty result. A text is held whole by one
    task. Shingles are told apart by 32 bits.
    """
    rows = common.cut(sketches(docs, id, text))
    own = F.min(F.struct(F.col("row").alias("node"), "n", "fp", "bands")).alias("own")
    first = common.cut(rows.groupBy("sig").agg(own).select("sig", "own.*"))
    posted = first.where("n > 0").select("node", "n", "fp", F.explode("bands").alias("key"))  # a key tells its band
    crowded = common.cut(posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = common.cut(common.sifted(posted, "key", crowded.select("key"))[0].join(crowded, "key"))
    asked = common.cut(members.select("node").distinct())
    nodes = common.sifted(rows.select(F.col("row").alias("node"), "vals"), "node", asked)[0]
    nodes = common.cut(nodes.join(asked, "node", "left_semi"))
    links: DataFrame | None = None
    roots: DataFrame | None = None

    def rooted() -> DataFrame:
        return members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    for turn in range(rounds):
        place = F.struct(F.xxhash64(F.lit(turn), F.col("node")).alias("at"), "node", "root", "n", "fp")
        asked = rooted() if turn == 0 else rooted().where(F.col("size") > chunk)  # smaller buckets are one task's work below
        pivot = asked.groupBy("key").agg(F.min(place).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "p")
        pairs = asked.join(pivot, "key").where(F.col("root") != F.col("p.root")).where(_sizes_fit("n", "p.n", similarity))
        pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))) <= radius)
        salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / 1024)).alias("salt")
        pairs = common.cut(pairs.select(F.col("node").alias("a"), F.col("p.node").alias("b"), salt).groupBy("a", "b").agg(F.min("salt").alias("salt")))
        members = members.where("size > 2")  # of two members, one is the pivot
        if pairs.isEmpty():
            break
        new = common.cut(_verified(pairs, nodes, similarity))
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        roots = common.cut(common.components(links).select("node", "root"))
    new = common.cut(_rest(rooted(), nodes, similarity, radius, chunk))
    if links is None or not new.isEmpty():
        links = new if links is None else links.unionByName(new)
        roots = common.components(links).select("node", "root")
    named = first.select("sig", "node").join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"))
    mine = common.cut(rows.select("id", "sig").groupBy("sig").agg(F.min("id").alias("id")).join(named, "sig"))
    least = mine.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.select("id", "sig").join(mine.join(least, "root").select("sig", "component_id"), "sig").select(F.col("id").alias(id), "sig", "component_id")
