"""What several operators share: scratch tables, slices of text, word hashes and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: UTF-8 bytes of text that one Python step handles at a time; a longer text is a slice of its own.
SLICE = 1 << 20

#: Most bits of a bitmap that goes to all tasks (16 MB).
BITS = 1 << 27

#: Start values and odd multipliers of hashes (fixed values).
_SALT, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes up to which a span is hashed in lanes of eight; longer ones go through XXH64 one by one.
LANES = 64
_TAIL = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the shared folder in spark.checkpoint.dir.

    Where that setting is empty, a temporary folder is used on a local master (tests), and anything else is an error:
    executors don't share the driver's disk. The folder is removed when the driver's JVM ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cellcast-")
        context.setCheckpointDir(root)
    top = f"{root.rstrip('/')}/{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{top}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared scratch folder and read again: its lineage ends, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now; it waits for a collection of the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sifted(rows: DataFrame, column: str, among: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` in two parts: those whose `column` may be one of the values `among` (a stored table's column), and the rest.

    Tasks get a bitmap of the values' hashes, 16 bits to a value and BITS at most. So a join with a small part of a wide
    table needs to exchange this part and one row in 16 of the others, whose values only look alike. Values are whole
    numbers; null is a value like any other.
    """
    bits = min(BITS, 1 << max(15, (16 * among.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    values = among.select(place(among.columns[0]).alias("place"))
    maps = values.groupBy(F.bitmap_bucket_number("place").alias("sift_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("sift_map"))
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring("sift_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    both = rows.withColumn("sift_k", F.bitmap_bucket_number(place(column))).join(F.broadcast(maps), "sift_k", "left")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return both.where(hit).select(*own), both.where(~hit).select(*own)


def pack(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(i long, t string, r struct): the id, the text, and every other column as it is."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id, text)]
    return docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t"), F.struct(*(rest or [F.lit(0).alias("_")])).alias("r"))


def extended(rows: DataFrame, more: str) -> StructType:
    """The schema of `rows` and more columns; names may hold anything."""
    return StructType([*rows.schema.fields, *StructType.fromDDL(more).fields])


def unpack(rows: DataFrame, docs: DataFrame, id: str, text: str, more: list[str]) -> DataFrame:
    """The columns of `docs` in their order, with the id and the new text from (i, t, r), then the columns `more`."""
    own = {id: F.col("i").cast(docs.schema[id].dataType).alias(id), text: F.col("t").alias(text)}
    return rows.select(*[own[c] if c in own else F.col(f"r.`{c}`").alias(c) for c in docs.columns], *[m for m in more if m not in docs.columns])


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of each take at most `limit` bytes, or it has one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def raw(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and the offsets of its rows (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a pair of hashes, which depends on their order; for each `a` it is a bijection of `b`."""
    return mix((mix(a + _SALT) ^ b) * _ODD)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans data[start:end], the same wherever a span stands.

    Eight bytes at a time go through a non-linear mixer, so no algebraic pattern makes two spans meet; spans of equal
    length of up to eight bytes never do.
    """
    size = end - start
    value = mix(size.astype(np.uint64) ^ _SALT)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    on = np.flatnonzero((size > 0) & (size <= LANES))
    for lane in range(0, LANES, 8):
        on = on[size[on] > lane] if lane else on
        if not len(on):
            break
        part = eight[start[on] + lane] & _TAIL[np.minimum(size[on] - lane, 8)]
        value[on] = mix((value[on] ^ part) * _ODD)
    for k in np.flatnonzero(size > LANES):
        value[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes(), 42)
    return value


def byte_table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """For word_hashes: each byte after folding, and whether it belongs to a word."""
    fold, word = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    if lower:
        fold[65:91] += 32
    word[list(separators)] = False
    return fold, word


#: Words end at these bytes.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, their rows, and their byte bounds in `data`. A word never spans two rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    folded, inside = table[0][data], table[1][data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[first[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return span_hashes(folded, start, end), row, start, end


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the smallest node reachable.

    Each round points every node at the neighbour that comes first in an order by hashes, another one each round, and
    contracts the graph along these pointers. About half of the nodes are left after a round, also on chains whose ids
    rise from link to link. Rounds are cut in the shared scratch folder. A hub costs no more than a partially aggregated
    minimum and a join that adaptive execution may split.
    """
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    rest = cut(edges.where("a <> b").select(*ordered("a", "b")).distinct())
    found: DataFrame | None = None
    turn = 0
    while not rest.isEmpty():
        turn += 1
        place = lambda c, seed=turn: F.struct(F.xxhash64(F.lit(seed), c).alias("at"), F.col(c).alias("node"))
        near = rest.unionByName(rest.selectExpr("b AS a", "a AS b")).groupBy("a").agg(F.min(place("b")).alias("first"))
        step = cut(near.select(F.col("a").alias("node"), F.least(place("a"), F.col("first"))["node"].alias("root")))
        left, right = step.selectExpr("node AS a", "root AS ra"), step.selectExpr("node AS b", "root AS rb")
        rest = cut(rest.join(left, "a").join(right, "b").where("ra <> rb").select(*ordered("ra", "rb")).distinct())
        if found is None:
            found = step
        else:
            later = step.selectExpr("node AS root", "root AS next")
            found = found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    if found is None:
        return rest.selectExpr("a AS node", "b AS root")
    smallest = found.groupBy("root").agg(F.min("node").alias("smallest"))
    return found.join(smallest, "root").select("node", F.col("smallest").alias("root"))


def crc(column: str = "doc_id") -> F.Column:
    """CRC-32 of a column's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
