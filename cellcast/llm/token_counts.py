"""Token counts behind a digest cache.

A text's key is the digest of its normalised content together with the digest of the tokenizer's file. Counts are
looked up in a stored table of (tokenizer, digest, n_tokens); only texts whose key is missing are encoded, once for
each distinct key, and their counts are appended to the table. Which keys are missing is found on digests alone, so
texts are exchanged only where something is to be encoded. Counts go back to the rows by digest: those of very common
texts, of bounded number, by broadcast, all others by a join in which no key has many rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CACHE = "tokenizer string, digest string, n_tokens long"
#: A text is very common from this many rows, and from this share of all rows (one in HOT), so at most HOT texts are.
COMMON, HOT = 500, 10_000
#: Missing digests up to which they are broadcast to choose the texts to encode (32 bytes each).
FEW = 500_000
#: Distinct words whose counts a task remembers before it starts anew.
MEMORY = 150_000
#: Words encoded at a time: an encoding takes far more memory than its word.
WORDS = 4000
_TABLE = common.byte_table(common.SPACES, lower=False)


class WordCounter:
    """Token counts with a tokenizer that drops white space, so that no token spans two words: each distinct word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.known: dict[bytes, int] = {}

    def count(self, column: pa.Array) -> np.ndarray:
        data, offsets = common.flat(column)
        hashes, row, start, end = common.word_hashes(data, offsets, _TABLE)
        if not len(hashes):
            return np.zeros(len(column), np.int64)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        whole = data.tobytes()
        words = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), WORDS):
            part = new[at : at + WORDS]
            self.known.update(zip(part, map(len, self.model.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)), strict=True))
        each = np.fromiter((self.known[w] for w in words), np.int64, len(words))
        return np.bincount(row, each[inverse], len(column)).astype(np.int64)


class PieceCounter:
    def __init__(self, path: str):
        from .pieces import Pieces

        self.pieces = Pieces(path)

    def count(self, column: pa.Array) -> np.ndarray:
        return np.array([sum(len(c[2]) for c in p) for p in self.pieces.segment(common.raw(column))], np.int64)


class TextCounter:
    """Any other tokenizer: whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, column: pa.Array) -> np.ndarray:
        texts = [x.decode() for x in common.raw(column)]
        return np.array([len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)], np.int64)


#: Normalisers that treat the characters of a word alike whatever words stand beside it.
_PLAIN = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
#: Parts of patterns that may match white space, or look at what stands beside a match.
_LOOSE = re.compile(r"\\[sSWDPhHRNXvbBAzZGK]|\\p\{Z|\\p\{\^|\[\^|\(\?|[\s.^$]")


def _normal(spec: dict | None) -> bool:
    """Whether a normaliser treats words one by one; white space may become one space."""
    if spec is None or spec["type"] in _PLAIN:
        return True
    if spec["type"] == "Sequence":
        return all(map(_normal, spec["normalizers"]))
    return spec["type"] == "Replace" and spec["pattern"] == {"Regex": r"\s+"} and spec["content"] == " "


def words_apart(spec: dict) -> bool:
    """Whether a tokenizer (the JSON of its file) encodes words that white space parts independently of each other.

    So it does if its first splitter keeps nothing but the matches of a pattern that can't match white space nor look
    beyond a match, no normaliser works across words, and no added token holds or takes in white space. Whatever isn't
    known to be so counts as not so.
    """
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = parts[0] if parts else {}
    if first.get("type") != "Split" or first["behavior"] != "Removed" or not first["invert"] or "Regex" not in first["pattern"]:
        return False
    pattern = re.sub(r"\\[^A-Za-z0-9]", "", first["pattern"]["Regex"])  # escaped signs
    pattern = re.sub(r"\[\^[^\[\]]*\\s[^\[\]]*\]", "", pattern)  # classes that leave out white space
    tokens = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return not _LOOSE.search(pattern) and _normal(spec.get("normalizer")) and tokens


@functools.lru_cache(maxsize=2)
def counter(path: str):
    """The counter that fits a tokenizer's file; a worker that serves many tasks keeps one."""
    # threads of their own would each keep memory, and the tasks use all cores already
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        return PieceCounter(path)
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return WordCounter(path) if words_apart(spec) else TextCounter(path)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark, cache: str) -> DataFrame:
    """The stored table; empty if nothing has been stored yet."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, counting whole texts.

    cache: the path of the stored table, kept between runs; by default one for this call only, in the shared scratch
    folder. Normalised content: null becomes the empty text; for tokenizers the counts depend on every other character.
    Repeated texts are encoded once; repeated or null ids are rows like any other; other columns aren't read.
    """
    spark = docs.sparkSession
    cache = cache or common.scratch(spark)
    version = tokenizer_digest(tokenizer)
    plain = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest")
    rows = common.cut(docs.select(F.col(id).cast("long").alias("id"), digest, F.octet_length(plain).cast("long").alias("n_bytes")))
    distinct = common.cut(rows.groupBy("digest").agg(F.count("*").alias("n")))
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    missing = common.cut(distinct.select("digest").join(stored.select(F.unhex("digest").alias("digest")), "digest", "left_anti"))
    n_missing = missing.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(tokenizer)
        for batch in common.slices(batches):
            n = len(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([version] * n, pa.string()), batch.column(0), pa.array(model.count(batch.column(1)))], ["tokenizer", "digest", "n_tokens"])

    if n_missing:
        texts = docs.select(digest, plain.alias("t"))
        if n_missing < distinct.count():  # a filter by digest; where nearly all are missing, texts are exchanged anyway
            texts = texts.join(F.broadcast(missing) if n_missing <= FEW else missing, "digest", "left_semi")
        new = texts.groupBy("digest").agg(F.first("t").alias("t"))
        new.select(F.lower(F.hex("digest")), "t").mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy(F.unhex("digest").alias("digest")).agg(F.first("n_tokens").alias("n_tokens"))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    common_texts = distinct.where(F.col("n") > max(COMMON, total // HOT)).select("digest")  # at most HOT rows
    hot = F.broadcast(common.cut(known.join(F.broadcast(common_texts), "digest", "left_semi")))
    found = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(known, "digest").select("digest", "id", "n_bytes", "n_tokens"))
    return found.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
