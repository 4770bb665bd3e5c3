"""Quality rules by tokeniser fertility.

Public vocabularies, trained on other people's text, measure a document: how many characters a token stands for, what
share of its tokens are bytes that a vocabulary falls back to, and how many bits a token carries (the entropy of the
document's own tokens). Text like the rest of its language lies in narrow bands; shouting, symbol soup, lists and
repetition lie outside. The bands come from the measures of all documents of a language, by classes of size, and reject
what lies far out of them (Tukey's fences around the quartiles). Documents without a language go by their script.

A document is measured in one pass without an exchange. A word is encoded as it stands in running text, after one
space, once for each task that meets it; only the measures (a hundred bytes a document) are stored and aggregated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: UTF-8 bytes of text measured at a time; a longer text is measured alone.
SLICE = 4 << 20
#: Distinct words a task remembers before it starts anew.
TABLE = 400_000
#: Documents of different measures that a band needs.
LEAST = 100
#: Bands at most: those of the largest groups; a class or language without one goes by its language, or script, or is kept.
MOST = 20_000
#: Quartile distances beyond a quartile where a band ends.
FENCE = 3.5
#: Of each measure: which side rejects (-1 low, 1 high, 0 both), and the least distance of a band's ends from the median,
#: as a share of it and as a number.
RULES = {"chars_per_piece": (0, 0.06, 0.0), "chars_per_byte_token": (0, 0.06, 0.0), "byte_share": (1, 0.0, 0.05), "entropy": (-1, 0.1, 0.0)}
#: Base rules: least words, and the highest share of words in repeated windows of three, in percent.
WORDS, REPEATS = 50, 50
#: Symbols that are counted.
SYMBOLS = b"#*$%&|<>"
#: Scripts by the first code point of their blocks (public Unicode blocks); those in between belong to the one before.
SCRIPTS = [
    (0x0000, "Other"), (0x0041, "Latin"), (0x005B, "Other"), (0x0061, "Latin"), (0x007B, "Other"), (0x00C0, "Latin"), (0x0250, "Other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
]
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({b for _, b in SCRIPTS})
_NAME = np.array([_NAMES.index(b) for _, b in SCRIPTS])
_TABLE = common.byte_table(common.SPACES, lower=False)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_pieces long, chars_per_piece double, chars_per_byte_token double, byte_share double, entropy double"


class Vocabularies:
    """The pieces and byte tokens of distinct words, remembered over a task's batches."""

    def __init__(self, pieces: str, ranks: str, table: int = TABLE):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.table = table
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.bound, self.n_bytes = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A number for each distinct word, by which `ids`, `bound` and `n_bytes` know it."""
        if len(self.known) > self.table:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            texts = [w.decode() for w in new]
            found = self.model.encode(texts, num_threads=1)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32)])
            self.bound = np.concatenate([self.bound, self.bound[-1] + np.cumsum([len(x) for x in found])])
            self.n_bytes = np.concatenate([self.n_bytes, [len(self.bytes.encode_ordinary(f" {t}")) for t in texts]])
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))


def repeated(hashes: np.ndarray, row: np.ndarray, width: int = 3) -> np.ndarray:
    """Which words lie in a window of `width` words that their row has twice or more."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) < width:
        return out
    window = hashes[: len(hashes) - width + 1]
    for k in range(1, width):
        window = common.joined(window, hashes[k : len(hashes) - width + 1 + k])
    whole = np.flatnonzero(row[: len(window)] == row[width - 1 :])
    window = common.joined(common.mix(row[whole].astype(np.uint64)), window[whole])
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    start = whole[count[inverse] > 1]
    for k in range(width):
        out[start + k] = True
    return out


def repeated_lines(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each row its lines that hold a word (at a place in `word`) and equal an earlier line."""
    n = len(offsets) - 1
    # a line ends at a line feed or with its row
    feeds = np.flatnonzero(data == 10)
    begin = np.concatenate([offsets[:-1], feeds + 1])
    end = np.concatenate([offsets[1:], feeds])
    row = np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, "right") - 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    end = np.sort(end)  # rows' ends and feeds together, in order, are the lines' ends
    held = np.searchsorted(word, end) > np.searchsorted(word, begin)
    begin, end, row = begin[held], end[held], row[held]
    key = common.joined(common.mix(row.astype(np.uint64)), common.span_hashes(data, begin, end))
    first = np.unique(key, return_index=True)[1]
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The most frequent script among each row's characters, by number ("Other" only where no letter is known)."""
    n = len(offsets) - 1
    latin = np.concatenate([[0], np.cumsum(((data | 0x20) - 0x61) < 26, dtype=np.int64)])  # ASCII letters; bytes wrap around
    lead = np.flatnonzero(data >= 0xC0)
    one = data[lead].astype(np.int64)
    two, three = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2))
    point = np.where(one < 0xE0, (one & 0x1F) << 6 | two, np.where(one < 0xF0, (one & 0x0F) << 12 | two << 6 | three, 0xD7B0))
    script = _NAME[np.searchsorted(_FIRST, point, "right") - 1]
    count = np.bincount((np.searchsorted(offsets, lead, "right") - 1) * len(_NAMES) + script, minlength=n * len(_NAMES)).reshape(n, len(_NAMES))
    count[:, _NAMES.index("Latin")] += latin[offsets[1:]] - latin[offsets[:-1]]
    count[:, _NAMES.index("Other")] = 0
    return np.where(count.any(1), count.argmax(1), _NAMES.index("Other"))


def measure(docs: DataFrame, pieces: str, ranks: str, id: str = "doc_id", text: str = "text", language: str | None = None, table: int = TABLE) -> DataFrame:
    """(id, language, and MEASURES) of every row of `docs`.

    Texts are taken whole. Null and empty texts, and such of white space alone, have no words; their measures of tokens
    are null and their script is Other. language: a column's name, or None. Rows and ids may repeat; other columns
    aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabularies(pieces, ranks, table)
        for batch in common.slices(batches, limit=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *_measured(batch.column(1), words)], ["id", "language", *[m.split()[0] for m in MEASURES.split(", ")]])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"), (F.col(language).cast("string") if language else F.lit(None).cast("string")).alias("language"))
    return rows.mapInArrow(run, f"id long, language string, {MEASURES}").withColumnRenamed("id", id)


def _measured(column: pa.Array, words: Vocabularies) -> list[pa.Array]:
    n = len(column)
    data, offsets = common.flat(column)
    hashes, row, start, end = common.word_hashes(data, offsets, _TABLE)
    n_words = np.bincount(row, minlength=n)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.bincount(row, points[end] - points[start], n).astype(np.int64)
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    symbols = np.concatenate([[0], np.cumsum(symbol[data])])
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    whole = data.tobytes()
    number = words.numbers([whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])[inverse]
    size = (words.bound[number + 1] - words.bound[number]) if len(number) else number
    n_pieces, n_bytes = np.bincount(row, size, n), np.bincount(row, words.n_bytes[number] if len(number) else number, n)
    total = int(size.sum())
    ids = words.ids[np.repeat(words.bound[number] - np.cumsum(size) + size, size) + np.arange(total)].astype(np.int64) if total else np.zeros(0, np.int64)
    of = np.repeat(row, size)
    fallen = np.bincount(of, words.is_byte[ids] if total else ids, n)
    key, count = np.unique(of * len(words.is_byte) + ids, return_counts=True)
    of = key // len(words.is_byte)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(n_pieces) - np.bincount(of, count * np.log2(count), n) / n_pieces
        shares = [chars / n_pieces, chars / n_bytes, fallen / n_pieces, np.maximum(bits, 0)]
    none = n_words == 0
    out = [n_words, chars, symbols[offsets[1:]] - symbols[offsets[:-1]], repeated_lines(data, offsets, start), np.bincount(row[repeated(hashes, row)], minlength=n)]
    return [*[pa.array(x.astype(np.int64)) for x in out], pa.array([_NAMES[k] for k in scripts(data, offsets)]), pa.array(n_pieces.astype(np.int64)), *[pa.array(x, pa.float64(), mask=none) for x in shares]]


def _classed(measures: DataFrame) -> DataFrame:
    """With `group`, the language or else the script, and `class`, the binary magnitude of the number of pieces."""
    known = F.when(F.trim("language") != "", F.col("language"))
    return measures.withColumn("group", F.coalesce(F.concat(F.lit("language "), known), F.concat(F.lit("script "), F.col("script")))).withColumn("class", F.floor(F.log2(F.greatest("n_pieces", F.lit(1)))).cast("int"))


def bands(measures: DataFrame, fence: float = FENCE, least: int = LEAST) -> DataFrame:
    """(group, class, n, and for each measure its low and high end): what is kept of a group, by class of size and (class null) in all.

    A band of all sizes is twice as wide, as it judges the sizes that are too few for one, and short texts vary more.
    Quartiles are exact, of measures rounded to thousandths. Documents of equal measures - copies - count once, so a
    group of copies doesn't narrow a band. Documents that fail the base rules don't count. At most MOST bands, those of
    the most documents.
    """
    plain = _classed(measures).where(~base_failed()).select("group", "class", *[F.round(m, 3).alias(m) for m in RULES], "n_pieces").distinct()
    each = plain.select("group", F.explode(F.array(F.col("class"), F.lit(None).cast("int"))).alias("class"), *RULES)
    quartiles = each.groupBy("group", "class").agg(F.count("*").alias("n"), *[F.percentile(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(m) for m in RULES])
    wide = F.when(F.col("class").isNull(), 2.0).otherwise(1.0)
    ends = []
    for m, (side, share, number) in RULES.items():
        low, middle, high = (F.col(m)[k] for k in range(3))
        far, width = wide * fence * (high - low), wide * F.greatest(middle * share, F.lit(number))
        ends.append(F.when(F.lit(side <= 0), F.least(low - far, middle - width)).otherwise(F.lit(-1.0)).alias(f"{m}_low"))
        ends.append(F.when(F.lit(side >= 0), F.greatest(high + far, middle + width)).otherwise(F.lit(1e9)).alias(f"{m}_high"))
    return quartiles.where(F.col("n") >= least).select("group", "class", "n", *ends).orderBy(F.desc("n"), "group", "class").limit(MOST)


def base_failed() -> Column:
    return (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATS * F.col("n_words"))


def quality(docs: DataFrame, pieces: str, ranks: str, id: str = "doc_id", text: str = "text", language: str | None = None, fence: float = FENCE, least: int = LEAST) -> DataFrame:
    """(id, language, MEASURES, base_failed, reason, kept) of every row: the first rule that rejects it, if any.

    A document is judged by the band of its language (its script, without one) and size; by that of the language in all
    sizes if documents of its size are too few; and is kept by the bands if there is neither. Null and empty texts fail
    the base rules. See `measure` for the other cases.
    """
    found = common.cut(measure(docs, pieces, ranks, id, text, language))
    limits = common.cut(bands(found, fence, least))  # at most MOST rows
    ends = [f"{m}_{e}" for m in RULES for e in ("low", "high")]
    named = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ends]
    own = limits.where("class IS NOT NULL").select("group", "class", *named("own"))
    all_ = limits.where("class IS NULL").select("group", *named("all"))
    joined = _classed(found).join(F.broadcast(own), ["group", "class"], "left").join(F.broadcast(all_), "group", "left")
    reason = F.when(F.col("n_words") < WORDS, "n_words").when(base_failed(), "n_repeat_words")
    for m in RULES:
        low, high = (F.coalesce(f"own_{m}_{e}", f"all_{m}_{e}") for e in ("low", "high"))
        reason = reason.when((F.col(m) < low) | (F.col(m) > high), m)
    kept = joined.withColumn("base_failed", base_failed()).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    return kept.select(*found.columns, "base_failed", "reason", "kept")
