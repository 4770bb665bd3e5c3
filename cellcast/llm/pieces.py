"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the model crosses from a character into a whitespace marker, so a text falls into chunks - one or more
markers and the characters up to the next - whose segmentations don't depend on each other. Each distinct chunk of a
slice of texts is segmented once, and ids are joined back by position. The table lives in the task (bounded, with
memory of earlier slices): it needs no shuffle, and nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct chunks that a task remembers before it starts anew.
TABLE = 200_000
_CHUNK = re.compile(rb" +[^ ]*")
_MARK = "▁".encode()


class Pieces:
    """A SentencePiece model behind a table of distinct chunks."""

    def __init__(self, path: str, table: int = TABLE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for i in range(self.model.vocab_size()) if "▁" in (p := self.model.id_to_piece(i)).lstrip("▁")]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers: {crossing[:5]}")
        # chunks may be cut from the raw text only if the model puts a marker first, keeps every space and changes nothing else
        odd = "a  b\u00a0\u3000\tc\n ﬁ①Ａe\u0301 "
        if (got := self.model.normalize(odd)) != "▁" + odd.replace(" ", "▁"):
            raise ValueError(f"the model's normalisation changes texts: {got!r}")
        self.mark, self.limit = [self.model.piece_to_id("▁")], table
        self.known: dict[bytes, tuple[bytes, bytes, list[int]]] = {}

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        new = list(chunks - self.known.keys())
        texts = [x[1:].decode() for x in new]
        ids = [x if t else self.mark for x, t in zip(self.model.encode(texts, num_threads=1), texts, strict=True)] if new else []
        back = self.model.decode(ids, num_threads=1) if new else []
        for chunk, own, text in zip(new, ids, back, strict=True):
            self.known[chunk] = (",".join(map(str, own)).encode(), text.encode(), own)

    def segment(self, texts: list[bytes]) -> list[list[tuple[bytes, bytes, list[int]]]]:
        """For each text its chunks' (joined ids, decoded text after the first marker, ids)."""
        parts = [_CHUNK.findall(b" " + x.replace(_MARK, b" ")) if x else [] for x in texts]
        self.learn({c for p in parts for c in p})
        known = self.known
        return [[known[c] for c in p] for p in parts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for c in p for i in c[2]] for p in self.segment([x.encode() for x in texts])]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1) if ids else []


def encode(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every row: the ids of the whole text, and what they decode to.

    Null texts count as empty (no ids, empty decoded text). Rows and ids may repeat; other columns aren't read.
    keep_ids: also return the ids and the decoded text themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in common.slices(batches):
            found = pieces.segment(common.raw(batch.column(1)))
            count, joined, back = [], [], []
            for parts in found:
                own = b",".join([c[0] for c in parts])
                count.append(own.count(b",") + 1 if own else 0)
                joined.append(hashlib.sha256(own).hexdigest())
                # decoding drops the first marker; a chunk's own text stands after one
                back.append(b" ".join([c[1] for c in parts]))
            out = [batch.column(0).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(joined), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
            if keep_ids:
                out += [pa.array([[i for c in p for i in c[2]] for p in found], pa.list_(pa.int32())), pa.array([x.decode() for x in back], pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id)
