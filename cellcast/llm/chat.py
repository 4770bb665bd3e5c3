"""Chat formatting by token-level assembly.

A turn is [start] role [sep] text [end]. Role and text are escaped and encoded apart, and the reserved ids, which lie
above the tokenizer's vocabulary, are spliced between them, so no content can produce a control id. Where a segment
begins follows from prefix sums of segment lengths; the loss mask is the prefix sum of +1 where an assistant's text
begins and -1 where it ends.

Escaping: the control strings all begin with `<|`, so a backslash goes between `<` and `|` wherever they stand
together or with backslashes between them; taking one away reverses it.

Turns are encoded where they are read, and a conversation is read back as a stream of its sorted turns, so neither
step holds more than a batch of turns, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Control strings; their ids follow the vocabulary in this order.
START, SEP, END = CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class Template:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # strings of special tokens inside a text are ordinary text
        self.reserved = self.model.get_vocab_size(with_added_tokens=True)

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, loss mask, bounds of turns) of all turns, one after the other."""
        segments = [escape(s) for pair in zip(roles, texts, strict=True) for s in pair]
        coded = [e.ids for e in self.model.encode_batch(segments, add_special_tokens=False)]
        n = len(roles)
        size = np.ones((n, 5), np.int64)
        size[:, 1], size[:, 3] = [len(x) for x in coded[::2]], [len(x) for x in coded[1::2]]
        end = np.cumsum(size.ravel()).reshape(n, 5) if n else size
        begin = end - size
        ids = np.zeros(int(end[-1, -1]) if n else 0, np.int64)
        ids[begin[:, 0]], ids[begin[:, 2]], ids[begin[:, 4]] = self.reserved, self.reserved + 1, self.reserved + 2
        content = np.ones(len(ids), bool)
        content[begin[:, ::2].ravel()] = False
        ids[content] = [i for x in coded for i in x]
        edge = np.zeros(len(ids) + 1, np.int64)
        says = np.array([r == "assistant" for r in roles], bool)
        np.add.at(edge, begin[says, 3], 1)
        np.add.at(edge, end[says, 3], -1)
        return ids, np.cumsum(edge)[:-1], np.r_[0, end[:, 4]]

    def read(self, turns: list[np.ndarray], masks: list[np.ndarray]) -> list[tuple[str, str, str, int]]:
        """(role, text, text under the loss mask, characters of the formatted turn) of each turn's ids."""
        parts: list[list[int]] = []
        for ids, mask in zip(turns, masks, strict=True):
            sep = int(np.flatnonzero(ids == self.reserved + 1)[0])
            if ids[0] != self.reserved or ids[-1] != self.reserved + 2:
                raise ValueError("not a turn")
            parts += [ids[1:sep].tolist(), ids[sep + 1 : -1].tolist(), ids[mask > 0].tolist()]
        text = self.model.decode_batch(parts, skip_special_tokens=False)
        frame = sum(map(len, CONTROLS))
        return [(unescape(a), unescape(b), unescape(c), len(a) + len(b) + frame) for a, b, c in zip(text[::3], text[1::3], text[2::3], strict=True)]


def format_turns(turns: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, ids, mask) of every turn; a conversation's output is its turns' ids in the order (turn, role, text).

    Null roles and texts count as empty. Repeated turn numbers and repeated rows are turns of their own, in the order
    of their roles and texts by bytes, whatever the tokenizer; turns without a number come first. Role and text only
    keep that order: what is read back comes from the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(tokenizer)
        for batch in common.slices(batches, text=3):
            roles, texts = ([x.decode() for x in common.raw(batch.column(k))] for k in (2, 3))
            ids, mask, bound = template.assemble(roles, texts)
            lists = [pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(x, t)) for x, t in ((ids, pa.int32()), (mask, pa.int8()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], ["conv", "turn", "role", "text", "ids", "mask"])

    plain = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    return plain.mapInArrow(run, "conv long, turn long, role string, text string, ids array<int>, mask array<tinyint>")


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Of each conversation, decoded from its ids: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns without a conversation id form one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(tokenizer)
        state: list | None = None

        def row(s: list) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        for batch in batches:
            done = []
            lists = []
            for k in (1, 2):
                column = batch.column(k)
                at = column.offsets.to_numpy()
                lists.append(np.split(column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at[1:-1] - at[0]) if len(column) else [])
            for conv, (role, text, loss, chars) in zip(batch.column(0).to_pylist(), template.read(*lists), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
            yield _rows(done)
        if state is not None:
            yield _rows([row(state)])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = formatted.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "ids", "mask")
    return ordered.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
