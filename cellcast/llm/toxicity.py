"""Toxic spans by a linear-chain conditional random field.

Labels belong to documents, so tokens are labelled first: a token of a toxic document is toxic if far more toxic than
clean documents hold its word, or a word that begins like it. A two-state chain with weights for each hashed word, its
beginnings and its neighbours is trained on such token sequences; forward-backward marginals give each token's
probability of being toxic, runs of likely tokens are the offending spans, and a logistic regression on a document's
marginals gives its score.

The model is fitted on a bounded sample of labelled documents (SAMPLE of each label, of near copies one), whose whole
texts stay in the tasks: these count which words toxic documents hold, cut texts into stretches, of which the driver
fits the chain on a bounded number (STRETCHES of SIZE words), and sum up the chain's marginals of whole documents. All
documents are scored whole, and the model that travels to the tasks has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each label that the model is fitted on: those with the smallest hashes of ids.
SAMPLE = 1000
#: Words of a stretch of text, stretches that the chain is fitted on, and words of a step of the fit.
SIZE, STRETCHES, STEP = 256, 4000, 1 << 17
#: Weights of the chain; words stand in it by their hashes.
WIDTH = 1 << 18
#: A word or beginning is toxic if at least this share of toxic documents holds it, which exceeds the share of clean ones by so many standard errors and so many times.
SHARE, ERRORS, TIMES = 0.02, 4.0, 3.0
#: Lengths of beginnings of words, in UTF-8 bytes.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Tokens at least this likely form spans; documents at least this likely are rejected.
SPAN, REJECT = 0.5, 0.7
#: Smallest hashes of a document's word pairs by which near copies are told, and how many of them near copies share.
SKETCH, SHARED = 8, 4
# words of letters: whatever else stands between them doesn't hide them
_TABLE = common.byte_table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)
_NONE = np.uint64(0)


class Tokens:
    """The tokens of a column of texts: word hashes, rows, byte bounds within the text, and features (word, beginnings)."""

    def __init__(self, column: pa.Array):
        data, offsets = common.flat(column)
        self.words, self.row, start, end = common.word_hashes(data, offsets, _TABLE)
        self.n, self.start, self.end = len(column), start - offsets[self.row], end - offsets[self.row]
        folded = _TABLE[0][data]
        own = [self.words]
        for size in PREFIXES:
            prefix = common.mix(common.span_hashes(folded, start, start + np.minimum(size, end - start)) + np.uint64(size))
            own.append(np.where(end - start >= size, prefix, _NONE))
        self.own = np.stack(own, 1)

    def features(self) -> np.ndarray:
        """Weights that a token uses: its word, its beginnings, the word before and the word after."""
        same = self.row[1:] == self.row[:-1]
        some = len(self.words) > 0
        before = np.r_[_NONE, np.where(same, self.words[:-1], _NONE)] if some else self.words
        after = np.r_[np.where(same, self.words[1:], _NONE), _NONE] if some else self.words
        around = np.stack([common.mix(before + np.uint64(1)), common.mix(after + np.uint64(2))], 1)
        return (np.concatenate([self.own, around], 1) % np.uint64(WIDTH)).astype(np.int32)


class Layout:
    """Stretches of at most SIZE tokens of one document, and the order of tokens by place in their stretch, longest stretches first."""

    def __init__(self, row: np.ndarray, n: int):
        size = np.bincount(row, minlength=n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        self.parts = -(-size // SIZE)
        self.first = np.cumsum(self.parts) - self.parts
        part = np.repeat(self.first, size) + place // SIZE
        length = np.bincount(part, minlength=int(self.parts.sum()))
        self.longest = np.argsort(-length, kind="stable")
        rank = np.empty(len(length), np.int64)
        rank[self.longest] = np.arange(len(length))
        self.order = np.lexsort((rank[part], place % SIZE))
        self.bound = np.r_[0, np.cumsum(np.bincount(place % SIZE, minlength=int(length.max(initial=0))))].tolist()
        self.opens = np.zeros(len(length), bool)  # by rank: whether a document begins with the stretch
        self.opens[rank[self.first[size > 0]]] = True

    def edges(self, odds: np.ndarray, e: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
        """By rank, the forward odds before each stretch's first token and the backward odds at its last.

        Both recursions are fractions of linear functions, so a stretch is the product of 2 x 2 matrices; a document's
        stretches are then passed through one by one.
        """
        n = len(self.opens)
        enter, leave = np.zeros(n), np.ones(n)
        if not (self.parts > 1).any():
            return enter, leave
        there, back = np.tile(np.eye(2), (n, 1, 1)), np.tile(np.eye(2), (n, 1, 1))
        for a, b in zip(self.bound, self.bound[1:], strict=False):
            o, own = odds[a:b], slice(0, b - a)
            step = np.empty((b - a, 2, 2))
            step[:, 0, 0], step[:, 0, 1], step[:, 1, 0], step[:, 1, 1] = o * e[3], o * e[1], e[2], e[0]
            if a == 0:
                fresh = self.opens[own]
                step[fresh, 0, 0], step[fresh, 0, 1], step[fresh, 1, 0], step[fresh, 1, 1] = 0, o[fresh] * np.exp(start), 0, 1
            there[own] = step @ there[own]
            step[:, 0, 0], step[:, 0, 1], step[:, 1, 0], step[:, 1, 1] = o * e[3], e[2], o * e[1], e[0]
            back[own] = back[own] @ step
            for m in (there, back):
                m[own] /= m[own].max((1, 2), keepdims=True)
        rank = np.empty(n, np.int64)
        rank[self.longest] = np.arange(n)
        for k in range(1, int(self.parts.max())):
            at = self.first[self.parts > k] + k
            m, x = there[rank[at - 1]], enter[rank[at - 1]]
            enter[rank[at]] = np.clip((m[:, 0, 0] * x + m[:, 0, 1]) / (m[:, 1, 0] * x + m[:, 1, 1]), 1e-30, 1e30)
            at = (self.first + self.parts - k)[self.parts > k]
            m, x = back[rank[at]], leave[rank[at]]
            leave[rank[at - 1]] = (m[:, 0, 0] * x + m[:, 0, 1]) / (m[:, 1, 0] * x + m[:, 1, 1])
        return enter, leave


def marginals(unary: np.ndarray, row: np.ndarray, n: int, edge: np.ndarray, start: float, layout: Layout | None = None, transitions: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of state 1 for each token and of the four transitions into it (index 2 * from + to; 0 at starts).

    unary: log-odds of state 1; edge: log-weights of transitions; start: log-odds of state 1 at the first token.
    The recursions run over all stretches at once, place by place, on the odds of the two states, so their number of
    steps doesn't follow the length of a text.
    """
    if not len(unary):
        return np.zeros(0), np.zeros((0, 4))
    layout = layout or Layout(row, n)
    order, bound = layout.order, layout.bound
    odds = np.exp(np.clip(unary[order], -30, 30))
    e = np.exp(edge)  # 00, 01, 10, 11
    enter, leave = layout.edges(odds, e, start)
    forward, backward = np.empty_like(odds), np.empty_like(odds)
    last = enter
    for t in range(len(bound) - 1):
        a, b = bound[t], bound[t + 1]
        forward[a:b] = np.clip(odds[a:b] * (e[1] + e[3] * last[: b - a]) / (e[0] + e[2] * last[: b - a]), 1e-30, 1e30)
        if t == 0:
            forward[a:b][layout.opens] = odds[a:b][layout.opens] * np.exp(start)
        last = forward[a:b]
    for t in range(len(bound) - 2, -1, -1):
        a, b = bound[t], bound[t + 1]
        more = bound[t + 2] - b if t + 2 < len(bound) else 0  # stretches that go on
        later = odds[b : b + more] * backward[b : b + more]
        backward[a : a + more] = (e[2] + e[3] * later) / (e[0] + e[1] * later)
        backward[a + more : b] = leave[more : b - a]
    both = forward * backward
    one = np.empty_like(odds)
    one[order] = both / (1 + both)
    pairs = np.zeros((len(odds) if transitions else 0, 4))
    if transitions:
        before, after = np.empty_like(odds), np.empty_like(odds)
        before[order], after[order] = forward, odds * backward
        at = np.flatnonzero(row[1:] == row[:-1]) + 1
        last, later = before[at - 1], after[at]
        weight = np.stack([np.full(len(at), e[0]), e[1] * later, e[2] * last, e[3] * last * later], 1)
        pairs[at] = weight / weight.sum(1, keepdims=True)
    return one, pairs


class Chain:
    """The trained field, and the logistic regression from marginals to documents."""

    def __init__(self) -> None:
        self.weights, self.edge, self.start = np.zeros(WIDTH), np.zeros(4), 0.0
        self.judge = np.array([-3.0, 0.0, 0.0, 0.0])

    def unary(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros(len(features))
        for column in features.T:
            out += self.weights[column]
        return out

    def marginals(self, tokens: Tokens) -> np.ndarray:
        return marginals(self.unary(tokens.features()), tokens.row, tokens.n, self.edge, self.start, transitions=False)[0]

    def fit_tokens(self, parts: list[tuple[Tokens, np.ndarray]], steps: int = 25, ridge: float = 1e-2) -> None:
        """Maximum likelihood by Adagrad on full gradients (observed less expected features), summed over `parts` of (tokens, states)."""
        parts = [(t.features(), t.row, t.n, s.astype(float), Layout(t.row, t.n)) for t, s in parts if len(s)]
        total = sum(len(p[3]) for p in parts)
        if not total:
            return
        share = (sum(p[3].sum() for p in parts) + 0.5) / (total + 1)
        self.start = float(np.log(share / (1 - share)))
        self.edge = np.log(np.array([1 - share, share, 1 - share, share]))
        seen = np.zeros(4)
        for _, row, _, state, _ in parts:
            k = np.flatnonzero(row[1:] == row[:-1]) + 1
            seen += np.bincount((2 * state[k - 1] + state[k]).astype(int), minlength=4)
        power, power_edge = np.full(WIDTH, 1e-6), np.full(4, 1e-6)
        for _ in range(steps):
            gradient, expected = -ridge * self.weights, np.zeros(4)
            for feature, row, n, state, layout in parts:
                one, pairs = marginals(self.unary(feature), row, n, self.edge, self.start, layout)
                for column in feature.T:
                    gradient += np.bincount(column, state - one, WIDTH)
                expected += pairs.sum(0)
            power += gradient**2
            self.weights += 0.5 * gradient / np.sqrt(power + 1)
            power_edge += (seen - expected) ** 2
            self.edge += 0.2 * (seen - expected) / np.sqrt(power_edge)

    def documents(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """A score for each text, and the byte spans of its runs of likely toxic tokens."""
        tokens = Tokens(column)
        one, row = self.marginals(tokens), tokens.row
        z = summary(one, row, tokens.n) @ self.judge
        likely = np.flatnonzero(one >= SPAN)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(tokens.n)]
        if len(likely):
            fresh = np.r_[True, (likely[1:] != likely[:-1] + 1) | (row[likely[1:]] != row[likely[:-1]])]
            lead = np.flatnonzero(fresh)
            for a, b in zip(likely[lead], likely[np.r_[lead[1:], len(likely)] - 1], strict=True):
                spans[row[a]].append((int(tokens.start[a]), int(tokens.end[b])))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def summary(one: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """What a document's marginals come to: 1, log of one plus expected toxic tokens, largest marginal, expected share."""
    total = np.bincount(row, one, n)
    size = np.bincount(row, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row, one)
    return np.stack([np.ones(n), np.log1p(total), top, np.log1p(100 * total / np.maximum(size, 1))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.r_[0, w[1:]]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + penalty)
    return w


def _sketch(words: np.ndarray) -> list[int]:
    """The smallest hashes of a document's pairs of words."""
    return np.unique(common.joined(words[:-1], words[1:]))[:SKETCH].view(np.int64).tolist()


def _fresh(sketches: list[list[int]]) -> list[bool]:
    """Marks documents that share fewer than SHARED hashes of their sketches with each earlier marked one."""
    out, seen = [], {}
    for k, sketch in enumerate(sketches):
        owners: dict[int, int] = {}
        for x in sketch:
            if x in seen:
                owners[seen[x]] = owners.get(seen[x], 0) + 1
        out.append(not owners or max(owners.values()) < min(SHARED, len(sketch)))
        if out[-1]:
            seen.update(dict.fromkeys(sketch, k))
    return out


def sampled(docs: DataFrame, labels: DataFrame, learn: F.Column | None, id: str, text: str, label: str, sample: int) -> DataFrame:
    """(k, y, t): at most `sample` labelled documents of each label, whole, numbered from 0, as a stored table.

    Only ids are exchanged to find those that are labelled and there; a label counts as 1 if any of its rows does, and
    of several documents with one id the smallest text counts.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    if learn is not None:
        marked = marked.where(learn)
    marked = marked.groupBy(F.col(id).cast("long").alias("i")).agg(F.max(F.col(label).cast("int")).alias("y"))
    here = docs.select(F.col(id).cast("long").alias("i")).where("i IS NOT NULL").distinct()
    known = marked.join(here, "i").withColumn("h", F.xxhash64("i"))
    parts = [known.where(F.col("y") == y).orderBy("h", "i").limit(sample) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).withColumn("k", F.row_number().over(W.orderBy("h", "i")) - 1)  # twice the sample at most
    texts = docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t")).join(F.broadcast(chosen.select("i", "y", "k")), "i")
    return common.cut(texts.groupBy("k", "y").agg(F.min("t").alias("t")))


def train(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, stretches: int = STRETCHES) -> Chain:
    """A model from the documents that `labels` (id, label) marks and `learn`, a condition on the id, admits.

    Without documents of both labels it calls nothing toxic. The chain learns from one half of the sample, the
    judgement of documents from the other, so that this sees honest marginals.
    """
    chain, spark = Chain(), docs.sparkSession
    rows = sampled(docs, labels, learn, id, text, label, sample)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text=2):
            tokens = Tokens(batch.column(2))
            at = np.searchsorted(tokens.row, np.arange(tokens.n + 1))
            own = [_sketch(tokens.words[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64()))], ["k", "y", "s"])

    found = sorted(tuple(r) for r in rows.mapInArrow(sketch, "k int, y int, s array<long>").collect())  # a few numbers for each sampled document
    fresh = {k: y for (k, y, _), keep in zip(found, _fresh([s for *_, s in found]), strict=True) if keep}
    sizes = [sum(y == label for y in fresh.values()) for label in (0, 1)]
    if not all(sizes):
        return chain
    kept = spark.sparkContext.broadcast(set(fresh))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
        """Slices of the documents that no earlier one is a near copy of, with their tokens."""
        for batch in batches:
            batch = batch.filter(pa.array([k in kept.value for k in batch.column(0).to_pylist()], pa.bool_()))
            for part in common.slices(iter([batch]), text=2):
                if part.num_rows:
                    yield part, Tokens(part.column(2))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens in texts(batches):
            y = batch.column(1).to_numpy()
            for own in tokens.own.T:
                word, number = np.unique(own, return_inverse=True)
                pair = np.unique(number * tokens.n + tokens.row)  # (word, document)
                has = [np.bincount(pair[y[pair % tokens.n] == label] // tokens.n, minlength=len(word)) for label in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *map(pa.array, has)], ["h", "a", "b"])

    counts = rows.mapInArrow(held, "h long, a long, b long").where("h <> 0").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p = (F.col("a") + F.col("b") + 1) / (sum(sizes) + 2)
    clean, toxic = (F.col("a") + 0.5) / (sizes[0] + 1), (F.col("b") + 0.5) / (sizes[1] + 1)
    far = (toxic - clean > ERRORS * F.sqrt(p * (1 - p) * (1 / sizes[0] + 1 / sizes[1]))) & (toxic > TIMES * clean)
    often = F.col("b") >= max(3.0, SHARE * sizes[1])  # so there are at most as many as a typical document holds, times 1 / SHARE
    words = np.array(sorted(r.h for r in counts.where(far & often).select("h").collect()), np.int64).view(np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens in texts(batches):
            ids, labels, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.raw(batch.column(2))
            at = np.searchsorted(tokens.row, np.arange(tokens.n + 1))
            out = [(k, y, a - at[r], body[tokens.start[a] : tokens.end[min(a + SIZE, at[r + 1]) - 1]].decode()) for r, (k, y, body) in enumerate(zip(ids, labels, raw, strict=True)) if k % 2 == 0 for a in range(at[r], at[r + 1], SIZE)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["k", "y", "a", "t"])

    pieces = rows.mapInArrow(cut, "k int, y int, a long, t string").orderBy(F.xxhash64("k", "a"), "k", "a").limit(stretches).select("y", "t").toArrow()
    parts = []
    for at in range(0, len(pieces), STEP // SIZE):
        part = pieces.slice(at, STEP // SIZE).combine_chunks()
        tokens = Tokens(part.column(1).combine_chunks())
        parts.append((tokens, np.isin(tokens.own, words).any(1) & (part.column(0).to_numpy()[tokens.row] == 1)))
    chain.fit_tokens(parts)
    del parts, pieces
    shared = spark.sparkContext.broadcast(chain)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens in texts(batches):
            x = summary(shared.value.marginals(tokens), tokens.row, tokens.n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, x.T)], ["k", "y", "x0", "x1", "x2", "x3"])

    x = rows.where("k % 2 = 1").mapInArrow(judged, "k int, y int, x0 double, x1 double, x2 double, x3 double").toArrow().sort_by("k").to_pandas()
    if len(x):
        chain.judge = _logistic(x[["x0", "x1", "x2", "x3"]].to_numpy(), x.y.to_numpy(float))
    shared.unpersist()
    return chain


def score(docs: DataFrame, model: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with all its columns, then score, predicted (1 from REJECT on) and spans (byte offsets start, end).

    Null and empty texts have no tokens and get the model's score for such; repeated rows and null ids are rows like
    any other. Of names that `docs` has already, its column stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = common.pack(docs, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in common.slices(batches):
            value, spans = shared.value.documents(batch.column(1))
            flag = pa.array((value >= REJECT).astype(np.int32))
            listed = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), flag, listed], [*batch.schema.names, "score", "predicted", "spans"])

    schema = common.extended(rows, "score double, predicted int, spans array<struct<start:int,end:int>>")
    return common.unpack(rows.mapInArrow(run, schema), docs, id, text, ["score", "predicted", "spans"])
