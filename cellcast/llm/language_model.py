"""Language-model scores: exact smoothed word counts as a base, and a log-bilinear model.

Counts. Every task counts its words by 64-bit hash and packs the counts into one binary row for each bucket of
hashes; a bucket's rows are merged by one task. Buckets grow in number with the text. The most frequent words (a
bounded number) travel to the tasks that number the texts; the counts of all other words are looked up bucket by bucket:
a task packs (text, word) pairs by bucket, the bucket's task turns them into sums for each text of the pack, and the
sums go back packed. No word and no text ever gathers more than its own share in a task.

Numbers. One pass looks up the words of every text and stores them as numbers of classes, with the sums over the
frequent words. The model learns from these numbers and scores them; texts aren't read or hashed again.

Model. Two context vectors predict the next word's vector (vector log-bilinear). The prediction has two levels: first
the end, any word outside of the vocabulary, or a group of words of similar frequency; then the word within its group.
Both are trained by noise-contrastive estimation, the first with noise shared by a minibatch, the second with noise
words of the same group. Scores are normalised: softmaxes over the groups and over one group's words, by batched matrix
products. A word outside of the vocabulary has the probability of all such words times its smoothed share of them.

Training texts, as numbers of words, are dealt by their hashes to fixed groups of about TOKENS tokens (at most PARTS)
and pass through in the order of their hashes. One group goes ahead, so that all others begin with vectors of the same
meaning; then every group learns on its own, and their parameters are averaged, each row by how often a group has seen
it. So the model doesn't depend on how the input is split.
"""

from __future__ import annotations

import copy
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of the model's vocabulary and of one of its groups; length of word vectors; words before that a word depends on.
VOCAB, GROUP, SIZE, CONTEXT = 16_384, 128, 31, 2
#: Frequent words whose counts travel to the scoring tasks (12 bytes each), and slices of text to a pack.
FREQUENT, PACK = 1 << 17, 64
#: Distinct words that a task counts before it sends them on, bytes of text to a bucket of words, and most buckets.
HELD, BUCKET, BUCKETS = 2_000_000, 64 << 20, 1 << 14
#: Tokens of a minibatch (a divisor of CHUNK); its noise among groups, noise words of a token, and words of a group they are drawn from.
BATCH, NOISE, WORDS, POOL = 2048, 32, 4, 1024
#: Learning rates (Adagrad) of the first part and of all parts, and the first sum of squared gradients.
FIRST, RATE, POWER = 0.3, 0.1, 0.1
#: Rows of one index that are added side by side, and rows that change at a time (they stay near the CPU).
FEW, NEAR = 8, 1024
#: Tokens that are scored at a time, and rows of scores that a product has.
SCORED, BLOCK = 1 << 19, 1024
#: Training tokens to a group of texts, most groups, tokens that a group learns from at a time, and slices of the parameters.
TOKENS, PARTS, CHUNK, SLICES = 1 << 20, 1 << 14, 1 << 16, 128
_TABLE = common.byte_table(common.SPACES, lower=True)
_END = np.uint64(0x5E17E0FD0C000000)
_U = np.uint64


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end after each, and their rows."""
    hashes, row, *_ = common.word_hashes(*common.flat(column), _TABLE)
    n = len(column)
    size = np.bincount(row, minlength=n) + 1
    out = np.full(len(hashes) + n, _END, _U)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(size) - 1] = False
    out[inside] = hashes
    return out, np.repeat(np.arange(n), size)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, counts, len(unique)).astype(np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so sorted hashes have sorted buckets."""
    return ((hashes >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)


def _packed(hashes: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    of = _bucket(hashes, buckets)
    edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    return [(int(of[a]), slice(a, b)) for a, b in zip(edge, np.r_[edge[1:], len(of)], strict=True)] if len(of) else []


def count_words(texts: DataFrame, buckets: int, top: int = FREQUENT) -> DataFrame:
    """(b, h, c, n, v, top): of each bucket, the sorted hashes and counts of `texts` (t) as binary, their sum and number, and the frequent ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _sum(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

        def emit(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            parts = _packed(h, buckets)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([h[s].tobytes() for _, s in parts], pa.binary()), pa.array([c[s].tobytes() for _, s in parts], pa.binary())], ["b", "h", "c"])

        for batch in common.slices(batches, text=0):
            hashes, _ = words(batch.column(0))
            held.append(np.unique(hashes, return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield emit(*held[0])
                    held, size = [], 0
        if held:
            yield emit(*merged())

    own = math.ceil(2 * top / buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(b: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            best = np.sort(np.argpartition(-c, min(own, len(c)) - 1)[:own])
            most = pa.array([[{"h": int(x), "c": int(y)} for x, y in zip(h[best].view(np.int64), c[best], strict=True)]], pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))
            cells = [pa.array([b], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([c.astype(np.int64).tobytes()], pa.binary()), pa.array([int(c.sum())]), pa.array([len(c)], pa.int64()), most]
            return pa.RecordBatch.from_arrays(cells, ["b", "h", "c", "n", "v", "top"])

        now, held, size = None, [], 0
        for batch in batches:
            for b, h, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if b != now and held:
                    yield emit(now, *_sum(*(np.concatenate(x) for x in zip(*held, strict=True))))
                    held, size = [], 0
                now = b
                held.append((np.frombuffer(h, _U), np.frombuffer(c, np.int64)))
                size += len(held[-1][0])
                if size > 4_000_000 and len(held) > 1:  # what is held stays near the number of distinct words
                    held = [_sum(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0]) // 2
        if held:
            yield emit(now, *_sum(*(np.concatenate(x) for x in zip(*held, strict=True))))

    packs = texts.mapInArrow(count, "b int, h binary, c binary").repartition(buckets, "b").sortWithinPartitions("b")
    return common.cut(packs.mapInArrow(merge, "b int, h binary, c binary, n long, v long, top array<struct<h:long,c:long>>"))


def _by(index: np.ndarray, rows: np.ndarray, of: np.ndarray | None = None, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct indices, sums of their rows, how many they are); the row of an index is rows[of] * times, if given."""
    order = np.argsort(index.astype(np.int16) if index.max() < 1 << 15 else index, kind="stable")  # short keys sort faster
    index = index[order]
    start = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    count = np.diff(start, append=len(index))

    def some(at: np.ndarray) -> np.ndarray:
        at = order[at]
        out = rows.take(at if of is None else of[at], axis=0)
        if times is not None:
            out *= times[at, None]
        return out

    # most indices occur a few times: their first rows are added side by side, a sum by segments costs a call for each number
    by = np.argsort((-count).astype(np.int16) if len(order) < 1 << 15 else -count, kind="stable")
    start, count = start[by], count[by]
    index, out, last = index[start], some(start), np.searchsorted(-count, -np.arange(1, FEW + 1))
    for k, n in enumerate(last[:-1].tolist(), 1):
        if n:
            out[:n] += some(start[:n] + k)
    if n := int(last[-1]):
        left = count[:n] - FEW
        first = np.cumsum(left) - left
        out[:n] += np.add.reduceat(some(np.arange(left.sum()) + np.repeat(start[:n] + FEW - first, left)), first, axis=0)
    return index, out, count


def _pull(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _longest(rows: np.ndarray) -> float:
    return math.sqrt(np.einsum("nd,nd->n", rows, rows).max(initial=0))


def _log_share(scores: np.ndarray, row: np.ndarray, target: np.ndarray, small: bool) -> np.ndarray:
    """The logs of the rows' softmaxes at targets; a row may have several. small: no score is beyond 80."""
    own = scores[row, target]
    top = np.float32(0)
    if not small and (scores.max() > 40 or scores.min() < -40):  # a plain sum could leave the range of single precision
        top = scores.max(1)
        scores -= top[:, None]
    return own - (top + np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], scores.dtype)))[row]


class LogBilinear:
    """Word vectors for contexts; for targets, vectors and biases of groups and of words; one diagonal for each place of the context.

    Classes: 0 the end (also what stands before a text), 1 every word outside of the vocabulary, then the vocabulary by
    falling frequency. Outcomes of the first level: 0, 1, then the groups.
    """

    TABLES = ("context", "top", "word", "place")

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, size: int = SIZE, group: int = GROUP, seed: int = 7):
        """vocabulary: hashes of words; counts: of the end, of all words outside, of the vocabulary's words."""
        rnd = np.random.default_rng(seed)
        order = np.argsort(vocabulary)
        self.vocabulary, self.ids = vocabulary[order], np.arange(len(vocabulary))[order] + 2
        counts, n = counts + 0.1, len(vocabulary)
        self.group, self.starts = group, np.arange(0, n, group)
        self.sums = np.r_[0, np.cumsum(counts[2:])]  # for drawing noise words of a group
        mass = np.diff(self.sums[np.r_[self.starts, n]]) if n else np.zeros(0)
        share = np.r_[counts[:2], mass] / counts.sum()
        self.drawn = np.cumsum(share)
        self.log_group, self.log_word = np.log(share).astype(np.float32), np.log(counts[2:] / np.repeat(mass, group)[:n]).astype(np.float32)
        start = lambda rows, bias: np.c_[rnd.normal(0, 0.1, (rows, size)), bias].astype(np.float32)
        self.context, self.top, self.word = start(n + 2, np.zeros(n + 2)), start(len(share), self.log_group), start(n, self.log_word)
        self.place = np.c_[np.ones((CONTEXT, size)), np.zeros(CONTEXT)].astype(np.float32)
        # of each table's rows, their sums of squared gradients and how often they were seen
        self.power: dict[str, np.ndarray] = {}
        self.seen: dict[str, np.ndarray] = {}

    @property
    def kind(self) -> type:
        """The type that holds a class."""
        return np.int16 if len(self.context) <= 1 << 15 else np.int32

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.where(hashes == _END, 0, 1)
        near = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(hashes == _END, 0, np.where(self.vocabulary[near] == hashes, self.ids[near], 1))

    def outcomes(self, classes: np.ndarray) -> np.ndarray:
        return np.where(classes < 2, classes, 2 + (classes - 2) // self.group)

    @staticmethod
    def contexts(classes: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The classes before each token, nearest first; 0 before a text."""
        out = np.zeros((CONTEXT, len(classes)), np.int64)
        for k in range(1, CONTEXT + 1):
            same = row[k:] == row[:-k]
            out[k - 1, k:] = np.where(same, classes[:-k], 0)
        return out

    def predict(self, context: np.ndarray) -> np.ndarray:
        """Predicted vectors, and a last column of ones for biases."""
        return self._sum(self.context.take(context, axis=0))

    def _sum(self, before: np.ndarray) -> np.ndarray:
        q = before[0] * self.place[0]
        for k in range(1, CONTEXT):
            q += before[k] * self.place[k]
        q[:, -1] = 1
        return q

    def _grow(self, name: str, rate: float, index: np.ndarray, gradient: np.ndarray, count: np.ndarray) -> None:
        """Adagrad on the rows of a table: distinct indices, their gradients, and how often they were seen."""
        table = getattr(self, name)
        if name not in self.power:
            self.power[name], self.seen[name] = np.full_like(table, POWER), np.zeros(len(table))
        power, seen = self.power[name], self.seen[name]
        seen[index] += count
        for at in range(0, len(index), NEAR):
            some, of = gradient[at : at + NEAR], index[at : at + NEAR]
            now = np.square(some)
            now += power.take(of, axis=0)
            power[of] = now
            np.sqrt(now, out=now)
            some *= rate
            some /= now
            some += table.take(of, axis=0)
            table[of] = some

    def learn(self, classes: np.ndarray, row: np.ndarray, rnd: np.random.Generator, rate: float = RATE) -> None:
        """One pass of noise-contrastive estimation in minibatches."""
        context, outcome = self.contexts(classes, row), self.outcomes(classes)
        low, high = self.sums[self.starts, None], self.sums[np.minimum(self.starts + self.group, len(self.word)), None]
        last = np.minimum(self.starts + self.group, len(self.word))[:, None] - 1
        log_group, log_word = self.log_group + np.float32(math.log(NOISE)), self.log_word + np.float32(math.log(WORDS))
        for at in range(0, len(classes), BATCH):
            if at % CHUNK == 0:  # of each group's words as many as they are drawn from, for some minibatches
                pool = np.searchsorted(self.sums, low + np.sort(rnd.random((len(self.starts), POOL)), axis=1) * (high - low), "right") - 1
                pool = np.clip(pool, self.starts[:, None], last)
            own, target = context[:, at : at + BATCH], outcome[at : at + BATCH]
            noise = np.minimum(np.searchsorted(self.drawn, rnd.random(NOISE)), len(self.drawn) - 1)
            before = self.context.take(own, axis=0)
            q = self._sum(before)
            t, w = self.top.take(target, axis=0), self.top.take(noise, axis=0)
            up = _pull(np.einsum("nd,nd->n", q, t) - log_group[target])  # pull of the data
            w[:, -1] -= log_group[noise]  # a prediction ends in 1
            down = _pull(np.negative(x := q @ w.T, out=x))  # push of the noise
            t *= up[:, None]
            dq = np.subtract(t, down @ w, out=t)
            self._grow("top", rate, *_by(np.concatenate([target, noise]), np.concatenate([q * up[:, None], -(down.T @ q)])))
            inside = np.flatnonzero(target >= 2)
            if len(inside):
                # each token's word, then its noise words, one below the other
                q, own_group = q.take(inside, axis=0), target.take(inside) - 2
                words = np.empty((1 + WORDS, len(inside)), np.int64)
                words[0] = classes[at + inside] - 2
                words[1:] = pool.ravel().take((own_group[:, None] * POOL + rnd.integers(0, POOL, (len(inside), WORDS))).T)
                w = self.word.take(words, axis=0)
                force = np.einsum("nd,knd->kn", q, w)
                force -= log_word.take(words)
                np.negative(force[1:], out=force[1:])
                _pull(force)
                np.negative(force[1:], out=force[1:])
                w *= force[:, :, None]
                dq[inside] += w.sum(0)
                self._grow("word", rate, *_by(words.ravel(), q, np.tile(np.arange(len(inside)), 1 + WORDS), force.ravel()))
            dq[:, -1] = 0
            places = np.einsum("nd,knd->kd", dq, before)
            np.multiply(dq, self.place[:, None], out=before)
            self._grow("context", rate, *_by(own.ravel(), before.reshape(-1, before.shape[2])))
            self._grow("place", rate, np.arange(CONTEXT), places, np.ones(CONTEXT))

    def log_probabilities(self, classes: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Natural log of each token's normalised class probability."""
        before_each, out, m = self.contexts(classes, row), np.zeros(len(classes)), len(self.context)
        assert m ** (CONTEXT + 1) < 1 << 63, "a context and a class are one number"
        for at in range(0, len(classes), SCORED):
            part = slice(at, at + SCORED)
            # a class in the same context has the same probability, and contexts share their sums: each is found once
            key = before_each[0, part]
            for k in range(1, CONTEXT):
                key = key * m + before_each[k, part]
            key, again = np.unique(key * m + classes[part], return_inverse=True)
            word, before = key % m, key // m
            new = np.concatenate([[True], before[1:] != before[:-1]])
            of, before = np.cumsum(new) - 1, before[new]
            places = []
            for _ in range(CONTEXT):
                places.insert(0, before % m)
                before = before // m
            q, target, own = self.predict(np.stack(places)), self.outcomes(word), np.zeros(len(key))
            small = _longest(q) * max(_longest(self.top), _longest(self.word)) < 80
            bound = np.searchsorted(of, np.arange(0, len(q) + BLOCK, BLOCK))
            for k, (low, high) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
                own[low:high] = _log_share(q[BLOCK * k : BLOCK * (k + 1)] @ self.top.T, of[low:high] - BLOCK * k, target[low:high], small)
            order = np.argsort(target.astype(np.int16) if len(self.starts) < 1 << 14 else target, kind="stable")
            bound = np.searchsorted(target[order], np.arange(2, len(self.starts) + 3))
            for g, start in enumerate(self.starts):
                for k in range(bound[g], bound[g + 1], BLOCK):
                    some = order[k : min(k + BLOCK, bound[g + 1])]
                    context = of.take(some)
                    first = np.concatenate([[True], context[1:] != context[:-1]])
                    own[some] += _log_share(q.take(context[first], axis=0) @ self.word[start : start + self.group].T, np.cumsum(first) - 1, word.take(some) - (2 + start), small)
            out[part] = own[again]
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All tables under each other, and how often each row was seen."""
        seen = [self.seen[n] if n in self.seen else np.zeros(len(getattr(self, n))) for n in self.TABLES]
        return np.concatenate([getattr(self, n) for n in self.TABLES]), np.concatenate(seen)

    def take(self, rows: np.ndarray) -> None:
        for name in self.TABLES:
            size = len(getattr(self, name))
            setattr(self, name, rows[:size].astype(np.float32))
            rows = rows[size:]


class Lookup:
    """Places of hashes in a sorted array, by a table that leaves gaps: a hash stands where its first bits say, or soon after."""

    def __init__(self, known: np.ndarray):
        bits = max(1, (4 * len(known)).bit_length())
        self.shift = _U(64 - bits)
        first = (known >> self.shift).astype(np.int64)
        at = np.maximum.accumulate(first - np.arange(len(known))) + np.arange(len(known))
        size = max(1 << bits, int(at[-1]) + 1 if len(at) else 0) + 1
        self.place = np.full(size, -1, np.int32)
        self.hash = np.full(size, np.iinfo(np.uint64).max, _U)  # a gap is not smaller than any hash
        self.place[at], self.hash[at] = np.arange(len(known)), known

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """-1: not known."""
        at = (hashes >> self.shift).astype(np.int64)
        on = np.flatnonzero(self.hash.take(at) < hashes)
        while len(on):
            at[on] += 1
            on = on[self.hash.take(at[on]) < hashes[on]]
        return np.where(self.hash.take(at) == hashes, self.place.take(at), np.int32(-1))


def train(numbers: DataFrame, model: LogBilinear, tokens: int) -> LogBilinear:
    """`model` after a pass over a part of `numbers` (h long, w binary), and a pass over all.

    h: a hash of the row; w: its classes, as the model holds them; in all they are `tokens` classes, more or less.
    """
    spark = numbers.sparkSession
    parts = max(1, min(PARTS, math.ceil(tokens / TOKENS)))
    kind = model.kind

    def learn(batches: Iterator[pa.RecordBatch], shared, rate: float) -> Iterator[pa.RecordBatch]:
        now, own, rnd, held, size = None, None, None, [], 0

        def step() -> None:
            own.learn(np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held]), rnd, rate)

        def emit() -> pa.RecordBatch:
            if held:
                step()
            rows, seen = own.rows()
            pieces = np.array_split(np.arange(len(rows)), SLICES)
            weighted = (rows * seen[:, None]).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([now] * SLICES, pa.int32()), pa.array([weighted[p].tobytes() for p in pieces], pa.binary()), pa.array([seen[p].tobytes() for p in pieces], pa.binary())], ["s", "g", "p", "n"])

        for batch in batches:
            for g, w in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if g != now:
                    if own is not None:
                        yield emit()
                    now, own, rnd, held, size = g, copy.deepcopy(shared.value), np.random.default_rng(g), [], 0
                held.append(np.frombuffer(w, kind).astype(np.int64))
                size += len(held[-1])
                if size >= CHUNK:
                    step()
                    held, size = [], 0
        if own is not None:
            yield emit()

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, _, p, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                p, n = np.frombuffer(p, np.float32).astype(float), np.frombuffer(n)
                total[s] = [total[s][0] + p, total[s][1] + n] if s in total else [p, n]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array([x[k].tobytes() for x in total.values()], pa.binary()) for k in (0, 1))], ["s", "p", "n"])

    numbers = numbers.select("h", "w", F.pmod("h", F.lit(parts)).cast("int").alias("g"))
    for rows, rate in ((numbers.where("g = 0"), FIRST), (numbers, RATE)):
        shared = spark.sparkContext.broadcast(model)
        ordered = rows.repartition(parts, "g").sortWithinPartitions("g", "h", "w").select("g", "w")
        learnt = ordered.mapInArrow(functools.partial(learn, shared=shared, rate=rate), "s int, g int, p binary, n binary")
        found = sorted(learnt.repartition(SLICES, "s").sortWithinPartitions("s", "g").mapInArrow(average, "s int, p binary, n binary").collect())  # the model's size, whatever the input
        if found:
            old, _ = model.rows()
            seen = np.concatenate([np.frombuffer(r.n) for r in found])
            sums = np.concatenate([np.frombuffer(r.p) for r in found]).reshape(old.shape)
            model.take(np.where(seen[:, None] > 0, sums / np.maximum(seen, 1)[:, None], old))
        shared.unpersist()
    return model


def scores(docs: DataFrame, learn: F.Column, id: str = "doc_id", text: str = "text", vocabulary: int = VOCAB, frequent: int = FREQUENT, buckets: int | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from the rows where `learn` holds.

    learn: a condition on the column of ids (null counts as false). Null texts are empty and hold only their end.
    Repeated rows and null ids are rows like any other; without rows to learn from every word is unknown. Other
    columns aren't read. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = rows.where("learn")
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        buckets = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET)))
    counts = count_words(training.select("t"), buckets, frequent)
    total = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, v_train = total.n or 0, total.v or 0
    top = counts.select(F.explode("top").alias("x")).select("x.h", "x.c").orderBy(F.desc("c"), "h").limit(frequent).toPandas()
    known, often = top.h.to_numpy(np.int64).view(_U), top.c.to_numpy(np.int64)
    ends = training.count()  # one in each text, and always among the known
    plain = known != _END
    known, often = (np.r_[x[plain], np.array([y] if ends else [], x.dtype)] for x, y in ((known, _END), (often, ends)))
    chosen = np.arange(len(known) - (ends > 0))[:vocabulary]
    others = n_train - ends - int(often[chosen].sum())
    model = LogBilinear(known[chosen], np.r_[ends, others, often[chosen]])
    order = np.argsort(known)
    table = Lookup(known[order]), np.log10(np.r_[often[order], 0] + 0.1), np.r_[model.classes(known[order]), 1].astype(model.kind)
    shared = spark.sparkContext.broadcast(table)
    kind = model.kind
    # a word of the class of others has its smoothed share of the class, one unseen word included
    mass = math.log10(others + 0.1 * (max(0, v_train - len(chosen) - (ends > 0)) + 1))
    norm = math.log10(n_train + 0.1 * (v_train + 1))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and rows of the rare words of PACK slices for each bucket."""
        find, logs, classes = shared.value
        task, group, at, held = TaskContext.get().partitionId(), 0, 0, []

        def emit() -> pa.RecordBatch:
            h, doc, times = (np.concatenate([x[k] for x in held]) for k in range(3))
            by = np.argsort(h, kind="stable")
            h, doc, times = h[by], doc[by].astype(np.int32), times[by].astype(np.int32)
            parts = _packed(h, buckets)
            packed = [pa.array([x[s].tobytes() for _, s in parts], pa.binary()) for x in (h, doc, times)]
            return _batch(len(parts), b=pa.array([b for b, _ in parts], pa.int32()), g=pa.array([task << 32 | group] * len(parts), pa.int64()), h=packed[0], d=packed[1], c=packed[2])

        for batch in common.slices(batches):
            hashes, row = words(batch.column(1))
            n = batch.num_rows
            near = find(hashes)
            own, w = logs.take(near), classes.take(near)  # the last is for words that aren't there
            rare = near < 0
            own[rare] = 0
            if not ends:
                w[hashes == _END] = 0
            # every pair of a text and a rare word once
            h, d = hashes[rare], row[rare]
            pair = np.lexsort((h, d))
            h, d = h[pair], d[pair]
            fresh = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
            size, missed = np.bincount(row, minlength=n), np.bincount(row, rare, n).astype(np.int64)
            bound = np.zeros(n + 1, np.int32)
            bound[1:] = np.cumsum(size * w.itemsize)
            texts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bound), pa.py_buffer(w)])
            base, others = np.bincount(row, own, n) - size * norm, np.bincount(row, (own - mass) * (w == 1), n)
            yield _batch(n, b=pa.array(np.full(n, -1, np.int32)), g=pa.array(np.full(n, task << 32 | group)), i=batch.column(0), learn=batch.column(2), k=batch.column(3), w=texts, at=pa.array(np.arange(at, at + n, dtype=np.int32)), known=pa.array(size - missed), base=pa.array(base), lm=pa.array(others))
            held.append((h[fresh], d[fresh] + at, np.diff(fresh, append=len(h))))
            at += n
            if len(held) == PACK:
                yield emit()
                group, at, held = group + 1, 0, []
        if held:
            yield emit()

    fields = {"b": pa.int32(), "g": pa.int64(), "h": pa.binary(), "d": pa.binary(), "c": pa.binary(), "i": pa.int64(), "learn": pa.bool_(), "k": pa.int64(), "w": pa.binary(), "at": pa.int32(), "known": pa.int64(), "base": pa.float64(), "lm": pa.float64()}

    def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(n, of) for f, of in fields.items()], list(fields))

    key = F.xxhash64("i", "t").alias("k")  # rows that repeat a text are dealt by their ids
    packs = common.cut(rows.select("i", "t", "learn", key).mapInArrow(number, "b int, g long, h binary, d binary, c binary, i long, learn boolean, k long, w binary, at int, known long, base double, lm double"))
    if n_train:
        model = train(packs.where("b < 0 AND learn").select(F.col("k").alias("h"), "w"), model, n_train)
    shared_model = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, docs) of texts that are in a pack."""
        model, held, size = shared_model.value, [], 0

        def emit() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            data, bound = common.flat(rows["w"])
            n = np.diff(bound) // np.dtype(kind).itemsize
            row = np.repeat(np.arange(len(n)), n)
            lm = np.bincount(row, model.log_probabilities(np.frombuffer(data, kind).astype(np.int64), row), len(n)) / math.log(10)
            g = rows["g"].to_numpy()
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            docs = pa.StructArray.from_arrays([rows["i"], rows["at"], pa.array(n), rows["known"], rows["base"], pa.array(lm + rows["lm"].to_numpy())], ["i", "at", "n", "known", "base", "lm"])
            return pa.RecordBatch.from_arrays([pa.array(g[first]), pa.ListArray.from_arrays(pa.array(np.r_[first, len(g)].astype(np.int32)), docs)], ["g", "docs"])

        for batch in common.slices(batches, text=2, limit=SCORED * np.dtype(kind).itemsize):
            if held and size + batch.column(2).nbytes > SCORED * np.dtype(kind).itemsize:
                yield emit()
                held, size = [], 0
            held.append(batch)
            size += batch.column(2).nbytes
        if held:
            yield emit()

    heads = packs.where("b < 0").select("g", "i", "w", "at", "known", "base", "lm").mapInArrow(score, "g long, docs array<struct<i:long,at:int,n:long,known:long,base:double,lm:double>>")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, logs, had = None, np.zeros(0, _U), np.zeros(0), np.zeros(0)
        for batch in batches:
            out = []
            for b, g, own, doc, times in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if b != now:
                    now, h, logs = b, np.zeros(0, _U), np.zeros(0)
                if g < 0:  # the bucket's counts come before the packs
                    h, logs = np.frombuffer(own, _U), np.log10(np.frombuffer(times, np.int64) + 0.1)
                    continue
                own, doc, times = np.frombuffer(own, _U), np.frombuffer(doc, np.int32), np.frombuffer(times, np.int32)
                near = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
                there = h[near] == own if len(h) else np.zeros(len(own), bool)
                value = np.where(there, logs[near], -1.0) if len(h) else np.full(len(own), -1.0)
                some, inverse = np.unique(doc, return_inverse=True)
                total, had = np.bincount(inverse, value * times, len(some)), np.bincount(inverse, there * times, len(some))
                out.append((g, some.astype(np.int32).tobytes(), total.tobytes(), had.astype(np.int32).tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["g", "d", "s", "k"])

    stored = counts.select("b", F.lit(-1).cast("long").alias("g"), "h", F.lit(None).cast("binary").alias("d"), "c")
    dealt = packs.where("b >= 0").select("b", "g", "h", "d", "c").unionByName(stored).repartition(buckets, "b").sortWithinPartitions("b", "g")
    sums = dealt.mapInArrow(look_up, "g long, d binary, s binary, k binary").select("g", "d", "s", "k", F.lit(None).cast(heads.schema["docs"].dataType).alias("docs"))
    heads = heads.select("g", F.lit(None).cast("binary").alias("d"), F.lit(None).cast("binary").alias("s"), F.lit(None).cast("binary").alias("k"), "docs")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, sums = None, [], []

        def emit() -> pa.RecordBatch:
            rows = pa.concat_arrays([x.flatten() for x in docs])
            at = rows.field("at").to_numpy()
            total, had = np.zeros(at.max() + 1), np.zeros(at.max() + 1, np.int64)
            for d, s, k in sums:
                d = np.frombuffer(d, np.int32)
                total[d] += np.frombuffer(s)
                had[d] += np.frombuffer(k, np.int32)
            total, had = total[at], had[at]
            cells = [rows.field("i"), rows.field("n"), pa.array(rows.field("known").to_numpy() + had), pa.array(rows.field("base").to_numpy() + total), pa.array(rows.field("lm").to_numpy() + total)]
            return pa.RecordBatch.from_arrays(cells, ["i", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for k, (g, d, s, had) in enumerate(zip(*(x.to_pylist() for x in batch.columns[:4]), strict=True)):
                if g != now:
                    if docs:
                        yield emit()
                    now, docs, sums = g, [], []
                if d is None:
                    docs.append(batch.column(4).slice(k, 1))
                else:
                    sums.append((d, s, had))
        if docs:
            yield emit()

    joined = heads.unionByName(sums).repartition("g").sortWithinPartitions("g").select("g", "d", "s", "k", "docs")
    done = joined.mapInArrow(finish, "i long, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("i").alias(id), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
