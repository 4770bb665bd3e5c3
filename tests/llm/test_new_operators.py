"""Ranked search, periodic runs and quality rules against plain Python, by operator and by the registered queries."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cellcast.llm import common, fertility, lexical, queries, runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- plain Python ---------------------------------------------------------------------------------------------------------


def slow_search(docs, items, best=10):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, total = len(terms), sum(len(t) for _, t in terms)
    counts = [(i, len(t), collections.Counter(t)) for i, t in terms]
    df = collections.Counter(w for _, _, c in counts for w in c)
    asked = collections.defaultdict(collections.Counter)
    for q, t in set(items):
        asked[q].update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for q, words in asked.items():
        if q is None:
            continue
        found = []
        for i, size, c in counts:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w, k in words.items() if w in c)
            if s > 0 and i is not None:
                found.append((-s, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def slow_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def slow_collapsed(words, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def slow_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat)


def same(symbols, bounds, least):
    got = list(zip(*(x.tolist() for x in runs.find(np.array(symbols), np.array(bounds), least)), strict=True))
    return got == [(r, *x) for r in range(len(bounds) - 1) for x in slow_runs(symbols[bounds[r] : bounds[r + 1]], least)]


# --- ranked search -----------------------------------------------------------------------------------------------------------


def test_search_equals_plain_python(spark):
    rnd = random.Random(1)
    words = [f"w{int(rnd.paretovariate(0.8))}" for _ in range(4000)]
    docs = [(rnd.randrange(10**12), " ".join(rnd.choices(words, k=rnd.randrange(40)))) for _ in range(300)]
    docs += [(5, "Ätna ätna w1"), (5, "w1 w1,W1;w2"), (7, ""), (8, None), (None, "w1 w3"), (9, "w3 " * 5000), (10, "w1 w2"), (11, "w1 w2")]
    items = [(1, "w1 w2 w2 W3"), (2, None), (3, "nothing here"), (4, "w9 w10 w11 w12 ätna"), (4, "w1"), (4, "w1"), (None, "w1")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for block, window, shard in ((lexical.BLOCK, lexical.WINDOW, lexical.SHARD), (8, 64, 100)):
        got = sorted(tuple(r) for r in lexical.search(frame, asked, block=block, window=window, shard=shard).select("item_id", "rank", "doc_id", "score").collect())
        assert got == slow_search(docs, items)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.search(none, asked).count() == 0 and lexical.search(frame, asked.where("item_id = 99")).count() == 0


def test_op11(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op11_lexical"](spark, SF)
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == slow_search(docs, items)
    assert dict(got.dtypes)["rank"] == "int"


# --- periodic runs -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("letters,size", [(1, 30), (2, 40), (2, 90), (3, 60), (4, 300)])
def test_runs_equal_plain_python(letters, size):
    rnd = random.Random(letters * size)
    for _ in range(60):
        parts = [[rnd.randrange(letters) for _ in range(rnd.randrange(size))] for _ in range(rnd.randrange(1, 6))]
        symbols = [x for p in parts for x in p]
        assert same(symbols, np.cumsum([0, *map(len, parts)]).tolist(), rnd.choice([2, 5, 12]))


def test_runs_of_fibonacci_words_and_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert same(b, [0, len(b)], 2)
    tail = list(range(1000)) * 3 + [7, 7]
    assert same(tail, [0, len(tail)], 12)
    one = [3] * 5000
    assert [x.tolist() for x in runs.find(np.array(one), np.array([0, 5000]))] == [[0], [0], [5000], [1]]


def test_collapse_keeps_rows_and_columns(spark):
    rows = [(1, "a b\tc " * 6 + "end", "p"), (1, "a b\tc " * 6 + "end", "p"), (2, None, None), (3, "", "q"), (4, "one two  three\nfour", "r"), (None, "é " * 20000, "s"), (5, " \n\t", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(2)
    got = [tuple(r) for r in runs.collapse(docs, batch=64).collect()]
    assert sorted(got, key=str) == sorted([(1, "a b\tc  end", "p", 19), (1, "a b\tc  end", "p", 19), (2, None, None, 0), (3, "", "q", 0), (4, "one two  three\nfour", "r", 4), (None, "é  ", "s", 20000), (5, " \n\t", "t", 0)], key=str)
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.collapse(docs.drop("runs")).collect()}
    assert found[1] == [(0, 18, 3)] and found[None] == [(0, 20000, 1)] and found[2] == found[4] == []
    assert runs.collapse(docs.limit(0)).count() == 0


def test_op12(spark):
    for r in queries.QUERIES["op12_runs"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = slow_runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(slow_collapsed(words, found))))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want


# --- quality rules --------------------------------------------------------------------------------------------------------------


def _paths():
    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


TEXTS = [None, "", " \n\t ", "one", "a b c a b c\na b c\n\nx\r\nx\r\n", "x\ny\nx \nx", "Привет мир #1 <b> ", "漢字かな 漢字", "🦊 " * 30, "é|é\n" * 9, "w " * 30000, "##" * 5000]


def test_measures_equal_plain_python(spark):
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, entropy int")
    got = {r.doc_id: r for r in fertility.measure(docs, *_paths(), language="lang", table=3).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=_paths()[0])
    for i, t in enumerate(TEXTS):
        r, want = got[i], slow_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        ids = [k for w in WORD.findall(t or "") for k in model.encode(w)]
        assert r.n_pieces == len(ids)
        if ids:
            each = collections.Counter(ids)
            assert r.chars_per_piece == pytest.approx(want[1] / len(ids)) and r.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
            assert r.entropy == pytest.approx(-sum(n / len(ids) * math.log2(n / len(ids)) for n in each.values()), abs=1e-9)
        else:
            assert r.chars_per_piece is r.entropy is r.byte_share is r.chars_per_byte_token is None
    assert [got[i].script for i in (0, 4, 6, 7, 8)] == ["Other", "Latin", "Cyrillic", "Han", "Other"]


def test_bands_reject_what_lies_far_out(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 9))) for _ in range(500)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(60, 400)))) for i in range(400)]
    odd = {1001: " ".join(w.upper() + "!!" for w in rnd.choices(words, k=200)), 1002: " ".join(w + "###" for w in rnd.choices(words, k=300)), 1003: "ᚁᚂ " * 120 + " ".join(words[:200]), 1004: " ".join(words[k % 9] for k in range(300))}
    copies = [(2000 + i, docs[0][1]) for i in range(700)]  # don't narrow the band
    frame = spark.createDataFrame([*docs, *odd.items(), *copies, (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in fertility.quality(frame, *_paths(), least=50).collect()}
    assert len(got) == 1105 and all(got[i].kept for i, _ in docs) and all(got[i].kept for i, _ in copies)
    assert not any(got[i].kept for i in odd) and got[None].reason == "n_words" and got[1004].base_failed and got[1001].reason.startswith("chars_per_")
    few = fertility.quality(frame.where("doc_id < 10 OR doc_id > 1000 AND doc_id < 1004"), *_paths())
    assert all(r.kept for r in few.collect())  # no band, so only the base rules hold
    assert fertility.quality(frame.limit(0), *_paths()).count() == 0


def test_op13(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.QUERIES["op13_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        n, *more = slow_base(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *more)
        assert r.base_failed == (n < 50 or 100 * more[-1] > 50 * n) and not (r.base_failed and r.kept)
    clean = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert all(r.kept for r in clean)


def test_words_in_repeated_windows():
    words = "a b c d a b c x a b".split()
    hashes = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    assert fertility.repeated(common.mix(hashes), np.zeros(10, np.int64)).tolist() == [True] * 3 + [False] + [True] * 3 + [False] * 3
    assert not fertility.repeated(common.mix(hashes), np.arange(10)).any()
