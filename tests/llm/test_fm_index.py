import hashlib
import random
import re

import numpy as np
import pytest

from cellcast.llm import fm_index

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def slow(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        if i is not None and w:
            n = min(width, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        words, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                own = windows.get(tuple(words[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data(seed):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "dé", "É9"] + [f"w{k}" for k in range(30 if seed else 0)]
    draw = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, draw(rnd.choice([3, 9, 10, 11, 25]) if seed else rnd.choice([7, 10, 14]))) for k in range(12)] + [(50, ""), (51, None), (None, "a B c"), (7, "solo item w1"), (100, "a a a a")]
    docs = []
    for k in range(80):
        parts = [draw(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            t = rnd.choice(items)[1] or ""
            parts += [rnd.choice([t.upper(), t.replace(" ", ", "), t[3:]]), draw(rnd.randint(0, 9))]
        docs.append((k, ("  ".join(parts))))
    return [*docs, (200, ""), (201, None), (202, "...,"), (3, docs[3][1]), (None, docs[4][1])], items


@pytest.mark.parametrize("seed,block,shard", [(0, 1 << 20, 1 << 20), (1, 1 << 20, 500), (2, 150, 3000)])
def test_against_brute_force(spark, seed, block, shard):
    docs, items = data(seed)
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(docs)], "doc_id long, text string, k int, spans string").repartition(2)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = fm_index.decontaminate(df, bench, block=block, shard=shard).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == slow(docs, items)
    for r in got:
        assert r.spans == "x" and (r.text is None) == (docs[r.k][1] is None)
        assert len(WORD.findall(lower(r.text))) == r.n_words - r.n_hit
        assert r.contaminated or r.text == docs[r.k][1]


def swapped(n):
    """Two words that polynomials modulo 2^64 can't tell apart, whatever their multiplier."""
    text = "a"
    for _ in range(n):
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    one, other = swapped(10)
    docs = spark.createDataFrame([(1, one), (2, other), (3, "long words: " + "x y " * 50_000 + other)], "doc_id long, text string")
    got = fm_index.decontaminate(docs, spark.createDataFrame([(5, one)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in got} == {1: (1, True), 2: (0, False), 3: (0, False)}


def test_empty_tables(spark):
    docs, items = data(1)
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert fm_index.decontaminate(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert fm_index.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).where("contaminated").count() == 0


def test_index_search_and_locate():
    rnd = np.random.default_rng(5)
    for trial in range(60):
        sigma = int(rnd.integers(2, 9))
        text = rnd.integers(0, sigma, int(rnd.integers(1, 300)))
        if trial % 3 == 0:
            text = np.tile(rnd.integers(1, sigma, 7), 30)
        text = np.r_[0, text, 0]
        index = fm_index.FMIndex(text, sigma, step=int(rnd.integers(1, 6)))
        for n in (1, 2, 5):
            p = rnd.integers(1, sigma, n)
            low, high = index.search(p[None, :], np.array([n]))
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want
