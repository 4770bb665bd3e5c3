import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from cellcast.llm import common, substrings
from test_fm_index import swapped


def slow(rows, width):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - width + 1):
            if i is not None and first[tuple(words[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "dé", "É"] + [f"w{k}" for k in range(60 if seed % 2 else 3)]
    draw = lambda n: [rnd.choice(words) for _ in range(n)]
    passages = [draw(rnd.randint(40, 130)) for _ in range(6)] + [["a"] * 120, ["a", "b"] * 70, (draw(9) + ["x"]) * 9]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            parts += draw(rnd.randint(0, 30)) + p[rnd.randint(0, 20) : rnd.randint(45, 140)]
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    texts += ["", None, " \t", texts[3], texts[3], " ".join(passages[0]), "a " * 49, "a " * 50, "a " * 51, texts[5] + " " + texts[6]]
    rows = [(k * 3 % 101, t) for k, t in enumerate(texts)]
    return [*rows, (None, texts[5]), (5, texts[6]), (5, texts[6]), (5, texts[8])]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "k", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, s string, n int").repartition(3)
    got = substrings.deduplicate(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == slow(rows, 50)
    for r in got:  # other columns stay with their rows, and the text holds the kept words
        i, t = rows[r.n]
        assert i == r.doc_id and r.s == "k" and (r.text is None) == (t is None)
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == r.kept_sha256
        assert r.n_removed or r.text == t


def test_symbols_stand_wherever_their_words_stand():
    rnd = np.random.default_rng(0)
    for trial in range(200):
        inner = rnd.integers(0, [2, 5, 40][trial % 3], 60)
        around = [(rnd.integers(0, 5, rnd.integers(0, 30)), rnd.integers(0, 5, rnd.integers(0, 30))) for _ in range(2)]
        seen = []
        for left, right in around:
            words = common.mix(np.concatenate([left, inner, right]).astype(np.uint64) + np.uint64(9))
            p = substrings.recompress(words, np.zeros(len(words), np.int64))
            at = len(left)
            own = (p.dl >= at) & (p.dr <= at + 60)
            seen.append({(int(a) - at, int(b) - at, int(s)) for a, b, s in zip(p.lo[own], p.hi[own], p.name[own])})
        assert seen[0] == seen[1]


def test_words_and_texts_that_polynomials_confuse(spark):
    """Words, and whole texts of two words, that differ as the Thue-Morse sequence and its opposite do."""
    one, other = swapped(10)
    around = " ".join(f"u{k}" for k in range(30))
    rows = [(1, f"{around} {one} {around}"), (2, f"{around} {other} {around}")]
    rows += [(3, " ".join(f"long{c}" for c in one)), (4, " ".join(f"long{c}" for c in other)), (5, "y " * 60_000)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == slow(rows, 50)


def test_empty_table(spark):
    assert substrings.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
