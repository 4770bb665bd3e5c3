import random

import numpy as np
import xxhash

from cellcast.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    value = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            value |= 1 << bit
    return value


def slow_components(rows):
    ids, fps = zip(*rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        known = [x for x in (ids[i], least.get(find(i))) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(((ids[i], fps[i], least[find(i)]) for i in range(len(rows))), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("The of AND to ing é ñu".split()) for _ in range(rnd.randint(0, 700))) for _ in range(40)]
    texts = base + [b.replace(" ", "\n\x0b", 2) + " x" for b in base] + ["", None, "one", "ONE two", " \t", base[0]]
    texts += [f"{base[3]} tail{k}" for k in range(60)]
    rows = [(i + 5, t, "x") for i, t in enumerate(texts)] + [(None, base[1], "y"), (7, base[2], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = slow_components([(i, slow_fingerprint(t)) for i, t, _ in rows])
    for blocks in (None, 5, 6):
        nodes = simhash.links  # the number of tables doesn't change the result
        try:
            simhash.links = lambda n, b=blocks: nodes(n, b, chunk=8)
            got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()]
        finally:
            simhash.links = nodes
        assert sorted(got, key=str) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bit_sliced_comparison():
    rnd = np.random.default_rng(3)
    fps = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps[100:200] = fps[:100] ^ np.array([sum(1 << int(b) for b in rnd.choice(64, rnd.integers(1, 6), replace=False)) for _ in range(100)], np.uint64)
    stored = simhash.planes(fps)
    for q in range(0, 300, 7):
        ones = np.full(len(stored), 2**64 - 1, np.uint64)
        found, kept = simhash.near(stored, np.arange(len(stored)), np.full(len(stored), fps[q]), ones)
        bits = np.zeros((len(stored), 64), bool)
        bits[kept] = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        assert [i for i in range(300) if bits.ravel()[i]] == [i for i in range(300) if (int(fps[q]) ^ int(fps[i])).bit_count() <= 3]


def test_links_found_in_several_pieces_connect_what_is_near():
    rnd = np.random.default_rng(5)
    for across in (False, True):
        base = rnd.integers(0, 1 << 63, 12, dtype=np.uint64)
        chain = [base]
        for _ in range(24):  # each step moves away by two bits, so that groups are long chains
            chain.append(chain[-1] ^ np.array([(1 << int(a)) | (1 << int(b)) for a, b in (rnd.choice(64, 2, replace=False) for _ in base)], np.uint64))
        fp = np.unique(np.concatenate(chain))
        fp = fp[rnd.permutation(len(fp))]
        n = len(fp)
        side = np.sort(rnd.integers(1, 3, n)) if across else np.zeros(n, np.int64)
        near = [(i, j) for i in range(n) for j in range(i) if side[i] != side[j] or not across if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3]
        want = simhash._forest(*np.array(near).T, n)
        for tasks in (4, 16, 1 << 18):
            a, b = simhash.links_of_sorted(np.zeros(n, np.int64), side, fp, tasks)
            at = {int(x): k for k, x in enumerate(fp)}
            got = simhash._forest(np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]), n)
            assert (got == want).all()


def test_long_texts_are_voted_on_in_pieces(monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("a bb ccc dddd é".split()) for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 900)] + ["w" * 300, "x " * 40, "  \n"]
    for piece in (1, 7, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint_batch([t.encode() for t in texts]).tolist() == [slow_fingerprint(t) for t in texts]
    assert simhash.fingerprint_batch([]).tolist() == []
