import random

import numpy as np

from cellcast.llm import common, near_copies, simhash


def slow_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def slow_named(rows):
    """(id, component's smallest id) of each row, by all pairs of whole shingle sets."""
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (id, _) in enumerate(rows):
        known = [x for x in (id, least.get(find(i))) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(((id, least[find(i)]) for i, (id, _) in enumerate(rows)), key=str)


def edited(rnd, words, n):
    """`words` with n of them replaced."""
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.randrange(10**6)}"
    return words


def texts(seed, base=9):
    rnd = random.Random(seed)
    out = []
    for _ in range(base):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice((6, 30, 90, 200, 400)))]
        out.append(words)
        out += [edited(rnd, words, n) for n in (0, 1, 1, 2, 3, 4, 6) if n < len(words)]
        out.append(words[: len(words) * 9 // 10])
        out.append(words + [f"t{k}" for k in range(len(words) // 5)])
        chain = words
        for _ in range(4):  # neighbours are near, ends are not
            chain = chain[max(1, len(chain) // 12) :] + [f"c{rnd.randrange(10**6)}" for _ in range(max(1, len(chain) // 12))]
            out.append(chain)
    return [" ".join(w) for w in out]


def test_against_all_pairs(spark):
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts(1))]
    rows += [(2, None), (5, ""), (8, " \t\n"), (11, "one"), (14, "ONE"), (17, "one two three four"), (20, "one two three four five"), (None, rows[0][1]), (rows[20][0], rows[40][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, node int").repartition(5)
    want = slow_named(rows)
    for rounds, chunk in ((3, 256), (0, 3)):  # pivots and chunks don't change the result
        got = near_copies.near_copies(df, rounds=rounds, chunk=chunk).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert len({c for _, c in want}) < len(want)


def test_a_group_of_many_near_copies_and_one_that_only_looks_alike(spark):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(edited(rnd, words, 3))) for k in range(120)]
    rows += [(1000 + k, " ".join(edited(rnd, words, 12))) for k in range(60)]  # similarity of about 0.6 to the others
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), chunk=16).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == slow_named(rows)


def test_empty_table(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_counters():
    rnd = np.random.default_rng(3)
    fp = rnd.integers(0, 1 << 63, 150, dtype=np.uint64)
    fp[75:] = fp[:75] ^ (rnd.integers(0, 1 << 63, 75, dtype=np.uint64) & rnd.integers(0, 1 << 63, 75, dtype=np.uint64))
    stored = simhash.planes(fp)
    for radius in (1, 3, 9, 16, 24, 31):
        for q in range(0, 150, 7):
            found = near_copies.within(stored, np.arange(len(stored)), np.full(len(stored), fp[q]), radius)
            bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").ravel()[:150]
            assert bits.tolist() == [int((int(fp[q]) ^ int(x)).bit_count() <= radius) for x in fp]


def test_sets_are_those_of_the_words():
    many = texts(3, 3) + ["", "a", "A a", "a b c d", "x " * 40, "é É ñ", "long " * 5 + "w" * 300]
    data = [t.encode() for t in many]
    offsets = np.cumsum([0] + [len(d) for d in data])
    values, sizes = near_copies.sets(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert sizes.tolist() == [len(slow_set(t)) for t in many]
    held = np.split(values, np.cumsum(sizes)[:-1])
    for i in range(len(many)):
        for j in range(i):
            assert len(np.intersect1d(held[i], held[j])) == len(slow_set(many[i]) & slow_set(many[j]))
    fp, bands = near_copies.sketch(values, sizes)
    assert fp[many.index("")] == 0 and (bands[many.index("")] == 0).all()


def test_sifting_loses_no_row(spark):
    rows = spark.createDataFrame([(k * 7 - 20000 if k % 50 else None, str(k)) for k in range(6000)], "x long, t string")
    among = spark.createDataFrame([(k,) for k in range(-20000, 9000, 63)] + [(0,)], "v long")
    some, others = common.sifted(rows, "x", among)
    assert sorted(r.t for r in some.unionByName(others).collect()) == sorted(r.t for r in rows.collect())
    assert others.join(among, others.x == among.v).count() == 0
    wanted = rows.join(among, rows.x == among.v, "left_semi").count()
    assert wanted > 400 and some.count() < wanted + 6000 / 8
    some, others = common.sifted(rows, "x", among.where("false"))
    assert some.count() == 0 and others.count() == 6000
