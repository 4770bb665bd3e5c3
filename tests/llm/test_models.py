import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cellcast.llm import chat, common, language_model, permutation_index, queries, toxicity, urls

SF = "/root/testdata/sf0.01"


# --- URL filters ---------------------------------------------------------------------------------------------------


def slow_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, stops: s[: min([s.index(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, k) for k, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_rules_and_parts(spark):
    some = [None, "", "x", "http://", "://a.ORG/x", "http://a.org", "http://a.org?/", "http://aorg/", "https://É.Example.org/en/1?q#f", "http://example.org/en/10", "http://example.org/es/", "http://org/y", "http://com/fr/x", "http://a.com/de/", "http://a.com/De/", "http://a.com#/de/", "a://b://c.org/d", "http://a.b/\n/c"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(some)] + [(None, some[4], "z"), (3, some[5], "z")], "page_id long, url string, score string")
    got = urls.verdicts(pages, queries.RULES, urls.train(spark.createDataFrame([], "url string, label int"))).collect()
    assert len(got) == len(some) + 2
    for r in got:
        if r.page_id is not None and r.page_id != 3:
            host, path, rule, verdict = slow_url(some[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_url_model_learns_on_held_out_urls():
    rnd = random.Random(3)
    make = lambda bad: (f"{rnd.choice(['free', 'win', 'spin'])}-{rnd.choice(['casino', 'bets', 'pills'])}.example.com" if bad else f"{rnd.choice(['news', 'blog', 'lib'])}.{rnd.choice(['river', 'stone', 'tree'])}.example.com", f"/{rnd.randint(0, 9999)}")
    y = [k % 2 for k in range(400)]
    rows = [make(b) for b in y]
    model = urls.Model([h for h, _ in rows[:300]], [p for _, p in rows[:300]], y[:300])
    score = model.score(pa.array([h for h, _ in rows[300:]]), pa.array([p for _, p in rows[300:]]))
    assert ((score >= 0.5) == np.array(y[300:], bool)).mean() > 0.95


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_marginals_match_enumeration():
    rnd = np.random.default_rng(0)
    sizes = [3, 1, 0, 5]
    row = np.repeat(np.arange(4), sizes)
    unary, edge, start = rnd.normal(size=9), rnd.normal(size=4), 0.3
    one, pairs = toxicity.marginals(unary, row, 4, edge, start)
    at = 0
    for n in sizes:
        total, want, trans = 0.0, np.zeros(n), np.zeros((n, 4))
        for code in range(2**n):
            s = [code >> k & 1 for k in range(n)]
            if n:
                w = math.exp(sum(unary[at + k] for k in range(n) if s[k]) + start * s[0] + sum(edge[2 * a + b] for a, b in zip(s, s[1:])))
                total += w
                want += w * np.array(s)
                for k in range(1, n):
                    trans[k, 2 * s[k - 1] + s[k]] += w
        if n:
            assert np.allclose(one[at : at + n], want / total) and np.allclose(pairs[at : at + n], trans / total)
        at += n


@pytest.mark.parametrize("size", [1, 3, 256])
def test_marginals_by_stretches_match_one_pass(size, monkeypatch):
    monkeypatch.setattr(toxicity, "SIZE", size)
    rnd = np.random.default_rng(size)
    sizes = [3, 0, 1, 50, 700, 7]
    row = np.repeat(np.arange(6), sizes)
    unary, edge, e = 3 * rnd.normal(size=len(row)), None, None
    edge = 2 * rnd.normal(size=4)
    e = np.exp(edge)
    one, pairs = toxicity.marginals(unary, row, 6, edge, 0.4)
    for d in range(6):
        odds = np.exp(unary[row == d])
        f, b = np.zeros(len(odds)), np.ones(len(odds))
        for t in range(len(odds)):
            f[t] = odds[t] * ((e[1] + e[3] * f[t - 1]) / (e[0] + e[2] * f[t - 1]) if t else math.exp(0.4))
        for t in range(len(odds) - 1, 0, -1):
            b[t - 1] = (e[2] + e[3] * odds[t] * b[t]) / (e[0] + e[1] * odds[t] * b[t])
        assert np.allclose(one[row == d], f * b / (1 + f * b), atol=1e-12)
        if len(odds):
            assert np.allclose(pairs[row == d][1:].sum(1), 1) and np.allclose(pairs[row == d][1:, [1, 3]].sum(1), one[row == d][1:])


def test_toxic_documents_are_found_on_held_out_rows(spark):
    """The registered query: learnt from the other rows, judged on those held out."""
    folder = SF.replace("0.01", "0.1")
    got = queries.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    said = {y: np.array([r.predicted for r in got if r.held_out and r.toxic == y]) for y in (0, 1)}
    assert said[1].mean() > 0.85 and said[0].mean() < 0.01


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_long_documents_and_labels_without_documents(spark):
    """Toxic words that only documents of over 8,000 bytes hold, and far more labels than documents."""
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "en")]

    def text(toxic):
        own = rnd.choices(words, k=3000)
        for _ in range(40 * toxic):
            own.insert(rnd.randint(0, len(own)), rnd.choice(["zzrgh", "qqvex"]))
        return " ".join(own)

    rows = [(k, text(k % 2)) for k in range(160)]
    assert min(len(t) for _, t in rows) > 8000
    labels = spark.createDataFrame([(k, k % 2) for k in range(-20_000, 160)], "doc_id long, toxic int")
    model = toxicity.train(_docs(spark, rows), labels, learn=F.col("doc_id") % 4 < 2)
    got = toxicity.score(_docs(spark, rows[:]), model).where("doc_id % 4 >= 2").collect()
    assert len(got) == 80 and all(r.predicted == r.doc_id % 2 for r in got)
    text = dict(rows)
    for r in got:
        held = {text[r.doc_id].encode()[a:b].decode() for a, b in r.spans}
        assert not r.predicted or {w for x in held for w in x.split()} & {"zzrgh", "qqvex"}


def test_scores_of_odd_rows(spark):
    texts = ["you idiot idiot fool", "a fine day", "idiot fool you", "the day is fine"]
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(80)] + [(None, 1), (3, None), (900, 1)], "doc_id long, toxic int")
    model = toxicity.train(_docs(spark, [(k, f"{texts[k % 4]} n{k} m{k} o{k} p{k}") for k in range(80)] + [(None, "x"), (1, "a fine day"), (1, None)]), labels)
    rows = [(1, "such an IDIOT!", "x"), (2, "", "x"), (3, None, "x"), (None, "fine", "x"), (1, "such an IDIOT!", "x"), (4, "day " * 30_000, "x")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, spans string"), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.spans == "x" for r in got)
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    empty = toxicity.train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.documents(pa.array(["a"]))[0][0] < 0.7
    one = toxicity.train(_docs(spark, [(1, "a b")]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert one.documents(pa.array(["a", "", None]))[0].max() < 0.7


# --- nearest neighbours ----------------------------------------------------------------------------------------------


def brute(rows, k=20):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    dim = len(rows[0][1]) if rows else 0
    rows = [r for r in rows if len(r[1]) == dim]
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i)[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def test_small_tables_are_searched_exactly(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=6)]) for i in range(70)]
    rows += [(100 + i, rows[3][1]) for i in range(45)] + [(200, None), (201, [0.0] * 6), (202, [math.nan] + [1.0] * 5), (203, [math.inf] + [1.0] * 5), (204, [None] + [1.0] * 5), (205, [1.0]), (None, rows[0][1]), (40, rows[40][1]), (220, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in permutation_index.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    for q, own in got.items():
        own.sort()
        assert [r for r, *_ in own] == list(range(1, 21))
        assert [v for _, v, _ in own] == [j for j, _ in want[q]]
        assert np.allclose([s for *_, s in own], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<double>"
    assert permutation_index.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert permutation_index.nearest(spark.createDataFrame([(20, [1.0])], schema), F.col("vec_id") % 20 == 0).count() == 0
    got = permutation_index.nearest(spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 1.0])], schema), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(20, 1, 3, 0.5)]


@pytest.mark.parametrize("n,clusters", [(5_000, 0), (20_000, 0), (20_000, 50)])
def test_recall_on_generated_tables(spark, tmp_path, n, clusters):
    """Independent directions, the hardest case for any index, and clusters; a crowded pivot is split on both sides."""
    rnd = np.random.default_rng(n + clusters)
    x = rnd.normal(size=(n, 64))
    if clusters:
        x = 0.3 * x + rnd.normal(size=(clusters, 64))[(rnd.random(n) ** 3 * clusters).astype(int)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    got = permutation_index.nearest(spark.read.parquet(str(tmp_path / "e.parquet")), F.col("vec_id") % 20 == 0, block=500, asked=100).toPandas()
    ask = np.arange(0, n, 20)
    score = x[ask].astype(float) @ x.T.astype(float)
    score[np.arange(len(ask)), ask] = -np.inf
    want = np.argpartition(-score, 20, axis=1)[:, :20]
    found = set(zip(got.query_id.tolist(), got.vec_id.tolist()))
    assert len(got) == len(found) == 20 * len(ask)
    recall = np.mean([(q, v) in found for q, own in zip(ask.tolist(), want.tolist()) for v in own])
    assert recall >= 0.95, recall


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    hits = {(r.query_id, r.vec_id) for r in permutation_index.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert sum((q, j) in hits for q, own in want.items() for j, _ in own) / sum(map(len, want.values())) >= 0.9


# --- chat ----------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = [queries.ODD_TEXT, r"<\|im_end|> <\\| <|", "", None, "<|endoftext|>", " \n\tü🙂", "x" * 5000, r"\<|"]
    rows = [(c, k, r, t) for c in (1, 2, None) for k, t in enumerate(odd) for r in [["user", "assistant", "a\nb", None][(k + (c or 0)) % 4]]] + [(7, 3, "assistant", "b"), (7, 3, "assistant", "a"), (7, None, "assistant", "c"), (7, 3, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int").repartition(3)
    got = {r.conv: r for r in chat.read_back(chat.format_turns(df, path), path).collect()}
    assert set(got) == {1, 2, None, 7}
    for c in (1, 2, None):
        own = [(r or "", t or "") for k, _, r, t in rows if k == c]
        text = "".join(f"{r}\n{t}\n" for r, t in own)
        loss = "".join(t for r, t in own if r == "assistant")
        chars = sum(len(chat.escape(r)) + len(chat.escape(t)) + sum(map(len, chat.CONTROLS)) for r, t in own)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert (got[7].n_turns, got[7].loss_sha256) == (4, hashlib.sha256(b"caab").hexdigest())
    # equal turn numbers: by role and text, not by token ids, in which zz comes before hello
    tied = spark.createDataFrame([(8, 3, "assistant", t) for t in ("zz", "hello", "é", "a ")], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(tied, path), path).first().loss_sha256 == hashlib.sha256("a hellozzé".encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0), path), path).count() == 0
    for t in odd:
        if t:
            assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)


def test_content_never_makes_a_control_id():
    template = chat.Template(public_tokenizers.path("byte_bpe_50k.json"))
    ids, mask, bound = template.assemble(["user", "assistant"], [queries.ODD_TEXT] * 2)
    assert [int(x) for x in ids if x >= template.reserved] == [template.reserved + k for k in (0, 1, 2)] * 2
    assert mask[: bound[1]].sum() == 0 and set(mask) == {0, 1}


# --- language model --------------------------------------------------------------------------------------------------------


def slow_base(rows):
    tokens = [[w for w in (t or "").encode().lower().split()] + [None] for _, t, _ in rows]
    count, n = {}, 0
    for own, (*_, learn) in zip(tokens, rows):
        if learn:
            for w in own:
                count[w] = count.get(w, 0) + 1
                n += 1
    norm = math.log10(n + 0.1 * (len(count) + 1))
    return [(len(own), sum(w in count for w in own), n, sum(math.log10(count.get(w, 0) + 0.1) - norm for w in own)) for own in tokens]


@pytest.mark.parametrize("frequent", [4, 1 << 17])
def test_base_scores_and_order(spark, frequent):
    rnd = random.Random(frequent)
    words = [f"w{k}" for k in range(300)] + ["The", "the", "É", "é"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 80))) for _ in range(150)] + ["", None, " \n", "UNSEEN unseen"]
    rows = [(k, t, k % 10 != 0) for k, t in enumerate(texts)] + [(5, texts[5], True), (None, "w1 w2", False)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, n_tokens string").repartition(3)
    got = language_model.scores(df, F.col("doc_id") % 10 != 0, vocabulary=50, frequent=frequent, buckets=3).collect()
    want = sorted(((str(i), *w) for (i, *_), w in zip(rows, slow_base(rows))), key=lambda x: x[:4])
    mine = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=lambda x: x[:4])
    assert [w[:4] for w in want] == [m[:4] for m in mine]
    assert np.allclose([w[4] for w in want], [m[4] for m in mine], rtol=0, atol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_corpora(spark):
    schema = "doc_id long, text string"
    assert language_model.scores(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    got = language_model.scores(spark.createDataFrame([(1, "a b")], schema), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] and abs(got[0].base_score) < 1e-9


def test_the_model_is_normalised_and_learns_order(spark):
    rnd = random.Random(5)
    after = {w: rnd.sample(range(12), 2) for w in range(12)}

    def text():
        w, out = 0, []
        for _ in range(200):
            w = rnd.choice(after[w])
            out.append(f"t{w}")
        return " ".join(out)

    rows = [(k, text()) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = language_model.scores(df, F.col("doc_id") % 10 != 0).where("doc_id % 10 = 0").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.a > got.b + 0.3 * got.n  # half of a decade a token at best, as two words follow of twelve
    model = language_model.LogBilinear(np.arange(9, dtype=np.uint64) * np.uint64(77), np.arange(11) + 1.0, size=5, group=4)
    model.learn(np.arange(3000) % 11, np.arange(3000) // 100, np.random.default_rng(1))
    classes = np.array([3, 4, 5, 10, 0])
    each = [np.exp(model.log_probabilities(np.r_[classes[:k], c], np.zeros(k + 1, int))[-1]) for k in (0, 1, 4) for c in range(11)]
    assert np.allclose(np.array(each).reshape(3, 11).sum(1), 1, atol=1e-5)


def test_scores_are_the_models_probabilities(spark, monkeypatch):
    """Every score from the trained model's own tables, word by word."""
    models = []
    trained = language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a: models.append(trained(*a)) or models[-1])
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices([f"w{k}" for k in range(40)], range(40, 0, -1), k=rnd.randint(0, 60))) for _ in range(120)] + [None, "", "UNSEEN w1 w39"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.scores(df, F.col("doc_id") % 10 != 0, vocabulary=20, frequent=6, buckets=3).collect()}
    m, count = models[0], {}
    for k, t in enumerate(texts):
        for w in [*(t or "").lower().split(), "\n"] if k % 10 else []:
            count[w] = count.get(w, 0) + 1
    hashed = lambda w: common.word_hashes(*common.flat(pa.array([w])), language_model._TABLE)[0][0]
    place = dict(zip(m.vocabulary.tolist(), m.ids.tolist()))
    classes = {w: 0 if w == "\n" else place.get(int(hashed(w)), 1) for w in [*count, "unseen"]}
    assert sorted(c for c in classes.values() if c > 1) == list(range(2, 8))  # as many as travel to the tasks
    others = sum(n for w, n in count.items() if classes[w] == 1)
    types = sum(classes[w] == 1 for w in count)

    def soft(scores, k):
        e = np.exp(scores - scores.max())
        return math.log10(e[k] / e.sum())

    for k, t in enumerate(texts):
        total, before = 0.0, [0, 0]
        for w in [*(t or "").lower().split(), "\n"]:
            c = classes[w]
            q = sum(m.place[j] * m.context[before[j]] for j in range(2)).astype(float)
            q[-1] = 1
            total += soft(m.top.astype(float) @ q, c if c < 2 else 2 + (c - 2) // m.group)
            if c >= 2:
                g = (c - 2) // m.group * m.group
                total += soft(m.word[g : g + m.group].astype(float) @ q, c - 2 - g)
            if c == 1:
                total += math.log10((count.get(w, 0) + 0.1) / (others + 0.1 * (types + 1)))
            before = [c, before[0]]
        assert abs(total - got[k]) < 1e-3, (k, total, got[k])


def test_the_model_does_not_depend_on_the_split_of_its_input(spark, monkeypatch):
    monkeypatch.setattr(language_model, "TOKENS", 3000)
    rnd = random.Random(7)
    rows = [(k, " ".join(f"w{rnd.randint(0, 30) ** 2}" for _ in range(rnd.randint(0, 200)))) for k in range(200)]
    rows += [(500 + k, rows[3][1]) for k in range(20)]
    run = lambda df: {r.doc_id: r.score for r in language_model.scores(df, F.col("doc_id") % 10 != 0, buckets=4).collect()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = run(df.coalesce(1)), run(df.orderBy(F.desc("doc_id")).repartition(7))
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) / abs(one[k]) for k in one) < 1e-6  # single precision, in other batches


def test_held_out_texts_score_above_the_base(spark):
    """The registered query on the larger table."""
    r = queries.op9_language_model(spark, SF.replace("0.01", "0.1")).where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.a > r.b + 0.3 * r.n


# --- shared helpers ----------------------------------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    names = rnd.sample(range(1000), 120)
    edges = list(zip(names[:50], names[1:50])) + [(names[60], x) for x in names[61:90]] + [(names[95], names[95])]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(names[:50]) for x in names[:50]} | {x: min(names[60:90]) for x in names[60:90]}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_are_words():
    column = pa.array(["a b", None, "", "\x00 é b\ta", "a"])
    hashes, row, start, end = common.word_hashes(*common.flat(column), common.byte_table(common.SPACES, lower=True))
    assert row.tolist() == [0, 0, 3, 3, 3, 3, 4] and hashes[0] == hashes[5] == hashes[6] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4
    part = column.slice(3, 2)
    assert common.word_hashes(*common.flat(part), common.byte_table(common.SPACES, lower=True))[0].tolist() == hashes[2:].tolist()


def test_words_that_polynomials_confuse_are_told_apart():
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    hashes, row = language_model.words(pa.array([one, other, one]))
    assert row.tolist() == [0, 0, 1, 1, 2, 2] and hashes[0] == hashes[4] != hashes[2]
    tokens = toxicity.Tokens(pa.array([one[:700], other[:700]]))
    assert tokens.words[0] != tokens.words[1]


def test_components_of_rising_chains_take_few_rounds(spark, monkeypatch):
    """Ids that rise along a chain of 300: rounds follow the logarithm of its length."""
    stored = []
    monkeypatch.setattr(common, "cut", lambda df, cut=common.cut: stored.append(1) or cut(df))
    got = {r.node: r.root for r in common.components(spark.range(299).selectExpr("id AS a", "id + 1 AS b")).collect()}
    assert got == dict.fromkeys(range(300), 0) and len(stored) < 40


def test_contexts_that_repeat_are_scored_once(monkeypatch):
    rnd = np.random.default_rng(5)
    model = language_model.LogBilinear(np.arange(40, dtype=np.uint64) * np.uint64(77), np.arange(42) + 1.0, size=5, group=8)
    model.top[:, :-1] += rnd.normal(0, 1, (len(model.top), 5))
    classes, row = np.minimum(rnd.geometric(0.3, 3000) - 1, 41), np.repeat(np.arange(30), 100)
    context, outcome = model.contexts(classes, row), model.outcomes(classes)
    q, want = model.predict(context).astype(float), []
    for vector, c, o in zip(q, classes, outcome, strict=True):
        share = np.exp(vector @ model.top.T)
        want.append(np.log(share[o] / share.sum()))
        if o >= 2:
            share = np.exp(vector @ model.word[8 * (o - 2) : 8 * (o - 1)].T)
            want[-1] += np.log(share[(c - 2) % 8] / share.sum())
    predicted, seen = model.predict, []
    monkeypatch.setattr(model, "predict", lambda context: seen.append(context.shape[1]) or predicted(context))
    assert np.allclose(model.log_probabilities(classes, row), want, atol=1e-4)
    assert sum(seen) == len({tuple(c) for c in context.T}) < 1500


def test_sums_of_rows_by_index():
    rnd = np.random.default_rng(6)
    for n, top in ((1, 1), (50, 50), (3000, 90), (5000, 40_000), (40_000, 3)):
        index, rows, times = rnd.integers(0, top, n), rnd.normal(size=(n, 4)).astype(np.float32), rnd.normal(size=n).astype(np.float32)
        of = rnd.permutation(n)
        for more, each in (((), rows), ((of, times), rows[of] * times[:, None])):
            keys, sums, count = language_model._by(index, rows, *more)
            want = np.zeros((top, 4))
            np.add.at(want, index, each)
            assert sorted(keys) == sorted(set(index.tolist())) and np.allclose(sums, want[keys], atol=1e-2)
            assert (count == np.bincount(index, minlength=top)[keys]).all()


def test_texts_are_numbered_once_for_learning_and_scoring(spark):
    """A text to learn from is read to count its words, to count texts, and to number its words."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.column(0).to_pylist().count(1))
            yield batch

    schema = "doc_id long, text string"
    df = spark.createDataFrame([(k, "a b a c") for k in range(20)], schema).mapInArrow(seen, schema)
    got = language_model.scores(df, F.col("doc_id") % 10 != 0, buckets=2).collect()
    assert len(got) == 20 and read.value == 3


def test_packs_of_many_slices(spark, monkeypatch):
    """Texts get their own sums, however they are cut into slices, packs and parts that are scored."""
    rnd = random.Random(8)
    texts = [" ".join(f"w{min(int(rnd.expovariate(0.02)), 300)}" for _ in range(rnd.randint(0, 40))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    run = lambda: {r.doc_id: r[1:] for r in language_model.scores(df, F.col("doc_id") % 10 != 0, frequent=20, buckets=3).collect()}
    want = run()
    monkeypatch.setattr(language_model, "PACK", 3)
    monkeypatch.setattr(language_model, "SCORED", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() == set(range(302))
    assert all(g[:3] == w[:3] and np.allclose(g[3:], w[3:], rtol=1e-5) for g, w in ((got[k], want[k]) for k in got))


def test_hashes_are_looked_up():
    rnd = np.random.default_rng(9)
    for n in (0, 1, 2, 1000):
        near = np.r_[np.arange(n, dtype=np.uint64), rnd.integers(0, 1 << 63, n, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(n, dtype=np.uint64)]
        known = np.unique(near[rnd.random(len(near)) < 0.6])
        asked = np.r_[near, rnd.integers(0, 1 << 63, 50, dtype=np.uint64), known, np.array([0, 2**64 - 1], np.uint64)]
        want = {int(x): k for k, x in enumerate(known)}
        assert language_model.Lookup(known)(asked).tolist() == [want.get(int(x), -1) for x in asked]
