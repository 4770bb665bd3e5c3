import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cellcast.llm import pieces, token_counts

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a", "  a  b ", "▁", "a▁▁b ▁", "x\n\n y\t", "ﬁ Å é", "<s> </s> <0x41>", "　a", "\x00 b", "🙂 🙂", "<|endoftext|>", "A<|endoftext|> b<|ENDOFTEXT|>", "don't I'LL 123,4", "é ́x", "ΟΔΟΣ", "w" * 3000]


def texts():
    rnd = random.Random(2)
    alphabet = list("abc ABC  \n\t.'▁é1<|>") + ["the ", " of", "🙂"]
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(200)] + [None, "same", "same"]


def test_pieces_match_the_library(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id")]
    got = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, keep_ids=True).collect()}
    assert len(got) == len(rows)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in rows:
        ids = model.encode(t or "")
        back = model.decode(ids)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (ids, len(ids), back), t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_a_small_table_gives_the_same_ids():
    small, model = pieces.Pieces(MODEL, table=3), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = [t or "" for t in texts()]
    assert [i for t in some for i in small.encode([t])] == [model.encode(t) for t in some]
    assert small.decode([model.encode("a b")]) == ["a b"]


@pytest.mark.parametrize("path", [WORDS, MODEL, public_tokenizers.path("byte_bpe_50k.json")])
def test_counts_match_the_library(spark, path, tmp_path):
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(None, "null id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = {i: len(model.encode(t or "")) for i, t, _ in rows}
    else:
        model = Tokenizer.from_file(path)
        want = {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows}
    cache = str(tmp_path / "cache")
    first = token_counts.token_counts(df, path, cache, limit=100).collect()
    assert {r.doc_id: r.n_tokens for r in first} == want and len(first) == len(rows)
    assert {r.doc_id: r.n_bytes for r in first} == {i: len((t or "").encode()) for i, t, _ in rows}
    assert all(r.over_limit == (r.n_tokens > 100) for r in first)
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count() == len({t or "" for _, t, _ in rows})
    again = token_counts.token_counts(df.union(spark.createDataFrame([(999, "new text", 0)], df.schema)), path, cache, limit=100)
    assert {r.doc_id: r.n_tokens for r in again.collect() if r.doc_id != 999} == want
    assert spark.read.parquet(cache).count() == n + 1


def test_a_full_cache_encodes_nothing(spark, tmp_path, monkeypatch):
    """A very common text among others; the second run finds all counts and writes nothing."""
    monkeypatch.setattr(token_counts, "COMMON", 20)
    rows = [(i, f"text {i} of many" if i % 3 else "the same text") for i in range(150)] + [(None, None), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model, cache = Tokenizer.from_file(WORDS), str(tmp_path / "cache")
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    files = []
    for _ in range(2):
        got = token_counts.token_counts(df, WORDS, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        files.append(sorted(x.name for x in (tmp_path / "cache").iterdir()))
    assert files[0] == files[1]


def test_a_model_that_changes_texts_is_refused():
    class Changing:
        vocab_size = lambda self: 0
        normalize = lambda self, text: "▁" + " ".join(text.split()).replace(" ", "▁")

    original = sentencepiece.SentencePieceProcessor
    try:
        sentencepiece.SentencePieceProcessor = lambda model_file: Changing()
        with pytest.raises(ValueError, match="normalisation"):
            pieces.Pieces(MODEL)
    finally:
        sentencepiece.SentencePieceProcessor = original


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(none, MODEL).count() == 0
    assert token_counts.token_counts(none, WORDS).count() == 0


def test_tokenizers_that_keep_white_space_count_whole_texts(tmp_path):
    """A small tokenizer with each kind of splitter, normaliser and added token: counts are always the library's."""
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

    from cellcast.llm import token_counts

    letters = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz \n'!?")}
    texts = ["a  b", "ab \n c", "", "  a b  ", "it's  a!", "a\n\n\nb ? c", None, "hello  world \n"]
    words = r"'s|[\p{L}]+|[^\s\p{L}]+"
    cases = [(words, None, None, True), (words + r"|\s+(?!\S)|\s+", None, None, False), (r"[^\s]+|.", None, None, False), (r" ?[\p{L}]+|[^\s\p{L}]+", None, None, False), (r"\S+", None, None, False), (r"[^a]+|[^\s]", None, None, False)]
    cases += [(words, normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]), None, True), (words, normalizers.Replace(" ", "a"), None, False), (words, normalizers.Strip(), None, False), (words, None, "a b", False)]
    for k, (pattern, normalizer, token, apart) in enumerate(cases):
        model = Tokenizer(models.BPE(letters, []))
        model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "removed", invert=True)])
        if normalizer is not None:
            model.normalizer = normalizer
        if token:
            model.add_tokens([AddedToken(token)])
        model.enable_truncation(2)
        path = str(tmp_path / f"{k}.json")
        model.save(path)
        model.no_truncation()
        found = token_counts.counter(path)
        assert isinstance(found, token_counts.WordCounter) == apart, pattern
        assert found.count(pa.array(texts, pa.string())).tolist() == [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts], pattern
    assert isinstance(token_counts.counter(public_tokenizers.path("word_bpe_49k.json")), token_counts.WordCounter)
