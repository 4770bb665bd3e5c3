import hashlib
import random
import sys
from pathlib import Path

import public_tokenizers
import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from cellcast.llm import toxicity
from test_fm_index import slow as slow_decontamination
from test_near_copies import slow_named
from test_substrings import slow as slow_substrings

BAD = ["idiot", "moron", "scum"]


def test_stages_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "en")]
    draw = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, item = draw(70), draw(14)
    rows = []
    for k in range(240):
        own = draw(rnd.randint(60, 200))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(5):
                own.insert(rnd.randint(0, len(own)), rnd.choice(BAD))
        if k % 7 == 1:
            own = own[:20] + passage + own[20:]
        if k % 11 == 2:
            own = own[:9] + item + own[9:]
        rows.append([k, " ".join(own), "en", "s", 0, int(toxic)])
    for k in range(240, 260):
        rows.append([k, rows[k - 200][1] + (" more" if k % 2 else ""), "en", "s", 0, rows[k - 200][5]])
    rows += [[300, "", "en", "s", 0, 0], [301, None, None, None, None, 0], [302, "one", "en", "s", 0, 0]]
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(5, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert k == 4 or docs.schema.simpleString() == before.schema.simpleString()
        tables.append([tuple(r) for r in docs.orderBy("doc_id").collect()])
    clean = {r[0] for r in rows if not r[5]}
    assert {r[0] for r in tables[0]} == clean
    assert {r[0] for r in tables[1]} == {i for i, low in slow_named([(r[0], r[1]) for r in tables[0]]) if i == low}
    texts = {r[0]: r[1] for r in tables[1]}
    digest = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    assert sorted((i, h) for i, _, _, h in slow_substrings(list(texts.items()), 50)) == sorted((r[0], digest(r[1])) for r in tables[2])
    assert sum(n for _, _, n, _ in slow_substrings(list(texts.items()), 50)) > 0
    found = {i: (n, h) for i, n, h, *_ in slow_decontamination([(r[0], r[1]) for r in tables[2]], [(5, " ".join(item))])}
    assert sum(h for _, h in found.values()) > 0
    assert all(len((r[1] or "").split()) == found[r[0]][0] - found[r[0]][1] for r in tables[3])
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in tables[3])
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [(r[0], r[4]) for r in tables[4]] == [(r[0], model.encode(r[1] or "")) for r in tables[3]]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(tables[4])


def test_each_text_is_scored_once_and_clashing_columns_decide_nothing(spark, tmp_path, monkeypatch):
    """Documents that bring columns named like results, and names with dots; repeated and missing ids."""
    scored, score = spark.sparkContext.accumulator(0), toxicity.score

    def counted(docs, model, **more):
        def count(batches):
            for batch in batches:
                scored.add(batch.num_rows)
                yield batch

        return score(docs.mapInArrow(count, docs.schema), model, **more)

    monkeypatch.setattr(toxicity, "score", counted)
    plain = ["a fine day", "the day is fine", "trees and stones", "rivers of stone"]
    names = ["doc_id", "text", "predicted", "score", "fp", "n_removed", "items", "a.b", "i", "t", "r"]
    rows = [(k if k % 9 else None, f"{plain[k % 4]} {k * k} {'idiot moron scum' if k % 5 == 0 else ''} n{k} m{k * 7}", 1, "s", 1, 1, "x", k, 1, 1, 1) for k in range(1, 200)]
    spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, ["long", "string", "int", "string", "int", "int", "string", "int", "int", "int", "int"]))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int("idiot" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(5, "nothing of this")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert {r["a.b"] for r in kept} == {r[7] for r in rows if "idiot" not in r[1]} and kept[0].__fields__ == names
    done = scored.value
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)
    assert scored.value - done == len(rows)


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    rnd = random.Random(2)
    draw = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(120))
    x, y, z = draw(), draw(), draw()
    rows = [(3, x, "a"), (5, x, "b"), (5, y, "c"), (7, z, "d"), (7, z, "e"), (8, z, "f"), (None, x, "g"), (9, draw(), "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    kept = {r["row"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept in ({"a", "c", "d", "g", "h"}, {"a", "c", "e", "g", "h"})


def test_texts_without_near_copies_are_not_exchanged(spark, tmp_path):
    rnd = random.Random(8)
    draw = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(2000)]
    rows = [(k, " ".join(draw())) for k in range(300)]
    rows += [(k + 300, f"{rows[k][1]} more") for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    bridge = spark.sparkContext._jvm.java.util.ArrayList

    def exchanged():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(bridge(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), bridge())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    before, old = exchanged(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on tables too large to be sent to all tasks
        got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == list(range(300))
    sets = 4 * sum(len(t.split()) - 4 for _, t in rows)
    assert sum(n for k, n in exchanged().items() if k not in before) < sets / 2
