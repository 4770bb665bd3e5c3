"""A corpus cleaning pipeline from the operators of cellcast.llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import common, fm_index, near_copies, pieces, queries, substrings, toxicity

#: What SQL can't say: hashes of shingles, trained models and a tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, trained on all labelled ones, doesn't reject.

    The model sees id and text only, under names of its own, so no column of the documents can stand for its verdict.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.col("doc_id"), F.col("text"), F.struct(*_all(docs)).alias("row"))
    return toxicity.score(rows, model).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document with the smallest id, and documents without an id.

    Near-duplicates have five-word shingles of a Jaccard similarity of 0.8 or more, or are linked by such texts. Where an
    id repeats, each of its texts is judged by its own shingles: a text that nothing duplicates stays.
    """
    found = common.cut(near_copies.near_copies(docs))
    repeats = common.cut(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    gone = common.cut(found.where("doc_id > component_id").select("doc_id").distinct())
    some, others = common.sifted(docs, "doc_id", gone)
    kept = some.join(gone, "doc_id", "left_anti").select(*_all(docs)).unionByName(others)
    if repeats.isEmpty():
        return kept.select(*_all(docs))
    single = kept.join(repeats, "doc_id", "left_anti").select(*_all(docs))
    odd = common.cut(docs.join(repeats, "doc_id", "left_semi").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text"), F.struct(*_all(docs)).alias("doc")))
    prints = near_copies.sketches(odd.select("row", "text"), "row", "text").select(F.col("id").alias("row"), "sig")
    named = odd.select("row", F.col("doc_id").cast("long").alias("doc_id")).join(prints, "row").join(found.select("doc_id", "sig", "component_id").distinct(), ["doc_id", "sig"])
    first = named.where("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("row")).select("row")
    return single.unionByName(odd.join(first, "row", "left_semi").select("doc.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more that an earlier one has."""
    return _measured(substrings.deduplicate(docs), docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that lie in passages of the benchmark."""
    return _measured(fm_index.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids and what they decode to, by doc_id; other columns end here."""
    return pieces.encode(docs, queries.tokenizer("piece_bpe_32k.model"), keep_ids=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


def _all(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _measured(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` from `found`; a column n_chars follows the new text."""
    kept = found.select(*_all(docs))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each one's rows stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
