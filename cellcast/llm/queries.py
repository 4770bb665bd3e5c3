"""The queries op1 to op13: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, fertility, fm_index, language_model, lexical, permutation_index, pieces, runs, simhash, substrings, token_counts, toxicity, urls

#: URL rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A conversation whose texts hold control strings.
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return found.select(*columns) if columns else found


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages", "page_id", "url")
    host, path = urls.parts("url")
    _, decided = urls.ruled(RULES, host, path)
    labelled = pages.select("url", F.when(decided == "block", 1).when(decided == "allow", 0).alias("label"))
    return urls.verdicts(pages, RULES, urls.train(labelled))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels")
    part = common.crc() % 3
    model = toxicity.train(docs, labels, learn=part != 1)
    return toxicity.score(docs, model).select("doc_id", (part == 1).alias("held_out"), "score", "predicted")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", ODD_TEXT), (-1, 1, "assistant", ODD_TEXT)], turns.schema)
    path = tokenizer("byte_bpe_50k.json")
    return chat.read_back(chat.format_turns(turns.unionByName(odd), path), path).withColumnRenamed("conv", "conv_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = common.crc() % 10
    found = language_model.scores(_read(spark, sf_dir, "documents", "doc_id", "text"), learn=part != 0)
    return found.select("doc_id", (part == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return fm_index.decontaminate(docs, _read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


#: A document's words w with the tail from a on made periodic; the one-element array binds the words once.
_TAILED = r"""transform(array(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)), w -> array_join(transform(sequence(0, size(w) - 1), i ->
  w[CAST(if(i < g % size(w), i, g % size(w) + (i - g % size(w)) % (1 + (size(w) - g % size(w)) div (3 + g % 8))) AS INT)]), ' '))[0]"""


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text").withColumn("g", F.floor(common.crc() / 10))
    tailed = F.when((common.crc() % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.expr(_TAILED)).otherwise(F.col("text"))
    found = runs.collapse(docs.select("doc_id", tailed.alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), "^ | $", "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("l"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(spaced.cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("l.start")).alias("start"), F.col("l.length").alias("length"), (-F.col("l.period")).alias("period"), F.expr("(1000 * l.length) div -l.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = fertility.quality(docs, tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_50k.tiktoken"), language="lang")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason", "chars_per_piece", "chars_per_byte_token", "byte_share", "entropy")


_ALL = (op1_simhash, op2_substrings, op3_urls, op4_toxicity, op5_neighbours, op6_chat, op7_sentencepiece, op8_token_counts, op9_language_model, op10_decontamination, op11_lexical, op12_runs, op13_quality)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
# CRC-32 of the id's decimal text, bit by bit: a byte comes in with the first of its eight steps (zlib's polynomial)
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
_ESCAPED = r"regexp_replace(coalesce({}, ''), '<(\\*)\|', '<\\\1|', 'g')"

SQL: dict[str, str] = {
    "op2_substrings": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d),
v AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS low FROM v GROUP BY h),
r AS (SELECT DISTINCT v.doc_id, unnest(range(k, k + 50)) AS place FROM v JOIN f USING (h) WHERE v.doc_id > f.low),
g AS (SELECT doc_id, list(place) AS gone, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE (SELECT string_agg(w[i], ' ' ORDER BY i) FROM unnest(range(1, len(w) + 1)) t(i) WHERE NOT list_contains(gone, i)) END, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
    "op6_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{ODD_TEXT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + {sum(map(len, chat.CONTROLS))})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS h FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM n)),
s AS (SELECT DISTINCT size FROM q),
v AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS h FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, s WHERE len(w) >= size)),
m AS (SELECT v.doc_id, v.k, v.size, q.item_id FROM v JOIN q USING (size, h)),
x AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS place FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op11_lexical": f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) AS term FROM documents),
s AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM t), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS impact FROM p JOIN w USING (term) JOIN n USING (doc_id), s),
r AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING score > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r) WHERE rank <= 10""",
    # words, with the planted tails; pairs of equal words d apart; stretches of such pairs as long as d; of equal stretches the smallest d
    "op12_runs": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS v, {_CRC} AS h FROM documents),
g AS (SELECT doc_id, v, h, len(v) AS n, CASE WHEN len(v) > 0 THEN h // 10 % len(v) END AS a, CASE WHEN len(v) > 0 THEN 1 + (len(v) - h // 10 % len(v)) // (3 + h // 10 % 8) END AS p FROM d),
w AS MATERIALIZED (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: v[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE v END AS w FROM g),
o AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
s AS (SELECT doc_id, d, min(i) AS start, count(*) + d AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS k FROM e) GROUP BY doc_id, d, k HAVING count(*) >= d AND count(*) + d >= 12),
r AS MATERIALIZED (SELECT doc_id, start, length, min(d) AS period FROM s GROUP BY doc_id, start, length),
x AS (SELECT doc_id, list(DISTINCT place) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS place FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, first({{start: start, length: length, period: period}} ORDER BY length DESC, start, period) AS l FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, l.start::BIGINT AS start, l.length::BIGINT AS length, l.period::BIGINT AS period, (1000 * l.length // l.period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(w[i + 1], ' ' ORDER BY i) FROM unnest(range(len(w))) t(i) WHERE NOT list_contains(gone, i)), '') END) AS collapsed_sha256
FROM w LEFT JOIN m USING (doc_id) LEFT JOIN x USING (doc_id)""",
}
