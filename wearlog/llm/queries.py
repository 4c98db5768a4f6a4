"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearlog.llm import (
    embedding_dedup,
    language_id,
    language_model,
    mixing,
    packing,
    periodic_runs,
    quality_rules,
    secrets,
    sharding,
    simhash,
    spelling_variants,
    url_filter,
)
from wearlog.llm.ngram_join import ngram_join
from wearlog.sources.storage import materialised


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(divisor: int) -> Column:
    """Remainder of crc32(doc_id as text); null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3; at most three times a source."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from six of seven folds."""
    docs = _table(spark, sf_dir, "documents")
    return language_model.train_and_score(docs, learn=_fold(7) != 2, held_out=_fold(7) == 2)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine 0.98 or more within a label."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_near(materialised(simhash.with_next(_table(spark, sf_dir, "documents")), "fingerprints"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    import public_tokenizers

    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from two of three folds."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs, _fold(3) != 1)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    return ngram_join(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line may be in ten documents of a source; half the words must be left."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def _tail_repeated(docs: DataFrame) -> DataFrame:
    """Documents of a tenth of all ids with a periodic tail, the others as they are; a null id is not edited."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({quality_rules.WORD})"), 1))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    n, a, g = F.size("words"), F.col("a"), F.col("g")
    start = split.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    cut = start.withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    p = F.col("p")
    edited = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p)))
    return cut.select("doc_id", F.when(n > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of twelve words or more."""
    found = periodic_runs.with_runs(_tail_repeated(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    best = found.select("doc_id", "runs", "collapsed", longest.alias("best"))
    length, start, period = F.col("best.length"), -F.col("best.col2"), -F.col("best.col3")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters or more that occur five times, one run in 199 with a letter missing; a null id is empty."""
    runs = spelling_variants.runs_of_letters(_table(spark, sf_dir, "documents"), "doc_id")
    word, size = F.col("word"), F.length("word")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % size).cast("int")
    edited = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, size))
    words = runs.select(F.when(h % 199 == 0, edited).otherwise(word).alias("word"))
    return spelling_variants.group_variants(spelling_variants.count_words(words))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_source_mixing": op2_source_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_language_id": op9_language_id,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_quality_rules": op11_quality_rules,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

#: DuckDB SQL where SQL can express a query and is quick enough on whole tables.
ORACLE: dict[str, str] = {
    "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
reached(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON e.vec_id = p.vec_id LEFT JOIN degree d ON e.vec_id = d.vec_id
""",
    "op10_ngram_jaccard_join": """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w
  FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM worded WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
reached(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, p.component_id
FROM documents d JOIN parts p ON d.doc_id = p.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
""",
    "op11_quality_rules": """
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t-\\r]+') AS w FROM texts),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM worded WHERE len(w) > 2),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, text, line, trim(regexp_replace(translate(
    line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[ \\t-\\r]+', ' ', 'g')) AS norm
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^ \\t-\\r]')),
copied AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
frequent AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT text) > 10),
removed AS (
  SELECT l.doc_id, sum(len(string_split(l.norm, ' '))) AS n FROM lines l
  JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY l.doc_id),
measured AS (
  SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
    length(w.text) - length(translate(w.text, '#*$%&|<>', '')) AS n_symbols, coalesce(c.n, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS n_removed_words
  FROM worded w LEFT JOIN copied c ON w.doc_id = c.doc_id LEFT JOIN repeated r ON w.doc_id = r.doc_id
  LEFT JOIN removed x ON w.doc_id = x.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_removed_words > 50 * n_words) AS kept
FROM measured
""",
}
