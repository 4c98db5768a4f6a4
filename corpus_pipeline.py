"""Training-data pipeline over the documents table.

Stages, in order: language identification drops the texts it rejects; one document of each group of
near duplicates stays; secrets are masked; the mix takes documents by its source targets; best-fit
packing places the tokens of what is left into sequences. Each stage works on all rows that the one
before it kept, is written as Parquet and read again; all but the last return the columns of documents.

Rules where the input leaves a choice:

* The language model learns from the labelled rows among its input.
* Of a group of near duplicates exactly one row stays: the one with the smallest doc_id (rows without
  an id come last), then with the smallest hash of its columns. Texts without words are in no group
  and all stay.
* A masked text has a new ``n_chars``; a null text stays null.
* The mix returns a row for each time a document is taken whole, and one more for the words that are
  taken beyond that, joined by single spaces. Documents of which nothing is taken are left out.
* A null text counts as empty everywhere. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearlog.llm import language_id, mixing, packing, secrets
from wearlog.llm.ngram_join import ngram_join
from wearlog.sources.storage import materialised

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the texts whose language cannot be told."""
    docs = docs.select(COLUMNS)
    model = language_id.learn(docs, F.col("doc_id").isNotNull())
    return language_id.identify(docs, model).where(~F.col("rejected")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of five-word-shingle similarity 0.8."""
    docs = docs.select(COLUMNS)
    # An order over rows that needs no numbering: rows that are equal in it are equal in all columns.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]).alias("mark"))
    keyed = docs.withColumn("_key", key)
    groups = ngram_join(keyed, doc_id="_key")
    first = groups.where((F.col("n_shingles") > 0) & (F.col("doc_id") == F.col("component_id")))
    first = first.select(F.col("doc_id.mark").alias("mark"), F.col("doc_id.doc_id").alias("kept_id")).distinct()
    kept = keyed.join(first, (F.col("_key.mark") == F.col("mark")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    wordless = ~F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    return kept.select(COLUMNS).dropDuplicates().unionByName(docs.where(wordless))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark."""
    docs = docs.select(COLUMNS)
    masked = secrets.redact(docs, secrets.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, whole or in part, by the targets of their sources."""
    docs = docs.select(COLUMNS)
    keyed = materialised(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    plan = mixing.mix(keyed, doc_id="_row").where("taken > 0").select(F.col("doc_id").alias("_row"), "whole", "blocks")
    mixed = keyed.join(plan, "_row")
    # An entry for each copy of the whole text, and one for the words taken beyond.
    copies = F.when(F.col("whole") > 0, F.sequence(F.lit(1), F.col("whole"))).otherwise(F.array().cast("array<bigint>"))
    more = F.when(F.size("blocks") > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    words = F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), 1)
    parts = F.flatten(F.transform("blocks", lambda b: F.slice(F.col("_words"), b["first"].cast("int") + 1, (b["behind"] - b["first"]).cast("int"))))
    rows = mixed.withColumn("_copy", F.explode(F.concat(copies, more)))
    whole = rows.where("_copy > 0").select(COLUMNS)
    part = rows.where("_copy = 0").withColumn("_words", words).withColumn("text", F.array_join(parts, " "))
    part = part.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(part.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all tokens into sequences of 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", keep_languages),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Classifier, inferred automata and tokeniser are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return docs
