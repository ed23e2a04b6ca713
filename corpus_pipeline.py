"""Training-corpus pipeline: toxicity, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes every stage's result below ``spark.checkpoint.dir`` and gives what it
reads back to the next one. All stages but the last return the columns of
``documents``.

1. toxicity: documents scored 0.5 or more go.
2. exact dedup: of equal texts the row with the largest id stays.
3. SimHash near-dedup: of each component (3-word shingles, at most 3 differing
   bits) the document with the smallest id stays.
4. mixing: documents are repeated or left out so that each source gives its
   target, in training order; a source's last copy stays whole, so a target is
   exceeded by less than one document.
5. tokens: per copy its place in training order, id, source, ids (packed
   little-endian) and their number. ``place`` is (task, file, row) of the
   mixing stage's sorted files: sorting by it restores the training order.

Defined cases are those of the operators; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, exact, mixing, runtime, simhash, toxicity
from flowlens.llm.queries import labels, word_tokenizer_path

# Models, shared statistics and hash orders decide the rows: no SQL for them.
ORACLE_SQL = None


ARROW_ROWS = 128  # rows of one Arrow batch: a worker holds several stages' models at once
ROW_GROUP = 16 << 20  # bytes that a Parquet writer gathers; whole texts are written after every stage


def prepare(spark: SparkSession) -> SparkSession:
    runtime.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("parquet.block.size", str(ROW_GROUP))
    # Shuffle files go when their query ends: stages hand over written tables, so nothing reads them again.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")  # scratch tables hold whole texts
    return spark


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.drop_toxic(docs, labels(spark, sf_dir), threshold=0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, tau=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix_documents(docs, whole_copies=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    tok = bpe.Tokenizer(spark, word_tokenizer_path())
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("long")
    place = F.struct(number(r"^part-(\d+)").alias("task"), number(r"-c(\d+)\.").alias("file"), F.col("_metadata.row_index").alias("row"))
    out = docs.select(place.alias("place"), "doc_id", "source", tok.encode(runtime.text_or_empty()).alias("ids"))
    out = out.withColumn("n_tokens", bpe.n_tokens(F.col("ids")))
    return out.withColumn("decoded_sha256", F.sha2(tok.decode("ids").cast("binary"), 256))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    scratch = runtime.Scratch(spark, "pipeline")
    docs = runtime.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
