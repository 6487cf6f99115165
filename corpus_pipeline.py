"""The corpus pipeline: quality, language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

A document is a row; doc_id need not tell rows apart. Where a stage finds rows by key (near duplicates, leaks), the key is
(doc_id, checksum of the text), so rows of one id and other texts are other documents. Rows of one id and one text are one
document, repeated. Defined cases: null or empty texts, and texts without letters, are rejected by the first stages;
documents with a null doc_id are documents like others; ties between near duplicates go to the smallest key; very
long texts are read whole; extra columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ridgeline.llm import decontamination, language_id, ngram_join, packing, quality
from ridgeline.llm._ids import without
from ridgeline.llm._store import Scratch, small_batches
from ridgeline.llm.queries import tokenizer_path

#: A document whose language is surer than this stays; texts without letters go.
LANGUAGE_SCORE = 0.5


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each document, and the key's name, which no column of docs has."""
    name = "document"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    return docs.withColumn(name, F.struct(F.col("doc_id"), F.xxhash64("text").alias("text"))), name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts: row by row, so repeated rows stay or go together. A null, empty or
    wordless text goes; a text at the threshold stays; an empty table stays empty."""
    small_batches(spark)
    return docs.where(quality.learn(docs)(F.col("text"))["quality"] >= quality.THRESHOLD)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language: row by row, whatever lang says. Texts without letters go; where no
    row names its language nothing is known, and all go; an empty table stays empty."""
    small_batches(spark)
    found = language_id.predictor(spark, language_id.train(docs))(F.col("text"))
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= LANGUAGE_SCORE))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), once: that of the smallest doc_id (null before
    all others), and of its texts the one of the smallest checksum. Of rows that repeat a document the smallest by the
    other columns that have an order stays. Documents without words are in no group."""
    work = Scratch(spark, "pipeline-join")
    keyed, key = _keyed(docs)
    linked = work.put("linked", ngram_join.link(keyed, k=5, percent=80, key=key))
    dropped = work.put("dropped", linked.where(F.col(key) != F.col("component_id")).select(key).distinct())
    repeated = work.put("repeated", linked.where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    kept = without(keyed, dropped, key)
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    ordered = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    rows = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("row"))
    return without(kept, repeated, key).select(*docs.columns).unionByName(rows.select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Documents without words stay; so do all where the benchmark
    is empty; repeated rows stay or go together."""
    keyed, key = _keyed(docs)
    found = decontamination.find(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
    leaks = Scratch(spark, "pipeline-leaks").put("leaks", found.where(F.size("items") > 0).select(key).distinct())
    return without(keyed, leaks, key).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences: every document's ids, each once, cut freely; a text without ids has its end id."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_identification),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Trained models and a tokenizer decide: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each but the last is written and read again."""
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
