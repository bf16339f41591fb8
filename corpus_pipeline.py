"""A pipeline over ``documents``: stages that each take what the one before kept.

Each stage is a name and a function of (spark, docs, sf_dir) that returns a DataFrame; between
stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.decontaminate import find_benchmark
from tallyhouse.llm.language_id import predict_language, train_language_model
from tallyhouse.llm.line_dedup import dedup_lines
from tallyhouse.llm.mixing import mix_sources
from tallyhouse.llm.ngram_join import ngram_jaccard_join
from tallyhouse.llm.queries import crc_mod, ship_package, table
from tallyhouse.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose language is surer than this stay; it is close to the floor of the score, so in practice only "und" goes.
LEAST_SCORE = 0.3


#: Bytes of a batch of rows that goes to a Python worker, at most.
MOST_BATCH = 8 << 20


def _bounded(spark: SparkSession) -> None:
    """A worker, and the JVM beside it, hold so much of a table at once, and one row at least, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", MOST_BATCH)


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and those without a letter go; a text in a language that wasn't learned is taken for one that was."""
    ship_package(spark)
    _bounded(spark)
    model = train_language_model(docs.where(crc_mod("doc_id", 4) != 2))
    told = predict_language(docs.select(*COLUMNS), model)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go, and documents of which nothing is left."""
    kept = dedup_lines(docs.select(*COLUMNS), least_words=1)
    return _documents(kept.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents stays."""
    _bounded(spark)
    found = ngram_jaccard_join(docs).where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id")))
    # the join reads its own Parquet, so rows are matched by id; a row without id can't be a copy
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    _bounded(spark)
    benchmark = table(spark, sf_dir, "benchmark")
    hit = find_benchmark(docs, benchmark).where(F.size("spans") > 0).select("doc_id").distinct()
    # rows without id match no id; the few of them are numbered
    loose = written(docs.where("doc_id is null").withColumn("_row", F.monotonically_increasing_id()), "loose")
    loose_hit = find_benchmark(loose, benchmark, id_col="_row").where(F.size("spans") > 0).select("_row")
    named = docs.where("doc_id is not null").join(hit, "doc_id", "left_anti").select(*COLUMNS)
    return named.unionByName(loose.join(loose_hit, "_row", "left_anti").select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix_sources(docs)


STAGES = [("language id", language), ("line dedup", lines), ("n-gram join", near_copies), ("decontamination", benchmark_free), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Naive Bayes can't be told in SQL.  In the tests language ID is held to op6, mixing to OP3_SQL, the other stages to brute force.
ORACLE_SQL = None
