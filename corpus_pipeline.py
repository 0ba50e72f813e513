"""The training-data pipeline: from documents to packed sequences."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, stored
from quillon.llm.decontamination import without_items
from quillon.llm.language_id import UNKNOWN, held_out, learn, predict
from quillon.llm.line_dedup import remove_repeated_lines
from quillon.llm.near_dedup import one_of_similar
from quillon.llm.packing import pack_documents
from quillon.llm.tokens import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null texts and texts without letters go, all others stay. A missing lang becomes the predicted one."""
    labelled = predict(docs.select(*COLUMNS), learn(docs.where(~held_out())))
    return labelled.where(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before; documents of which nothing but white space is left go. n_chars counts the new text."""
    out = remove_repeated_lines(docs, keep=("lang", "source"), exact=1)
    return out.where(F.col("text").rlike(r"\S") | (F.col("n_removed") == 0)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more. Candidates share a block of their SimHash fingerprints or a shingle."""
    return one_of_similar(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, each judged by its own text, whatever its id."""
    return without_items(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: the ids of each piece, its sequence and its place there."""
    return pack_documents(docs, vocabulary_path(), keep_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: No SQL: tokens, edit distances and fingerprints are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        docs, now = stage(spark, docs, sf_dir), []
        if k + 1 < len(STAGES):
            docs = stored(docs, name, now)
        discard(spark, before)  # the stage before has been read in whole: the last one, too, has written its pieces
        before = now
    return docs
