"""From documents to packed training sequences, in five stages.

Each stage reads what the one before kept, and its decisions take effect: documents
without a language go, one document of each group of near copies stays, repeated
passages are cut out of texts, sources are mixed (a document may be taken more than
once or not at all), and what is left is packed. Extra columns are dropped, whatever
their names, and an empty table gives an empty result, at every stage. What null ids,
repeated rows, null and empty texts and ties give is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm import jaccard, language, mixing, packing, suffixes
from kinmap.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose best language is less likely than this are rejected.
LEAST_SCORE = 0.35


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language.

    Null texts and texts without a letter have none and go. Rows are judged one by
    one, so repeated ones stay or go together, and rows without an id as others. Of
    languages with equal scores the first by code point counts.
    """
    docs = docs.select(*COLUMNS)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component of near copies.

    Texts that are null or have no words are near to none and stay. Rows without an
    id go. Of rows that share an id one stays, the largest by text and the others.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard.jaccard_components(docs)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi")
    rest = [c for c in COLUMNS if c != "doc_id"]
    return kept.groupBy("doc_id").agg(F.max(F.struct(*rest)).alias("row")).select("doc_id", "row.*").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids hold; what is cut to nothing goes.

    Texts that were null or empty stay as empty ones, n_chars is counted anew, and a
    character of which some bytes are cut goes as a whole. Rows without an id go; rows
    that share one do not cut each other.
    """
    kept = suffixes.dedup(docs.select(*COLUMNS), with_text=True, carry=("lang", "source"))
    kept = kept.where((F.col("kept") != "") | (F.col("n_bytes") == 0))
    n_chars = F.length("kept").cast("long").alias("n_chars")
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most.

    A null source is one of its own. Documents without words cost the mix nothing and
    go with what stands around them in their source's order; a source that has no
    words at all is not served. Rows that agree in id, source and size share what is
    served to them. Ties in virtual time go by the hash of the id, then the id.
    """
    docs = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    _, kept = mixing.served(docs.select("doc_id", "source", "size"))
    taken = kept.groupBy("doc_id", "source", "size").agg(F.collect_list("time").alias("times")).toDF("t_id", "t_source", "t_size", "times")
    same = (
        F.col("doc_id").eqNullSafe(F.col("t_id"))
        & F.col("source").eqNullSafe(F.col("t_source"))
        & (F.col("size") == F.col("t_size"))
    )
    # Rows that agree in all of it share what was served to them; documents without words cost the mix nothing.
    rows = docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).toDF("r_id", "r_source", "r_size", "rows")
    rows = rows.where("rows > 1")
    again = F.col("t_id").eqNullSafe(F.col("r_id")) & F.col("t_source").eqNullSafe(F.col("r_source")) & (F.col("t_size") == F.col("r_size"))
    taken = taken.join(rows, again, "left")
    share = F.slice("times", F.lit(1), F.ceil(F.size("times") / F.coalesce("rows", F.lit(1))).cast("int"))
    return docs.join(taken.withColumn("time", F.explode(share)), same).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets.

    Every row is packed, repeated ones and those without an id too; a null or empty
    text is one piece with the end id alone. Pieces of equal length go by hash.
    """
    return packing.best_fit_pack(docs)


STAGES = [
    ("language_id", keep_languages),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Hashes, a trained model and a tokenizer are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
