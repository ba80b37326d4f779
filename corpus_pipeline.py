"""A training corpus from documents: toxicity, language, near duplicates, mixture, pieces.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
documents; the last adds the pieces. run() writes each stage's result as Parquet in the shared
folder and reads it again, so each stage starts from files and survives lost executors. Rows
are independent but in the third and fourth stage; an empty table gives an empty result, extra
columns travel along, and repeated rows are one document to the third stage and several to others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm import langzip, mixing, neardup, pieces, toxicity
from minekit.llm.common import fold, release, written
from minekit.llm.queries import PIECE_MODEL, labelled

#: SQL can express neither the classifiers nor the pieces; tests hold the stages against brute force.
ORACLE_SQL = None

#: Before the names of columns that a stage adds for itself, so that none of documents is hidden.
OWN = "_minekit_"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null and empty texts are not toxic. The model learns from the labels in sf_dir."""
    model = toxicity.fit(labelled(spark, docs, sf_dir))
    return toxicity.score(docs, model, keep_text=True, prefix=OWN).where(f"{OWN}predicted = 0").select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or whose language cannot be told from another, go."""
    dictionaries = langzip.fit(docs.where(fold("doc_id", 3) != 1))
    return langzip.classify(docs, dictionaries, keep_text=True, prefix=OWN).where(f"not {OWN}rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component under 5-word shingles and a similarity of 0.8 one document stays: that with the least id, and of several rows with this id the least one.

    Texts without words and rows without an id are in no component and stay, but for repeated ids.
    """
    found = neardup.near_duplicates(docs, k=5, t=(8, 10))
    kept = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times")), "kept-ids")

    def rows_of(ids: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(ids) if ids.count() <= neardup.BROADCAST_IDS else ids, "doc_id", "left_semi").select(*docs.columns)

    out, several = rows_of(kept.where("times = 1").select("doc_id")), kept.where("times > 1").select("doc_id")
    if several.limit(1).count():  # summed before the shuffle, so an id of very many rows does no harm
        out = out.unionByName(rows_of(several).groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return out.unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights of the sources ask: not, once or twice; a null source is a source."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids of the best segmentation and the scores of the N best; columns of docs with these names are replaced."""
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [("toxicity", drop_toxic), ("language ID", keep_languages), ("n-gram Jaccard join", drop_near_duplicates), ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
            release(spark)
    return docs
