"""The thin queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langzip, mainarticle, mixing, mpegaudio, neardup, ngramlm, ordermin, pieces, sharding, toxicity
from .common import fold, written


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in MPEG audio frames, read back and described."""
    return mpegaudio.digest_documents(_docs(spark, sf_dir))


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(text, toxic) of the labelled documents that may teach: remainder of crc32 by 5 not 0.

    All of them: many labels are not sent to every task but joined by a shuffle, whose result is written, as it is read several times.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0)).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    n = labels.count()
    few = n <= neardup.BROADCAST_IDS
    found = docs.select("doc_id", "text").join(F.broadcast(labels) if few else labels, "doc_id").select("text", "toxic")
    return found if few else written(found, "labelled")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from four folds of five of the labels."""
    docs = _docs(spark, sf_dir)
    model = toxicity.fit(labelled(spark, docs, sf_dir))
    return toxicity.score(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted", "evidence")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word shingles and a similarity of 0.9."""
    return neardup.near_duplicates(_docs(spark, sf_dir), k=3, t=(90, 100)).select("doc_id", "n_shingles", "component_id", "representative")


def op4_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from two folds of three."""
    docs = _docs(spark, sf_dir).withColumn("held_out", fold("doc_id", 3) == 1)
    dictionaries = langzip.fit(docs.where("not held_out"))
    return langzip.classify(docs.select("doc_id", "held_out", "text"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = sharding.shard_documents(_docs(spark, sf_dir), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Where the public vocabulary files lie; a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


#: Words in an n-gram of the language model.
LM_ORDER = 3


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in pieces: the best segmentation's digest, the N best scores, the round trip."""
    return pieces.digest_documents(_docs(spark, sf_dir), PIECE_MODEL)


def op7_eliasfano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by n-grams learnt from four folds of five."""
    docs = _docs(spark, sf_dir).select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "text")
    return ngramlm.score(docs, ngramlm.fit(docs.where("not held_out"), order=LM_ORDER))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every text and of its edited text."""
    return ordermin.fingerprint_documents(_docs(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 over 150 % of all words."""
    return mixing.mix_sources(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return mainarticle.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op1_mpeg_audio": op1_mpeg_audio, "op2_toxicity": op2_toxicity, "op3_jaccard_join": op3_jaccard_join, "op4_compression": op4_compression, "op5_sharding": op5_sharding, "op6_sentencepiece": op6_sentencepiece, "op7_eliasfano_lm": op7_eliasfano_lm, "op8_order_minhash": op8_order_minhash, "op9_mixing": op9_mixing, "op10_line_blocks": op10_line_blocks}
ORACLE = {"op9_mixing": mixing.ORACLE_SQL}
