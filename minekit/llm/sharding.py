"""Sharding by sampled splitters (DataFrame operations only).

Records get one sortable 63-bit key: 32 bits of their text's crc32, so that equal texts lie
together, and 31 bits of a hash of the id, so that a group of copies can be split. Rows are
drawn with a chance in proportion to their size; quantiles of the drawn keys are the
splitters of many fine ranges. Ranges found overfull after counting are subdivided by
another hash. Running sums inside each range, plus the bytes before it, place every record on
one line of bytes, which is cut into equal shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, written

#: Drawn keys per fine range, and the most fine ranges of one level.
PER_RANGE, MOST_RANGES = 48, 1024


def _locate(key: Column, splitters: list[int]) -> Column:
    """Number of splitters <= key, by binary search written as nested conditions."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(splitters[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(splitters))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, ranges: int | None = None) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus overhead. Shards hold contiguous pieces of
    the key order with sizes that differ by no more than one record about their edges; slot is
    gapless from 0 in each shard. Null ids are hashed as nulls, null and empty texts have crc32 0;
    repeated rows are kept, each in a slot of its own. Reruns agree but for the order among
    rows equal in all of (id, text). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranges = ranges or max(shards, min(MOST_RANGES, 2 * shuffle_parts(spark)))
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    crc = F.crc32(data)
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(data) + overhead).cast("long").alias("size"),
            crc.alias("crc"),
            F.shiftleft(crc, 31).bitwiseOR(F.xxhash64(F.col(id_col)).bitwiseAND(2**31 - 1)).alias("key"),
        ),
        "shard-keys",
    )
    total = rows.agg(F.sum("size").cast("double").alias("total"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # Poisson draw: expected PER_RANGE * ranges keys, so bounded whatever the input
    draw = F.pmod(F.xxhash64(F.col("key"), F.lit("draw")), F.lit(2**53)) / F.lit(float(2**53))
    wanted = F.col("size") * F.lit(PER_RANGE * ranges / total["total"])
    drawn = [r["key"] for r in rows.where(draw < wanted).select("key").sort("key").collect()]
    splitters = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []
    located = rows.withColumn("range", _locate(F.col("key"), splitters))
    # overfull ranges: more than twice the mean in rows or bytes
    counts = located.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    pieces = {
        r["range"]: int(max(r["n"] * ranges / total["n"], r["bytes"] * ranges / total["total"])) + 1
        for r in counts.where((F.col("n") > 2.0 * total["n"] / ranges) | (F.col("bytes") > 2.0 * total["total"] / ranges)).collect()
    }
    piece = F.lit(0)
    if pieces:
        table = F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair])
        piece = F.pmod(F.xxhash64("id", "key", F.lit("piece")), F.coalesce(F.try_element_at(table, F.col("range")), F.lit(1)).cast("long"))
    located = located.withColumn("piece", piece.cast("int"))
    sums = located.groupBy("range", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    line = Window.partitionBy(F.lit(0)).orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    # one row per piece of a range: bounded by a few times MOST_RANGES
    starts = sums.select("range", "piece", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("start"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("rank"))
    starts = {(r["range"], r["piece"]): (r["start"], r["rank"]) for r in starts.collect()}
    lookup = F.create_map(*[x for (a, b), (s, n) in starts.items() for x in (F.lit(a * 2**20 + b), F.struct(F.lit(s).cast("long").alias("start"), F.lit(n).cast("long").alias("rank")))])
    at = F.element_at(lookup, F.col("range") * 2**20 + F.col("piece"))
    inside = Window.partitionBy("range", "piece").orderBy("key", "id", "size")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = located.select(
        "id", "size", "crc", at.alias("at"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("in_start"), (F.row_number().over(inside) - 1).alias("in_rank")
    ).select("id", "size", "crc", (F.col("at.start") + F.col("in_start")).alias("start"), (F.col("at.rank") + F.col("in_rank")).alias("rank"))
    # a record belongs to the shard in which its middle byte lies
    middle = F.col("start") + F.col("size") / 2
    placed = written(placed.withColumn("shard", F.least(F.floor(middle * F.lit(shards / total["total"])), F.lit(shards - 1)).cast("int")), "shard-line")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    first = F.element_at(F.create_map(*[F.lit(x) for pair in firsts.items() for x in pair]), F.col("shard"))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - first).cast("long").alias("slot"))
