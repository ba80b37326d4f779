"""Order MinHash fingerprints (DataFrame operations only).

A text's k-mers are runs of k words (fewer words: the whole text as one); each character of a
script written without spaces is a word. Equal k-mers are numbered by occurrence. Each slot of
the fingerprint orders all numbered k-mers at random: by one of bins / SECTORS hashes, its values
taken as a circle that is read from the slot's own starting point on (so every slot alone has
a uniformly random order). It takes the `take` least, puts them back into text order and hashes
the tuple. Two texts agree in a slot if the same k-mers, in the same order, are least in it, so
likeness falls with edits and with moved pieces alike. All of it is projections over arrays:
nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts


#: Bits of a packed k-mer that hold its position: texts of up to 16 million words are told apart. Slots that share a hash.
POSITION, SECTORS = 24, 32
#: Characters of scripts written without spaces.
_ALONE = "([\\u0E00-\\u0E7F\\u3040-\\u30FF\\u3400-\\u9FFF\\uAC00-\\uD7AF])"


def with_fingerprint(df: DataFrame, text_col: str, out_col: str, bins: int = 64, k: int = 3, take: int = 2) -> DataFrame:
    """df with out_col, an array<int> of bins slots (a multiple of SECTORS; k >= 2), all null for a text without words.

    Empty and null texts have nulls only. Words are split at ASCII white space. Each step is a
    column of its own, so that arrays of longs are sorted by generated code. Every step is read
    at least twice by the next one, which keeps the optimizer from repeating it inside a lambda.
    Time is n log n in a text's words, however often they repeat.
    """
    words, packed = f"_{out_col}_words", f"_{out_col}_packed"
    low = 2**POSITION - 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(text.rlike(_ALONE), F.regexp_replace(text, _ALONE, " $1 ")).otherwise(text)
    df = df.withColumn(words, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    w, n = F.col(words), F.size(words)
    pack = lambda h, i: h.bitwiseAND(~low).bitwiseOR(i.cast("long").bitwiseAND(low))
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: pack(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), i))
    df = df.withColumn(packed, F.sort_array(F.when(n >= k, many).when(n > 0, F.array(pack(F.xxhash64(F.array_join(w, " ")), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))))
    s = F.col(packed)
    # equal k-mers now lie together in text order; where a third one follows, the first is found by bisection
    df = df.withColumn(f"{packed}_h", F.transform(s, lambda x: F.shiftright(x, POSITION)))
    h = F.col(f"{packed}_h")

    def first_at(values: Column, least: Column, size: Column) -> Column:
        """The place among the first size rising values of the first that is not below least; size if all are."""

        def halve(at: Column, _: Column) -> Column:
            mid = F.shiftright(at["lo"] + at["hi"], 1)
            below = (mid < at["hi"]) & (F.get(values, mid) < least)
            return F.struct(F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(below, at["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(size))), F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve)["lo"]

    def numbered(x: Column, i: Column) -> Column:
        own = F.shiftright(x, POSITION)
        again, third = (i > 0) & (F.get(h, i - 1) == own), (i > 1) & (F.get(h, i - 2) == own)
        return F.when(again, pack(F.xxhash64(own, F.when(third, i - first_at(h, own, i)).otherwise(F.lit(1))), x)).otherwise(x)

    df = df.withColumn(f"{packed}_z", F.transform(s, numbered))
    z = F.col(f"{packed}_z")
    shift = 64 - (SECTORS - 1).bit_length()
    sector = lambda x: F.shiftright(x, shift).cast("int")
    circle = lambda g: F.transform(z, lambda x: pack(F.xxhash64(F.shiftright(x, POSITION), g), x))
    turned = lambda x: F.shiftleft(x.bitwiseAND(low), 39).bitwiseOR(F.shiftrightunsigned(x, POSITION + 1))  # noqa: E731  position before hash: 24 and 39 bits

    def value(y: Column, i: Column) -> Column:
        least = F.transform(F.sequence(F.lit(0), F.least(F.lit(take), F.size(y)) - 1), lambda d: turned(F.get(y, (i + d) % F.size(y))))
        return F.shiftright(F.xxhash64(F.transform(F.sort_array(least), lambda x: x.bitwiseAND(2**39 - 1))), 32).cast("int")

    def slots_of(y: Column) -> Column:
        """The slots of the sectors of y: each x that begins one gives its value to it and to the empty ones before it."""

        def up_to(x: Column, i: Column) -> Column:
            gap = F.when(i == 0, sector(x) + 1 + SECTORS // 2).otherwise(sector(x) - sector(F.get(y, i - 1)))
            return F.when(gap > 0, F.array_repeat(value(y, i), gap)).otherwise(F.array().cast("array<int>"))

        end = SECTORS // 2 - 1 - sector(F.element_at(y, -1))  # empty sectors behind the last: the circle begins again
        return F.when(F.size(y) > 0, F.concat(F.flatten(F.transform(y, up_to)), F.array_repeat(value(y, F.lit(0)), end))).otherwise(F.array_repeat(F.lit(None).cast("int"), SECTORS))

    def leading(c: Column) -> Column:
        """The first `take` of each sector: what follows in them is what follows in the circle, as far as take goes."""
        return F.filter(c, lambda x, i: (i < take) | (sector(F.get(c, i - take)) != sector(x)))

    groups = [f"{packed}_{g}" for g in range(bins // SECTORS)]
    for g, name in enumerate(groups):
        df = df.withColumn(f"{name}_c", F.sort_array(circle(F.lit(g)) if g else z))
        df = df.withColumn(f"{name}_y", leading(F.col(f"{name}_c")))
        df = df.withColumn(name, slots_of(F.col(f"{name}_y"))).drop(f"{name}_c", f"{name}_y")
    return df.withColumn(out_col, F.concat(*groups)).drop(words, packed, f"{packed}_h", f"{packed}_z", *groups)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those filled on either side; 1.0 for two empty fingerprints."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    filled = F.aggregate(F.zip_with(a, b, lambda x, y: (x.isNotNull() | y.isNotNull()).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)


def as_text(slots: Column) -> Column:
    """8 hexadecimal digits a slot, dots for an empty one."""
    return F.array_join(F.transform(slots, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0"), F.lit("........"))), "")


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", parts: int | None = None) -> DataFrame:
    """docs, with _next: a struct of the given columns of the row with the next smaller id.

    After the smallest id comes the largest; rows of equal ids come in falling order of the
    columns, null ids last. Ranges of ids, cut at approximate quantiles, are sorted by
    themselves. The last row of each range gets the first row of another: one row per range is
    sent to all tasks, so a bounded number of rows. One shuffle carries the columns.
    """
    spark = docs.sparkSession
    parts = parts or max(2, min(1000, shuffle_parts(spark)))
    cuts = docs.select(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(id_col) < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    rows = docs.withColumn("_range", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(tree(0, len(cuts))))
    tops = {r["_range"]: r["top"] for r in rows.groupBy("_range").agg(F.max(id_col).alias("top")).collect()}
    ranges = sorted(tops, reverse=True)
    if not ranges:
        return docs.withColumn("_next", F.struct(*columns))
    after = dict(zip(ranges, ranges[1:] + ranges[:1], strict=True))
    order = Window.partitionBy("_range").orderBy(F.col(id_col).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in columns if c != id_col])
    first = rows.where(F.col(id_col).isin([t for t in tops.values() if t is not None]) | F.col(id_col).isNull())
    first = first.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    before = F.create_map(*[F.lit(x) for low, high in ((v, k) for k, v in after.items()) for x in (low, high)])
    first = first.select(F.element_at(before, F.col("_range")).alias("_range"), F.struct(*columns).alias("_first"))
    linked = rows.withColumn("_lead", F.lead(F.struct(*columns)).over(order)).join(F.broadcast(first), "_range")
    return linked.withColumn("_next", F.coalesce("_lead", "_first")).drop("_range", "_lead", "_first")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = 64, k: int = 3, take: int = 2) -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all)
    of the next document in descending order of ids (after the last: the first). A null text counts
    as empty; of a single document the next is itself; equal ids come in falling order of their
    texts. An empty table gives an empty result. Other columns of docs are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    linked = with_next(with_fingerprint(base, "text", "slots", bins, k, take), ["id", "text", "slots"], "id")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    done = linked.select(
        "id", "slots", F.col("_next.slots").alias("next_slots"), n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next.text"), F.lit(1), half)).alias("edited"),
    )
    done = with_fingerprint(done, "edited", "edited_slots", bins, k, take)
    return done.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("slots")).alias("fingerprint"),
        as_text(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )
