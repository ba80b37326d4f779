"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary, made of pieces of a bounded sample of its
training texts, cut at hashed places. A text is folded (lower case, one space for each run of
anything but letters) and compressed once per language, in blocks of BLOCK bytes that cover it
whole: a dictionary saves bytes at the beginning of what is compressed, so blocks let it
tell languages apart in texts of any length. The smallest form names the language; if the
runner-up is nearly as small, the decision is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices

#: Training documents drawn per language (expected), bytes of a dictionary.
SAMPLE_DOCS, DICT_BYTES = 96, 112_640
#: Bytes of a folded text that are compressed at once; how they are: short matches, looked for in binary trees.
BLOCK, SETTINGS = 16_384, {"window_log": 17, "hash_log": 17, "chain_log": 17, "search_log": 4, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_BTLAZY2}
#: A decision is rejected if the runner-up is larger by less than this share of its own size.
MIN_MARGIN = 0.002
_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """The letters of a text in lower case, words parted by one space; empty if there is no letter."""
    out = _OTHER.sub(" ", text.lower()).strip()
    if out.isascii() or not any(not c.isalpha() and c != " " for c in set(out)):
        return out
    # other characters that count as word characters: numbers such as fractions, and marks
    return " ".join("".join(c if c.isalpha() else " " for c in out).split(" ")).strip() if any(map(str.isalpha, out)) else ""


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """language -> dictionary content.

    Rows without a text or a language teach nothing. A language's sample is drawn by a hash of the
    text, at a rate that makes sample_docs documents expected, so it is the same on every run. Each
    of its documents is folded whole and gives an equal share of dict_bytes, beginning at a
    place that its hash tells; what it gives is cut out by the executors, so the driver gets at
    most a few times dict_bytes a language. Repeated rows are drawn once.
    """
    train = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(2**53)) / F.lit(float(2**53))
    drawn = bounded_batches(train).withColumn("draw", draw).where(F.col("draw") < F.try_element_at(rate, F.col("lang"))).select("lang", "draw", F.pmod(F.xxhash64("text", F.lit("cut")), F.lit(2**31)).alias("cut"), "text")

    def ready() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist(), strict=True):
                data = folded(text).encode()
                at = cut % max(1, len(data) - dict_bytes + 1) if len(data) > dict_bytes else 0
                out.append(data[at : at + dict_bytes])  # no document can give more than a whole dictionary
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "draw", "cut")), pa.array(out, pa.binary())], names=["lang", "draw", "cut", "data"])

        return run

    found = drawn.mapInArrow(by_slices("text", ready), "lang string, draw double, cut bigint, data binary").dropDuplicates(["lang", "draw", "cut"])
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["draw"], r["cut"])):
        if r["data"]:
            texts.setdefault(r["lang"], []).append((r["cut"], bytes(r["data"])))
    out = {}
    for lang, own in texts.items():
        share = max(512, dict_bytes // len(own))
        parts = []
        for cut, data in own:
            at = cut // 7 % max(1, len(data) - share + 1)
            parts.append(data[at : at + share])
        out[lang] = b" ".join(parts)[-dict_bytes:]
    return dict(sorted(out.items()))


class Classifier:
    """Compressors of every language, built once per task."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names, self.compressors = list(dictionaries), []
        how = zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, **SETTINGS)
        for content in dictionaries.values():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=how, dict_data=data))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language or und, score, margin): margin is how much smaller the best form is than the runner-up, relative to the latter."""
        data = folded(text).encode() if text and self.names else b""
        if not data:
            return "und", 0.0, 0.0
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum([len(c.compress(x)) for x in blocks]), name) for name, c in zip(self.names, self.compressors, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], min(1.0, 0.5 + margin * 5), margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN, keep_text: bool = False, prefix: str = "") -> DataFrame:
    """docs without text (unless keep_text), with lang_pred, score, margin and rejected, prefix before these names.

    Null, empty and letterless texts are und with score 0 and rejected. Ties go to the
    language first in order. rejected also marks margins under min_margin (lang_pred still names
    the best guess). Repeated rows get equal values; a very long text is a slice of its own.
    Columns of docs with the new names are replaced. Rows are independent.
    """
    made = [prefix + x for x in ("lang_pred", "score", "margin", "rejected")]
    keep = [c for c in docs.columns if c not in made and (keep_text or c != text_col)]
    slim = bounded_batches(docs).select(*dict.fromkeys([*keep, text_col]))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keep), "`{}` string, `{}` double, `{}` double, `{}` boolean".format(*made)])

    def ready() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        judge = Classifier(dictionaries)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [judge(x) for x in batch.column(text_col).to_pylist()]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
            columns += [pa.array([f[0] == "und" or f[2] < min_margin for f in found], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

        return run

    return slim.mapInArrow(by_slices(text_col, ready), fields)
