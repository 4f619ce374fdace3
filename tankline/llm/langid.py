"""Language ID by compression: the language whose zstandard raw-content dictionary makes a text smallest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, own_columns, small_batches

#: The bound of the labelled sample: rows for each language. Texts of up to so many characters are taken before longer ones.
ROWS_PER_LANGUAGE, SHORT = 96, 4_000
#: Parts that the hashes of one language are ranked in first.
PARTS = 32
#: Matches of three bytes count, as many syllables are that short.
LEVEL, MIN_MATCH = 3, 3
#: A text is compressed in blocks, all of them, so that in a long text a block is still told by the dictionary.
BLOCK_BYTES = 4_096
#: A prediction whose best language saves a smaller share than this over the next is rejected.
MIN_MARGIN = 0.005
UNKNOWN = "und"
_BETWEEN = regex.compile(r"[^\p{L}]+")


def bare(text: str) -> bytes:
    """What is compressed: the letters of a text in lower case, with one blank for all that is between them; marks,
    digits and shouting say nothing about the language. Empty without a letter."""
    words = _BETWEEN.sub(" ", text.lower()).strip()
    return f" {words} ".encode() if words else b""


def held_out(key):
    """Whether a row is kept from learning: CRC-32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_PER_LANGUAGE, short: int = SHORT) -> dict[str, bytes]:
    """A dictionary of raw text for each language, from the rows that aren't held out and have a language and a letter.

    The sample is at most rows texts of each language, whole and different ones: those of least hash among the texts of up to
    short characters, and longer ones only where these are too few. Hashes are picked first, from tasks that send no more
    than that, and only their texts are fetched, however often a text or an id is repeated.
    """
    useful = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).filter(F.col(text).rlike(r"\p{L}"))
    useful = useful.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("hash"), (F.length(text) > short).alias("long"), F.col(text).alias("text"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("long", "hash"))
    each = useful.groupBy("lang", "hash").agg(F.min("long").alias("long")).withColumn("part", F.pmod("hash", F.lit(PARTS)))
    each = each.withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= rows)  # so that no task gets a language's all hashes
    picked = each.withColumn("rank", rank("lang")).filter(F.col("rank") <= rows).select("lang", "hash", "rank")
    texts = useful.join(F.broadcast(picked), ["lang", "hash"]).groupBy("lang", "rank").agg(F.min("text").alias("text")).orderBy("lang", "rank").collect()
    out: dict[str, bytes] = {}
    for r in texts:
        out[r["lang"]] = out.get(r["lang"], b"") + bare(r["text"])
    return out


@lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...], level: int):
    out = []
    for name, data in model:
        known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=BLOCK_BYTES, dict_size=len(data), min_match=MIN_MATCH, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False
        )
        known.precompute_compress(compression_params=how)
        out.append((name, zstandard.ZstdCompressor(compression_params=how, dict_data=known)))
    return out


def judge(text: str | None, compressors) -> tuple[str, float, float]:
    """(language, score, margin) of a whole text. margin: the share of the next best size that the best one saves.
    score: the best language's share when sizes count as the bits of a likelihood, a block's worth of them."""
    data = bare(text or "") if compressors else b""
    if not data:
        return UNKNOWN, 0.0, 0.0
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c in compressors)
    best = sizes[0][0]
    score = 1 / sum(math.exp(-min(700, (s - best) / len(blocks))) for s, _ in sizes)
    return sizes[0][1], score, 1 - best / sizes[1][0] if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN, level: int = LEVEL) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin and rejected; columns of these names are replaced.

    lang_pred is a language of the model, or und for a null text, one without a letter, and an empty model; ties go to
    the first name. rejected: und, or a margin under min_margin. Only text is looked at, very long ones whole; repeated rows
    get the same. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(tuple(sorted(model.items())))

    @F.pandas_udf("lang_pred string, score double, margin double")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(held.value, level)
        for batch in batches:
            yield pd.DataFrame([judge(t, compressors) for t in batch], columns=["lang_pred", "score", "margin"])

    judged = docs.select(own_columns(docs, "lang_pred", "score", "margin", "rejected"), of_text(F.col(text)).alias("judged"))
    rejected = (F.col("judged.lang_pred") == UNKNOWN) | (F.col("judged.margin") < min_margin)
    return give_back(judged, "judged.lang_pred", "judged.score", "judged.margin", rejected.alias("rejected"))
