"""A pipeline over documents: language ID, line dedup, near-dedup, decontamination, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankline.llm import langid
from tankline.llm.common import materialize, table
from tankline.llm.decontaminate import WORDS, contaminated
from tankline.llm.line_dedup import dedup_lines
from tankline.llm.queries import LINE_MIN_DOCS, coded
from tankline.llm.simhash import similar_dedup


def _wrapped(docs: DataFrame) -> DataFrame:
    """(own, text): docs' columns as one struct, which no column of an operator can clash with, and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "text")


def _back(wrapped: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs from the struct, but for changed ones."""
    return wrapped.select(*[changed[c].alias(c) if c in changed else F.col(f"own.`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of unknown language, or with a narrow margin, go. The dictionaries are learned from docs themselves."""
    judged = langid.identify(_wrapped(docs), langid.learn(docs))
    return _back(judged.filter(~F.col("rejected")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go; n_chars follows the text. A document stays even if all its lines go."""
    out = dedup_lines(_wrapped(docs), min_docs=LINE_MIN_DOCS)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _back(out, docs, **changed)


def _with_row(docs: DataFrame) -> DataFrame:
    """(own, text, row) with a key that is never null: id and text. Rows without an id come last in its order."""
    return _wrapped(docs).withColumn("row", F.struct(F.col("own.doc_id").isNull().alias("unnamed"), F.col("own.doc_id").alias("id"), F.sha2("text", 256).alias("digest")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the least doc_id, or of the least digest where an id repeats. Groups are of texts
    whose five-word shingles have a cosine of 0.8 or more, by similar_dedup. Rows that repeat an id with other texts, and
    rows without an id, are judged by their own texts. Of rows that are the same in id and text, the one whose columns have the
    least hash stays, of whatever types they are."""
    rows = _with_row(docs)
    kept = similar_dedup(rows, key="row").filter(F.col("row") == F.col("component_id")).groupBy("row").agg(F.count("*").alias("n"))
    kept = materialize(kept, "kept-rows")
    once, often = (kept.filter(c).select("row") for c in ("n = 1", "n > 1"))
    out = rows.join(once, "row", "left_semi").select("own")
    if often.count():
        again = rows.join(often, "row", "left_semi").groupBy("row").agg(F.min_by("own", F.xxhash64(F.to_json("own"))).alias("own"))
        out = out.unionByName(again.select("own"))
    return _back(out, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item of five words or more go, with or without an id; other rows of the same id stay. Shorter items
    turn up by chance, and clean documents are to stay."""
    rows = _with_row(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), key="row", least_words=WORDS).select("row").distinct()
    return _back(rows.join(found, "row", "left_anti"), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of the documents that are left, and those of their decoded texts."""
    return coded(docs.select("doc_id", "text")).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup_stage), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: DuckDB has neither the compression nor the fingerprints that the stages rest on.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
