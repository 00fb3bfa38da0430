"""One query per operator over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roompulse.llm import (
    exact_dedup,
    html_text,
    infill,
    language_id,
    language_model,
    lexical,
    minhash,
    mixing,
    passages,
    pieces,
    quality,
    secrets,
    warc,
)
from roompulse.llm.sql import SQL
from roompulse.session import tune
from roompulse.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = SQL

# Rows that an Arrow batch brings to Python: bounds a task's memory where texts are long.
BATCH_ROWS = "256"
# A public piece table; read on the driver, which passes its pieces on.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def prepared(spark: SparkSession) -> SparkSession:
    """The session settings of this package; none depends on the size of the data."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepared(spark), sf_dir)
    QUERIES[fn.__name__] = run
    return run


@query
def op1_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query
def op2_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op3_language_id(spark, sf_dir):
    return language_id.identified(table(spark, sf_dir, "documents"))


@query
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), carry={
        "text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)})


@query
def op5_lm_scoring(spark, sf_dir):
    return language_model.scored(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents")).select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "clean_chars", "base_failed", "kept")


@query
def op7_html_extraction(spark, sf_dir):
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query
def op8_secret_scans(spark, sf_dir):
    return secrets.found_secrets(table(spark, sf_dir, "documents"))


@query
def op9_sentencepiece(spark, sf_dir):
    return pieces.encoded(table(spark, sf_dir, "documents"), pieces.Pieces.read(PIECE_MODEL))


@query
def op10_suffix_array_dedup(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_ranked_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return warc.read_back(warc.archived(pages), pages).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op13_fill_in_middle(spark, sf_dir):
    cut = infill.transformed(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
