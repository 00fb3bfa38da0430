"""A corpus pipeline: each stage applies one operator of ``roompulse.llm`` to all that the stage before kept.

Every stage reads whole texts of any length, takes null texts as empty, keeps all columns whatever their names (the last stage
returns its own) and gives no rows for none. What else it does with odd rows its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roompulse.llm import exact_dedup, minhash, mixing, pieces, quality
from roompulse.llm.queries import PIECE_MODEL, prepared
from roompulse.session import staged
from roompulse.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go; the others stay as they are.

    Rows are judged by their text alone: null and empty texts go, repeated rows and rows without an id like any other.
    """
    return quality.good_documents(prepared_docs(spark, docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the document with the largest id stays.

    Rows that repeat that id stay too; rows without an id cannot be named and stay. Empty texts are identical.
    """
    return exact_dedup.without_copies(prepared_docs(spark, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 80 % of their five-word shingles, the smallest id stays.

    Texts without a word are linked with nothing and stay, like rows without an id. Rows that repeat an id stay or go together.
    """
    return minhash.without_near_copies(prepared_docs(spark, docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice.

    A null source is a source of its own. Rows that repeat an id share its number of copies; rows without an id stay as they are.
    """
    return mixing.repeated(prepared_docs(spark, docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, and whether they decode to its text.

    Null and empty texts have no ids. Copies and rows without an id are encoded like any other.
    """
    return pieces.encoded(prepared_docs(spark, docs), pieces.Pieces.read(PIECE_MODEL))


def prepared_docs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepared(spark)
    return docs


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

# Newton steps and piece merging are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each result written to the shared folder and read again."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
