"""From raw documents to packed training sequences: language, near-duplicates, repeated passages, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspark.llm.language_id import UNDETERMINED, identify_language, remainder, train_language_id
from quarryspark.llm.mixing import apply_mix
from quarryspark.llm.near_dedup import drop_near_duplicates
from quarryspark.llm.packing import pack_documents
from quarryspark.llm.substring_dedup import remove_repeated_passages
from quarryspark.runtime import quoted, share_code, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters and ambiguous ones go.

    Cases: null, empty and letterless texts go; equal rows fare alike; where no row has a
    language to learn from, none can be told and all rows stay; an empty table gives no
    rows; columns of any name are kept as they are.
    """
    share_code(spark)
    model = train_language_id(docs, remainder("doc_id", 4) != 2)
    if model is None:
        return docs
    others = [c for c in docs.columns if c != "text"]
    found = identify_language(docs.select("text", F.struct(*quoted(others)).alias("row")), model)
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous"))
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Cases: texts without words and rows with a null id are linked to nothing and stay; of
    equal texts the least id stays, and all rows of that id; ids are whole numbers; an empty
    table gives no rows; columns of any name are kept as they are.
    """
    share_code(spark)
    return drop_near_duplicates(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that 35-word windows found elsewhere cover; untouched texts stay as they are.

    Cases: null, empty and short texts stay as they are; equal rows lose what repeats, all
    of them; a text of which nothing is left stays as an empty one; an empty table gives no
    rows; columns of any name are kept, with ``n_chars`` that of the new text.
    """
    share_code(spark)
    others = [c for c in docs.columns if c != "text"]
    found = remove_repeated_passages(docs.select("text", F.struct(*quoted(others)).alias("row")), window=35)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the ones at a source's cut up to the cut.

    Cases: null and empty texts have no words, so the mix takes none of them; a null source
    is a source of its own; rows with a null id spread by their text; equal rows count each;
    an empty table gives no rows; columns of any name are kept, with ``n_chars`` that of the
    text.
    """
    share_code(spark)
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens; workers drop the encoder after each task.

    Cases: null and empty texts are one piece of the end id; equal rows and rows of one id
    are packed each, a null id stays null; ids are whole numbers; an empty table gives no
    rows; only the id and text columns are read, so others may have any name.
    """
    import public_tokenizers

    share_code(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), blanks="dropped", end_id=0, known_units=200_000, forget=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: a trained classifier and a tokenizer stand between the input and the rows; tests use brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
