"""Structured Streaming use of the row-local operators.

Cleaners, tokenizers, row features and entity extraction contain no
actions, so the same expressions run on a ``readStream`` DataFrame.  The
reference has no stateful stream operator, so none is built here; labels
join as a stream-static left join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import features as FE
from ..functions import tokens as TK

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_document_stream(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """Parquet files dropped into ``folder`` as a stream of documents."""
    return (spark.readStream.schema(DOCUMENT_SCHEMA)
            .option("maxFilesPerTrigger", max_files).parquet(folder))


def profile_stream(docs: DataFrame, flags: C.CleanFlags = C.MAIN) -> DataFrame:
    """Per document: cleaned text, token count and the row features."""
    clean = C.clean_text(F.col("text"), flags)
    return docs.select(
        "doc_id", clean.alias("cleaned"),
        F.size(TK.word_tokens(clean)).alias("n_tokens"),
        *FE.feature_columns(F.col("text")))
