"""From raw documents to packed training sequences: five stages over the table ``documents``.

1. quality: documents that the base rules or the fitted quality model reject go.
2. lines: later occurrences of three-line windows go.
3. near_duplicates: of each group of documents linked by n-gram Jaccard similarity the one with the
   smallest doc_id stays.
4. substrings: words in long spans that an earlier document has go.
5. packing: what is left becomes sequences of at most 4096 tokens.

Each stage takes and returns the columns of ``documents``, but for the last, which returns pieces. A
document whose text gets empty stays a row with an empty text. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import jaccard, lines, packing, quality, substrings
from paperloom.llm.queries import read, vocabulary
from paperloom.llm.scratch import Scratch

#: The tokenizer and the model have no SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def _counted(documents: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    if "n_chars" not in documents.columns:
        return documents
    kind = documents.schema["n_chars"].dataType
    return documents.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else documents[c] for c in documents.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(lines.remove_repeats(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substrings.remove_repeats(docs))


def sum_of_squares(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json").decode())


STAGES = [
    ("quality", quality_rules),
    ("lines", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substrings", substring_dedup),
    ("packing", sum_of_squares),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder as Parquet
    and read again, so a lost executor costs at most the stage at work."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), "documents")
    return STAGES[-1][1](spark, docs, sf_dir)
