"""From raw documents to token ids: toxicity, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, line_dedup, mixing, near_dup, toxicity
from tilewright.llm.common import discard, stored


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it is there, that follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return docs.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score reaches the threshold go; the index is fitted on the labelled ones that aren't held out. Null and empty texts, very long ones and repeated rows are scored like
    any others, each by itself; no documents give none; columns of any name pass through."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines the first stays; documents that had lines and keep none go, those without lines (null or empty texts too) stay. Of rows equal in doc_id and text each keeps the same lines.
    n_chars follows the text; columns of any other name pass through."""
    return counted(line_dedup.without_alike_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the largest, ties to the smaller doc_id. All texts without words are one class; rows equal in doc_id and text are one. Columns of any name pass through."""
    return near_dup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row for each pass that takes all words, one with the words of the blocks that the last pass drew. Those without words stay, a null source is one of its own.
    n_chars follows the text; columns of any other name pass through."""
    return counted(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids (binary) and the digests of the ids and of the decoded bytes. A null text counts as empty; no column but these is read."""
    return byte_bpe.encode_documents(docs, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express the classifier, the sketches or the tokenizer: tests hold the stages against brute force (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
            if before is not None:
                discard(before)
            before = docs
    return docs
