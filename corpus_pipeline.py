"""From raw documents to token ids: quality, exact copies, near copies, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``. A stage works on all rows its predecessor kept.

Defined results. A null text counts as empty: it is scored like one, all such rows are copies of each other, and the one that
stays has no token. Without labels every document scores 0.5 and stays; without a benchmark nothing is contaminated. Of equal or
near texts one row stays: the smallest id, a null id after all others, and of rows with one id the one numbered first. Rows are
never told apart by their id alone, so repeated ids do no harm. Empty tables give an empty result. Further columns, whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm._common import stored, table
from orrery.llm.bpe import encode_documents
from orrery.llm.decontamination import without_leaks
from orrery.llm.exact_dedup import without_copies
from orrery.llm.near_dedup import STAGE_PERCENT, without_near_copies
from orrery.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores 0.3 or more."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for ASCII white space: most code points, then smallest id."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies: shingle sets with a Jaccard similarity of 0.8 or more."""
    return without_near_copies(docs, percent=STAGE_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and digests of the round trip."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The classifier and the tokenizer are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
