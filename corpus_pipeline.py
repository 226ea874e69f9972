"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspine.llm.common import fetch, stored
from panelspine.llm.decontam import keep_clean
from panelspine.llm.neardup import keep_one
from panelspine.llm.packing import pack_documents
from panelspine.llm.pii import replace_pii
from panelspine.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules by themselves and by their host. Null and
    empty texts go; a null source has no host verdict; repeated rows each stay
    or go; no rows: no rows."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the least by id and text hash;
    null ids come first; texts without words are one group; of repeated rows one
    stays; no rows: no rows."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of benchmark. Null and empty texts stay, as do
    all without items; repeated rows each stay or go; no rows: no rows."""
    return keep_clean(docs, fetch(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced. Null texts stay null; repeated rows
    give repeated results; no rows: no rows."""
    return replace_pii(docs, count_col=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's token ids go: bin_id, bin_offset, doc_id, piece,
    n_tokens. Null texts count as empty and take the token that ends a text;
    repeated rows are each packed; no rows: no rows."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("replace_personal_data", replace_personal_data),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot express the near-duplicate, decontamination and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; between two of them the rows are written
    as Parquet in the shared folder and read again."""
    docs = fetch(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
