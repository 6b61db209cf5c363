"""A corpus pipeline over `documents`: quality, line dedup, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the documents are
written as Parquet and read again. All stages but the last return the columns of `documents`, further columns of any
names included. An empty table gives no rows at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import line_dedup, mixing, near_dup, packing, quality_model
from tessella.llm._scale import keep

#: No SQL dialect expresses the trained classifier or the signatures; tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sparse rule ensemble rejects (score under 0.5) go; a score of 0.5 stays.

    A null text is scored as an empty one, a text of any length by all of it. Equal texts get equal scores, so repeated
    rows stay or go together. Rows without a label, or whose doc_id is null, are judged like all others."""
    return quality_model.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on more than a tenth of a source's documents go (sentences: a twentieth), and passages from five
    unlike documents on, but for the first of them; the documents stay, n_chars is counted anew.

    The first document is that of the smallest doc_id, null ones last; repeated rows lose the same lines. A null text
    stays null with a null n_chars, an empty one stays empty; rows without a source keep all lines."""
    out = line_dedup.text_lines(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest doc_id.

    Equal texts are one class, null and empty texts included; of repeated rows, which tie in doc_id, one stays. Texts of
    fewer words than a shingle are duplicates only of equal ones. Whole texts are compared, whatever their length."""
    return near_dup.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is one of its own, after all others. Null and empty texts have no size and are never taken; ties are
    broken by a seeded hash of the document, so reruns agree."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens; one row per piece.

    A null text counts as empty and packs as its end token alone; longer texts than a sequence are cut; repeated rows are
    packed as often as they occur. Other columns are ignored."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("minhash near-dedup", near_duplicates), ("source mixing", mixture), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
