"""From raw documents to token ids, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet below the shared checkpoint folder and reads it back as
the next stage's documents.  All stages but the last return the columns of
their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import bpe, mixing, near_text, quality, substrings
from fieldmill.llm.shared import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rules or the classifier reject: null,
    empty and short texts fail the base rules; repeated rows are judged alike."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near
    duplicates (five-word shingles, similarity 0.8); of rows that repeat an id
    and text one stays; documents without id stay."""
    kept = near_text.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


def _private(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns besides ``own`` renamed, so that none meets a
    column that an operator makes, and the new names."""
    rest = [c for c in docs.columns if c not in own]
    names = [f"rest_{i}" for i in range(len(rest))]
    return docs.select(*[c for c in docs.columns if c in own], *[docs[c].alias(n) for c, n in zip(rest, names)]), names


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that a document of smaller id holds;
    n_chars follows the text.  Other columns may have any name.  Null and
    empty texts and rows without id lose nothing; repeated rows are kept."""
    held, rest = _private(docs, "doc_id", "text", "n_chars")
    out = substrings.repeated_passages(held.drop("n_chars"), carry=tuple(rest))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    back = iter(rest)
    return out.select(*[(made[c] if c in made else F.col(next(back))).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.
    Other columns may have any name.  Null sources are one source, the last;
    null and empty texts have no words; of rows that repeat id and text as many
    are taken as come nearest the target."""
    held, rest = _private(docs, "doc_id", "text", "source")
    taken = mixing.mixed(held).where("mix_takes > 0")
    back = iter(rest)
    return taken.withColumn("mix_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_takes")))) \
        .select(*[F.col(c if c in ("doc_id", "text", "source") else next(back)).alias(c) for c in docs.columns])


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded
    text; null and empty texts have no ids, repeated rows are encoded alike."""
    return bpe.encode_texts(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

# MinHash components, a trained classifier and BPE are beyond SQL; the stages
# are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
