"""From raw documents to packed training windows: five stages, each one operator of factloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs; all but the last return the columns of
documents. Null and empty texts, repeated rows and empty tables behave as the operators
define. Further columns are passed on unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.minhash import near_duplicates
from factloom.llm.mixing import mix_sources
from factloom.llm.packing import pack
from factloom.llm.queries import tokenizer_path
from factloom.llm.suffix_dedup import strip_word_passages
from factloom.llm.toxicity import learn, with_scores
from factloom.llm.workspace import Workspace, small_batches

#: Ids that may be broadcast; more are joined by a shuffle.
FEW = 1_000_000


def _row(docs: DataFrame, *but: str) -> Column:
    """A document's columns, but for some, as one: no operator's names meet theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in but)).alias("row")


def _unpacked(found: DataFrame, docs: DataFrame, *apart: str) -> DataFrame:
    """The columns of docs from row, some from columns of their own."""
    return found.select(*(F.col(c) if c in apart else F.col("row").getField(c).alias(c) for c in docs.columns))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those whose doc_id is among ids, a written table."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5, each by its own text, with or without an id; labels teach as they do in the operator's query."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 0)
    small_batches(spark)
    scored = with_scores(docs.select(_row(docs), "text"), learn(docs, labels))
    return _unpacked(scored.where("score < 0.5"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates (five-word shingles, similarity 0.8), once.

    Rows without an id stay; of rows that share an id the one with the least text stays.
    """
    space = Workspace(spark, "pipeline")
    found = space.write(near_duplicates(docs).select("doc_id", "kept"), "found")
    dropped = space.write(found.where("not kept").select("doc_id").distinct(), "dropped")
    repeated = space.write(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = _without(docs, dropped)
    if repeated.isEmpty():
        return kept
    own = kept.join(repeated, "doc_id", "left_semi").select("doc_id", _row(kept), F.coalesce("text", F.lit("")).alias("text"))
    once = own.groupBy("doc_id").agg(F.min_by("row", "text").alias("row"))
    return _without(kept, repeated).unionByName(_unpacked(once, kept))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages of over 50 words, whatever their bytes.

    As in the operator, every occurrence goes, the first one included: a passage
    that many documents share is boilerplate in each. A document that had words
    and is left without any goes; one that was empty before stays.
    """
    given = docs.select(_row(docs, "text", "n_chars"), "text", "n_chars", F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("had_words"))
    stripped = strip_word_passages(given, 51)
    return _unpacked(stripped.where(~F.col("had_words") | F.col("text").rlike(r"\S")), docs, "text", "n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them."""
    return _unpacked(mix_sources(docs.select(_row(docs), "doc_id", "text", "source"), most_repeats=2.0), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in windows of 1,024."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the models nor the windows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
