"""The registered query of each operator of this package: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_language

    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    found = identify_language(docs, docs.where((fold != 2) & F.col("lang").isNotNull()))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(given.unionByName(added)))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), most_repeats=2.0).select("doc_id", "source", "epoch", "block", "place", "tokens")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").where(fold != 0)
    scored = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so each text's bytes stand for a mono 8-bit recording."""
    from .media import recording_classes

    return recording_classes(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op9_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_passages

    return dedup_passages(table(spark, sf_dir, "documents"), words=51)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


#: Fixed rules: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), least=100, most=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_chat": op2_chat,
    "op3_mix": op3_mix,
    "op4_toxicity": op4_toxicity,
    "op5_nearest": op5_nearest,
    "op6_pack": op6_pack,
    "op7_chroma": op7_chroma,
    "op8_shard": op8_shard,
    "op9_dedup_passages": op9_dedup_passages,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_url_filters": op11_url_filters,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}
