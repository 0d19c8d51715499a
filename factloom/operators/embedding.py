"""Vectors of texts, made once for each text and model.

What has a vector already is left out by an anti-join on the text's digest, so
only new texts reach Python, equal ones once; a model is loaded once for each
partition and sees batches of a bounded number of texts. New vectors are appended
in one job, which leaves nothing if it fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "digest string, model string, embedding array<float>"
BATCH = 64

#: Makes a list of texts into a list of vectors.
Model = Callable[[list[str]], list[list[float]]]


def vectors_at(spark: SparkSession, path: str) -> DataFrame:
    """The vectors kept in a folder; none if there is no such folder yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(VECTORS).parquet(path) if there else spark.createDataFrame([], VECTORS)


def pending(texts: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(digest, text) of non-null texts (text) without a vector of the model, each once."""
    asked = texts.where("text is not null").select(F.sha2("text", 256).alias("digest"), "text")
    held = vectors.where(F.col("model") == model).select("digest")
    return asked.join(held, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))


def embed_pending(texts: DataFrame, path: str, load: Callable[[], Model], model: str, batch: int = BATCH) -> int:
    """Append the vectors of texts that have none yet under path; how many these are.

    load makes the model on a worker. A model that gives another number of vectors
    than it was given texts fails the job.
    """
    spark = texts.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = None
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                embed = embed or load()
                found = embed(part.text.tolist())
                if len(found) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(found)} vectors")
                yield pd.DataFrame({"digest": part.digest.to_numpy(), "model": model, "embedding": list(found)})

    before = vectors_at(spark, path)
    new = pending(texts, before, model)
    counted = before.count()
    new.mapInPandas(run, VECTORS).write.mode("append").parquet(path)
    return vectors_at(spark, path).count() - counted


def with_vectors(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """chunks (with text) and their embedding and embedding_model, null where there is none yet."""
    held = vectors.where(F.col("model") == model).groupBy("digest").agg(F.first("embedding").alias("embedding"))
    own = chunks.withColumn("digest", F.sha2("text", 256)).join(held, "digest", "left").drop("digest")
    return own.withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), F.lit(model)))
