"""Vectors are made once for each text and model."""

import pytest
from pyspark.sql import functions as F

from factloom.operators.embedding import embed_pending, pending, vectors_at, with_vectors


@pytest.fixture
def lengths():
    return lambda: lambda texts: [[float(len(x)), float(len(texts))] for x in texts]  # made on workers, which don't have this module


def test_only_new_texts_are_embedded(spark, tmp_path, lengths):
    path = f"file://{tmp_path}/vectors"
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "chunk_id int, text string")
    assert embed_pending(frame(["a", "bb", "a", None, ""]), path, lengths, "m1") == 3
    assert embed_pending(frame(["a", "bb", "", None]), path, lengths, "m1") == 0 and vectors_at(spark, path).count() == 3
    more = frame(["a", "ccc", "bb", "ccc", "dddd"])
    assert {r.text for r in pending(more, vectors_at(spark, path), "m1").collect()} == {"ccc", "dddd"}
    assert embed_pending(more, path, lengths, "m1", batch=1) == 2 and embed_pending(more, path, lengths, "m2") == 4
    got = {r.chunk_id: (r.embedding and r.embedding[0], r.embedding_model) for r in with_vectors(frame(["ccc", "new", None, "bb"]), vectors_at(spark, path), "m1").collect()}
    assert got == {0: (3.0, "m1"), 1: (None, None), 2: (None, None), 3: (2.0, "m1")}
    assert embed_pending(frame([]), path, lengths, "m1") == 0


def test_a_failed_run_leaves_nothing(spark, tmp_path, lengths):
    path = f"file://{tmp_path}/vectors"
    texts = spark.createDataFrame([("a",), ("b",)], "text string").repartition(2)
    with pytest.raises(Exception, match="gave 0 vectors"):
        embed_pending(texts, path, lambda: lambda texts: [], "m")
    assert vectors_at(spark, path).count() == 0
    assert embed_pending(texts, path, lengths, "m") == 2 and vectors_at(spark, path).where(F.col("model") == "m").count() == 2
