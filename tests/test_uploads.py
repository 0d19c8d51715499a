"""Uploads as a stream: overlapping batches, replays, failed versions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.streaming.uploads import UploadLog, judge_uploads, live_versions, without_repeats

SHAPE = "upload_id long, office_id string, sha256 string, length long, format string, uploaded_at timestamp"
START = datetime(2024, 5, 1)


def upload(i, sha, office="o1", length=10, kind="pdf", minute=None):
    return (i, office, sha, length, kind, START + timedelta(minutes=i if minute is None else minute))


def test_judged_uploads(spark):
    versions = spark.createDataFrame([("v1", "o1", "d1", "a", "ready", START), ("v0", "o1", "d0", "a", "ready", START - timedelta(days=1)), ("v2", "o1", "d2", "b", "failed", START), ("v3", "o1", "d3", "c", "superseded", START), ("v4", "o2", "d4", "e", "ready", START), ("v5", "o1", "d5", "f", "pending", START)], "version_id string, office_id string, document_id string, sha256 string, status string, uploaded_at timestamp")
    rows = [upload(1, "a"), upload(2, "b"), upload(3, "b"), upload(4, "c"), upload(5, "e"), upload(6, "e", "o2"), upload(7, "x", length=0), upload(8, "x", kind=None), upload(9, "x", length=60 << 20), upload(10, "f"), upload(11, "f", None), upload(12, "g", minute=99), upload(13, "g", minute=98), upload(14, "h", length=None)]
    deleted = spark.createDataFrame([("d5",)], "document_id string")
    got = {r.upload_id: (r.outcome, r.reason, r.version_id) for r in judge_uploads(spark.createDataFrame(rows, SHAPE), versions, deleted).collect()}
    assert got == {
        1: ("duplicate", None, "v0"), 2: ("accepted", None, "v-2"), 3: ("duplicate", None, "v-2"), 4: ("accepted", None, "v-4"), 5: ("accepted", None, "v-5"), 6: ("duplicate", None, "v4"), 7: ("rejected", "empty", None), 8: ("rejected", "unsupported_type", None),
        9: ("rejected", "too_large", None), 10: ("accepted", None, "v-10"), 11: ("rejected", "no_office", None), 12: ("duplicate", None, "v-13"), 13: ("accepted", None, "v-13"), 14: ("rejected", "empty", None),
    }
    assert judge_uploads(spark.createDataFrame([], SHAPE), versions).count() == 0


def test_stream_of_overlapping_batches(spark, tmp_path):
    log, given = UploadLog(spark, f"file://{tmp_path}/log"), tmp_path / "in"

    def run(rows):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(str(given))
        stream = without_repeats(spark.readStream.schema(SHAPE).parquet(str(given)))
        stream.writeStream.foreachBatch(log.sink()).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return {r.sha256: (r.version_id, r.status) for r in live_versions(log.versions()).collect()}

    assert run([upload(1, "a"), upload(2, "a"), upload(3, "b")]).keys() == {"a", "b"}
    # The same contents again, within the watermark and long after it; one new.
    second = run([upload(4, "b"), upload(5, "c"), upload(6, "a", minute=5000)])
    assert second.keys() == {"a", "b", "c"} and log.versions().count() == 3
    # A replayed batch changes nothing.
    log.sink()(spark.createDataFrame([upload(9, "z")], SHAPE), 0)
    assert log.versions().count() == 3
    # A failed version's content is taken again, a live one's isn't.
    log.set_status("failed-b", log.versions().where("sha256 = 'b'"), "failed")
    last = run([upload(7, "b", minute=10_000), upload(8, "c", minute=10_000)])
    assert last["b"] == ("v-7", "pending") and last.keys() == {"a", "b", "c"} and log.versions().where("sha256 = 'b'").count() == 2


@pytest.mark.parametrize("lost", ["after", "before"])
def test_a_batch_that_fails_is_taken_once(spark, tmp_path, monkeypatch, lost):
    from factloom.sources.store import VersionStore

    log, batch = UploadLog(spark, f"file://{tmp_path}/log"), spark.createDataFrame([upload(1, "a"), upload(2, "b")], SHAPE)
    whole = VersionStore.publish

    def publish(self, *args, **more):
        if lost == "after":
            whole(self, *args, **more)
        raise RuntimeError("died")

    monkeypatch.setattr(VersionStore, "publish", publish)
    with pytest.raises(RuntimeError, match="died"):
        log.sink()(batch, 0)
    monkeypatch.setattr(VersionStore, "publish", whole)
    log.sink()(batch, 0)
    assert sorted(r.sha256 for r in log.versions().collect()) == ["a", "b"]
    assert log.versions().where(F.col("status") == "pending").count() == 2
