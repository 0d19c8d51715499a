"""Uploads as a stream: each content becomes one live version, whenever and in how many batches it comes.

Within the watermark equal contents of one office are dropped inside the stream.
Across batches each content is looked up by its digest among versions that count:
those of documents that aren't deleted, neither failed nor superseded. So a
failed version's content is taken again, and a batch that is replayed finds its
own rows under its name and leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import MOST_MB
from ..sources.store import VersionStore

#: States of a version whose content may be taken again.
NOT_LIVE = ("failed", "superseded")
VERSIONS = "version_id string, office_id string, document_id string, sha256 string, status string, uploaded_at timestamp"


def live_versions(versions: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Versions that hold their content: not failed, not superseded, of documents that aren't in deleted (document_id)."""
    live = versions.where(~F.col("status").isin(*NOT_LIVE))
    return live if deleted is None else live.join(deleted.select("document_id").distinct(), "document_id", "left_anti")


def judge_uploads(uploads: DataFrame, versions: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """upload_id, outcome (accepted, duplicate or rejected), reason and version_id of each upload.

    uploads: upload_id, office_id, sha256, length, format, uploaded_at. The first
    of equal contents is accepted as a version named after it; a duplicate names
    the version that holds its content, the oldest if there are several.
    """
    c = F.col
    # One digest may come very often; only its first upload and the versions of asked digests are compared.
    oldest = F.min_by("version_id", F.struct("uploaded_at", "version_id"))
    held = live_versions(versions, deleted).groupBy("office_id", "sha256").agg(oldest.alias("held"))
    reason = F.when(F.coalesce("length", F.lit(0)) == 0, "empty").when(c("length") > MOST_MB << 20, "too_large").when(c("format").isNull(), "unsupported_type").when(c("office_id").isNull(), "no_office")
    asked = uploads.withColumn("reason", reason)
    good = asked.where("reason is null")
    first = good.groupBy("office_id", "sha256").agg(F.min_by("upload_id", F.struct("uploaded_at", "upload_id")).alias("first"))
    found = first.join(held, ["office_id", "sha256"], "left")
    name = F.concat(F.lit("v-"), c("first").cast("string"))
    taken = good.join(found, ["office_id", "sha256"]).select(
        "upload_id", F.when(c("held").isNull() & (c("upload_id") == c("first")), "accepted").otherwise("duplicate").alias("outcome"),
        F.lit(None).cast("string").alias("reason"), F.coalesce("held", name).alias("version_id"),
    )
    return taken.unionByName(asked.where("reason is not null").select("upload_id", F.lit("rejected").alias("outcome"), "reason", F.lit(None).cast("string").alias("version_id")))


class UploadLog:
    """Versions of uploads in a VersionStore; a version's state changes by replacing its row."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = VersionStore(spark, root, {"versions": VERSIONS})

    def versions(self) -> DataFrame:
        return self.store.read("versions")

    def set_status(self, batch: str, version_ids: DataFrame, status: str) -> None:
        rows = self.versions().join(version_ids.select("version_id"), "version_id", "left_semi").withColumn("status", F.lit(status))
        self.store.commit(batch, {"versions": rows}, version_ids)

    def sink(self, deleted: DataFrame | None = None):
        """A foreachBatch function: accepted uploads become pending versions, each of a document of its own."""

        def write(batch: DataFrame, number: int) -> None:
            name = f"uploads-{number:012d}"
            if self.store.applied(name):
                return
            judged = judge_uploads(batch, self.versions(), deleted).where("outcome = 'accepted'")
            rows = batch.join(judged.select("upload_id", "version_id"), "upload_id").select(
                "version_id", "office_id", F.concat(F.lit("d-"), F.col("upload_id").cast("string")).alias("document_id"), "sha256", F.lit("pending").alias("status"), "uploaded_at"
            )
            rows = rows.persist()
            try:
                self.store.commit(name, {"versions": rows}, rows)
            finally:
                rows.unpersist()

        return write


def without_repeats(uploads: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of uploads without contents that came already within the watermark; empty files are told one by one."""
    return uploads.withWatermark("uploaded_at", late).dropDuplicatesWithinWatermark(["office_id", "sha256"])

