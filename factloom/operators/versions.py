"""Current state from append-only logs: latest versions, upserts, tombstones, corrections, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order; Spark keeps only such rows before the shuffle."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def latest_value(rows: DataFrame, key: str, by: Column, *columns: str) -> DataFrame:
    """An upsert's outcome: each key's columns at its largest order value, by one aggregation without a sort."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), by).alias("v"))
    return best.select(key, "v.*")


def insert_absent(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key the target lacks, one per key."""
    return new.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def mark_current(versions: DataFrame, published: Column) -> DataFrame:
    """is_current and state of each version: only the newest published one is current, whenever it finished."""
    newest = F.max(F.when(published, F.col("version_no"))).over(Window.partitionBy("document_id"))
    current = published & (F.col("version_no") == newest)
    return versions.withColumn("is_current", F.coalesce(current, F.lit(False))).withColumn("state", F.when(F.col("is_current"), "current").when(published & (F.col("version_no") < newest), "superseded").otherwise("pending"))


def without_deleted(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def apply_corrections(facts: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Facts (keys, value) overlaid by the latest correction (keys, value, at), with the earlier values as history."""
    last = corrections.groupBy(*keys).agg(F.max_by("value", "at").alias("corrected"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("changes"))
    joined = facts.join(last, keys, "left")
    history = F.when(F.col("corrected").isNull(), F.array().cast(facts.select(F.array("value").alias("v")).schema["v"].dataType)).otherwise(
        F.concat(F.array("value"), F.transform(F.slice("changes", 1, F.greatest(F.size("changes") - 1, F.lit(0))), lambda c: c["value"]))
    )
    return joined.select(*keys, F.coalesce("corrected", "value").alias("value"), history.alias("previous"))


def review_status(initial: DataFrame, events: DataFrame) -> DataFrame:
    """Each occurrence's status after its last review event (approve, reject, correct)."""
    states = {"approve": "human_verified", "reject": "rejected", "correct": "corrected"}
    mapping = F.create_map(*(F.lit(x) for pair in states.items() for x in pair))
    last = events.groupBy("occurrence_id").agg(F.max_by(F.try_element_at(mapping, F.col("action")), "at").alias("reviewed"))
    return initial.join(last, "occurrence_id", "left").select("occurrence_id", F.coalesce("reviewed", "status").alias("status"))


def version_status(occurrences: DataFrame, versions: DataFrame, open_pairs: DataFrame) -> DataFrame:
    """Counts and status of each version; open_pairs is (version_id) with an undecided pair both of whose ends are current."""
    counts = occurrences.groupBy("version_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "needs_review").alias("review"))
    waiting = open_pairs.select("version_id").distinct().withColumn("pair", F.lit(True))
    joined = versions.join(counts, "version_id", "left").join(waiting, "version_id", "left")
    needs = (F.coalesce("review", F.lit(0)) > 0) | F.col("pages_incomplete") | F.coalesce("pair", F.lit(False))
    return joined.select("version_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("review", F.lit(0)).alias("review"), F.when(needs, "needs_review").otherwise("ready").alias("status"))


def clone_outputs(rows: DataFrame, source: str, target: str) -> DataFrame:
    """The outputs of one version under another version's id, for a file that is already known."""
    return rows.where(F.col("version_id") == F.lit(source)).withColumn("version_id", F.lit(target))
