"""Conversations as a stream of turns, in whatever order and batches they come.

The turns of a conversation and what was read from them are rows of a
VersionStore, where a conversation is what changes at once. A batch's turns are
added to those that are known and its conversations are read anew, so a turn that
comes late changes the follow-ups behind it, and the readings equal those of one
table with all turns. A turn may instead answer what was asked back: it fills in
the missing condition, for its question and the follow-ups that carry it on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.conditions import DATA_KINDS, DATE_FIELDS
from ..plans.question import NAMES, missing_conditions, read_questions
from ..rounds import checkpointed
from ..sources.store import VersionStore

TURNS = "version_id string, turn long, question string, asked_at timestamp, clarifies string, value string"
READINGS = "version_id string, turn long, asked_at timestamp, " + ", ".join(f"{n} {'int' if n.startswith('year') else 'string'}" for n in NAMES) + ", route string, unknown_place string, missing array<string>"
#: What may be asked back, and what it may be answered with.
CHOICES = {"data_kind": DATA_KINDS, "date_field": DATE_FIELDS}


def read_turns(turns: DataFrame, places: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """READINGS of whole conversations. A clarifying turn repeats the reading before it with the value filled in.

    A value that isn't among the choices, or that answers what wasn't asked, changes nothing.
    """
    c = F.col
    asked = turns.where("clarifies is null")
    read = read_questions(asked.select(c("version_id").alias("conversation_id"), "turn", "question"), places, known).withColumnRenamed("conversation_id", "version_id")
    rows = read.join(asked.select("version_id", "turn", "asked_at"), ["version_id", "turn"]).withColumns({"clarifies": F.lit(None).cast("string"), "value": F.lit(None).cast("string")})
    given = turns.where("clarifies is not null").select("version_id", "turn", "asked_at", "clarifies", "value")
    every = rows.unionByName(given, allowMissingColumns=True)

    order = Window.partitionBy("version_id").orderBy("turn")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    said = c("clarifies").isNull()
    # A question that carries nothing on begins a group; what is filled in holds within it.
    every = every.withColumn("begins", F.sum(F.when(said & (c("route") == "rules"), 1).otherwise(0)).over(upto))
    carried = [*NAMES, "route", "unknown_place", "missing"]
    last = F.last(F.when(said, F.struct(*carried)), ignorenulls=True).over(upto)
    every = every.withColumn("own", last)
    group = Window.partitionBy("version_id", "begins").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    fits = {n: F.when((c("clarifies") == n) & c("value").isin(*allowed) & F.array_contains("own.missing", n), c("value")) for n, allowed in CHOICES.items()}
    filled = {n: F.coalesce(c(f"own.{n}"), F.last(fits[n], ignorenulls=True).over(group)) for n in CHOICES}
    out = every.where("own is not null").select(
        "version_id", "turn", "asked_at", *(filled.get(n, c(f"own.{n}")).alias(n) for n in NAMES),
        F.when(said, c("own.route")).otherwise(F.concat("own.route", F.lit("+clarification"))).alias("route"), c("own.unknown_place").alias("unknown_place"),
    )
    return out.withColumn("missing", missing_conditions())


class Conversations:
    """Turns and readings of all conversations in one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = VersionStore(spark, root, {"turns": TURNS, "readings": READINGS})

    def sink(self, places: DataFrame, known: DataFrame | None = None):
        """A foreachBatch function over turns (conversation_id, turn, question, asked_at, clarifies, value); a turn that comes again counts once."""

        def write(batch: DataFrame, number: int) -> None:
            name = f"turns-{number:012d}"
            if self.store.applied(name):
                return
            new = batch.withColumnRenamed("conversation_id", "version_id").withColumn("version_id", F.col("version_id").cast("string"))
            new = checkpointed(new.where("version_id is not null and turn is not null").select("version_id", "turn", "question", "asked_at", "clarifies", "value"))
            before = self.store.read("turns").join(new.select("version_id").distinct(), "version_id", "left_semi")
            # Of turns with one number the known one stays, else the one asked first.
            either = before.withColumn("late", F.lit(0)).unionByName(new.withColumn("late", F.lit(1)))
            row = F.struct("question", "asked_at", "clarifies", "value")
            turns = checkpointed(either.groupBy("version_id", "turn").agg(F.min_by(row, F.struct("late", "asked_at", F.coalesce("question", F.lit("")))).alias("r")).select("version_id", "turn", "r.*"))
            self.store.commit(name, {"turns": turns, "readings": read_turns(turns, places, known)}, new)

        return write

    def readings(self) -> DataFrame:
        return self.store.read("readings")

    def pending(self, now, minutes: int = 30) -> DataFrame:
        """(version_id, turn, ask) of conversations that wait for an answer to what was asked back and haven't expired by then."""
        last = self.readings().groupBy("version_id").agg(F.max_by(F.struct("turn", "asked_at", "missing"), "turn").alias("r")).select("version_id", "r.*")
        fresh = F.col("asked_at") + F.make_interval(mins=F.lit(minutes)) > F.lit(now).cast("timestamp")
        return last.where((F.size("missing") > 0) & fresh).select("version_id", "turn", F.col("missing")[0].alias("ask"))
