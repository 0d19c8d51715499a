"""State folded from events: jobs with leases, sliding failures, conversations. Batch and streaming share the logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import backoff_seconds

# Fixed values of the queue and the lockout.
LEASE_SECONDS, MOST_ATTEMPTS = 120, 3
LOCKOUT_FAILURES, LOCKOUT_MINUTES = 10, 15


def job_state(events: DataFrame, now) -> DataFrame:
    """Each job's state at a time, from its events (job_id, ts, action in claim, heartbeat, done, fail).

    done is final; a job whose attempts are used up fails once its lease is over
    or its last attempt failed; an expired lease makes it claimable again; a
    failed attempt waits for its backoff.
    """
    at = F.lit(now).cast("timestamp_ntz")
    last = F.max_by(F.struct("action", "ts"), F.struct("ts", "action"))
    folded = events.where(F.col("ts") <= at).groupBy("job_id").agg(F.count_if(F.col("action") == "claim").alias("attempts"), F.bool_or(F.col("action") == "done").alias("done"), last.alias("last"))
    lease = F.col("last.ts") + F.make_interval(secs=F.lit(LEASE_SECONDS))
    retry = F.col("last.ts") + F.make_interval(secs=backoff_seconds(F.col("attempts")))
    used = F.col("attempts") >= MOST_ATTEMPTS
    state = (
        F.when(F.col("done"), "done")
        .when((F.col("last.action") == "fail") & used, "failed")
        .when((F.col("last.action") == "fail") & (retry > at), "waiting")
        .when(F.col("last.action") == "fail", "queued")
        .when(lease > at, "running")
        .when(used, "failed")
        .otherwise("queued")
    )
    return folded.select("job_id", "attempts", state.alias("state"))


def claimable(states: DataFrame, created: DataFrame, most: int = 1) -> DataFrame:
    """The oldest queued jobs."""
    return created.join(states, "job_id", "left").where(F.coalesce("state", F.lit("queued")) == "queued").orderBy("created_at", "job_id").limit(most)


def rolling_failures(events: DataFrame, key: str, minutes: int = LOCKOUT_MINUTES) -> DataFrame:
    """Each failure with the number of its key's failures in the minutes up to it."""
    span = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-minutes * 60_000_000, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(span)).withColumn("locked", F.col("recent") >= LOCKOUT_FAILURES)


def streaming_failures(events: DataFrame, key: str, late: str = "30 minutes") -> DataFrame:
    """The streaming form: sliding windows of 15 minutes, every minute, over event time, late rows within the watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{LOCKOUT_MINUTES} minutes", "1 minute"), key)
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(F.col("window.end").alias("until"), key, "failures", (F.col("failures") >= LOCKOUT_FAILURES).alias("locked"))
    )


def carry_forward(turns: DataFrame, columns: list[str]) -> DataFrame:
    """Conditions of a conversation's turn: its own, else the last stated before it."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "turn", *(F.last(c, ignorenulls=True).over(so_far).alias(c) for c in columns))


def stream_conversations(turns: DataFrame, columns: list[str]) -> DataFrame:
    """The streaming form: each conversation's last stated conditions (strings) are keyed state, turns come in order of their number
    within a batch; a turn that arrives after a later one finds that one's state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    fields = ", ".join(f"{c} string" for c in columns)

    def fold(key, batches, state):
        known = list(state.get) if state.exists else [None] * len(columns)
        for batch in batches:
            out = []
            for row in batch.sort_values("turn").to_dict("records"):
                known = [row[c] if isinstance(row[c], str) else k for c, k in zip(columns, known, strict=True)]
                out.append((key[0], row["turn"], *known))
            yield pd.DataFrame(out, columns=["conv_id", "turn", *columns])
        state.update(tuple(known))

    own = turns.select("conv_id", "turn", *columns)
    return own.groupBy("conv_id").applyInPandasWithState(fold, f"conv_id long, turn long, {fields}", fields, "append", GroupStateTimeout.NoTimeout)


def publish_batch(path: str):
    """A foreachBatch sink that replaces whole versions, so a batch that is run again changes nothing."""
    from ..sources.files import write_version

    return lambda batch, _: write_version(batch, path)


def publish_stages(store, stages, name: str):
    """A foreachBatch sink that publishes a batch's versions (version_id) in all tables of a VersionStore at once.

    stages makes each table's rows from the batch. A batch that failed between its
    stages is unseen; the stream's next start runs it again under the same name.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            store.commit(f"{name}-{number:012d}", stages(batch), batch.select("version_id"))
        finally:
            batch.unpersist()

    return sink
