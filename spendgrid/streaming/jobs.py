"""Streaming forms: continuous scoring, current job state, usage per day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spendgrid.functions import text as X
from spendgrid.operators.encoding import Encoder, char_encoder
from spendgrid.plans.classify import classify
from spendgrid.session import ship_package
from spendgrid.sources import versions
from spendgrid.sources.versions import newest_rows


AVAILABLE = {"availableNow": True}


def score_stream(transactions: DataFrame, model: DataFrame, target: str, checkpoint: str, encoder: Encoder = char_encoder,
                 config: X.CleaningConfig = X.CleaningConfig(), trigger: dict = AVAILABLE) -> StreamingQuery:
    """Score every micro-batch against a static model and append to ``target``.

    ``trigger`` is what Spark's trigger takes, ``{"processingTime": "1 minute"}`` say.  Transfers are left
    out: pairing needs all rows of a key, not those of one batch.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        scored = classify(batch, model, encoder=encoder, config=config, transfers=False)
        scored.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (transactions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


FINISHED = ("COMPLETED", "FAILED")


JOB_SLOTS = 4096  # groups of jobs that share one entry of the state
JOB_COLUMNS = ["job_id", "updated_at", "event_seq", "status"]
NO_SEQ = -(1 << 63)  # a missing number comes first; nulls would turn the numbers of a frame into floats


def _newest_jobs(before: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
    """The last row of every job by time, number and status; of equal ones the one that was there before."""
    rows = pd.concat([frame.assign(_new=True), before])
    rows = rows.sort_values([*JOB_COLUMNS[1:], "_new"], ascending=[True, True, True, False], na_position="first", kind="stable")
    return rows.drop_duplicates("job_id", keep="last")


def _newest_of_jobs(retention_ms: int):
    """All jobs of a slot at once: a call, a state and a frame for each job would cost more than the comparison itself."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = list(state.get) if state.exists else [[], [], [], []]
        jobs = pd.DataFrame(dict(zip(JOB_COLUMNS, held))).astype({"updated_at": "int64", "event_seq": "int64"}).assign(_new=False)
        for frame in () if state.hasTimedOut else frames:
            frame = frame[JOB_COLUMNS].assign(updated_at=frame["updated_at"].astype("datetime64[us]").astype("int64"))
            jobs = _newest_jobs(jobs, frame[frame["updated_at"] >= watermark * 1000])  # a popular job is one row after each frame
        changed = jobs[jobs["_new"].astype(bool)]
        ends = (jobs["updated_at"] // 1000 + retention_ms).where(jobs["status"].isin(FINISHED))
        stays = ~(ends < watermark)
        if changed.empty and stays.all() and not state.hasTimedOut:
            return
        if not stays.any():
            if state.exists:
                state.remove()
        else:
            state.update(tuple(jobs.loc[stays, c].tolist() for c in JOB_COLUMNS))
            if ends[stays].notna().any():
                state.setTimeoutTimestamp(max(int(ends[stays].min()), watermark + 1))
        if not changed.empty:
            yield pd.DataFrame({"job_id": changed["job_id"], "updated_at": pd.to_datetime(changed["updated_at"], unit="us"),
                                "event_seq": changed["event_seq"].astype("Int64").mask(changed["event_seq"] == NO_SEQ), "status": changed["status"]})
    return step


def job_state_stream(events: DataFrame, lateness: str = "1 hour", retention_ms: int = 86_400_000, slots: int = JOB_SLOTS) -> DataFrame:
    """Newest status per job for update mode; late and out-of-order events cannot move a job back.

    A finished job leaves the state once the watermark is ``retention_ms`` past its last event.  Events
    behind the watermark are dropped, so what comes for a job that has left is newer than all it had.
    Jobs are dealt by hash to ``slots`` entries of the state, each a list of its jobs; a checkpoint keeps the number it began with.
    """
    ship_package(events.sparkSession)
    timed = events.select("job_id", F.col("updated_at").cast("timestamp").alias("updated_at"),
                          F.coalesce(F.col("event_seq").cast("long"), F.lit(NO_SEQ)).alias("event_seq"), "status",
                          F.pmod(F.xxhash64("job_id"), F.lit(slots)).alias("_slot"))
    return timed.withWatermark("updated_at", lateness).groupBy("_slot").applyInPandasWithState(
        _newest_of_jobs(retention_ms), "job_id string, updated_at timestamp, event_seq long, status string",
        "job_id array<string>, updated_at array<long>, event_seq array<long>, status array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def usage_stream(calls: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Requests per day and user; calls later than the watermark are dropped."""
    timed = calls.withColumn("called_at", F.col("called_at").cast("timestamp")).withWatermark("called_at", lateness)
    counted = timed.groupBy(F.window("called_at", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(F.col("window.start").alias("day"), "user_id", "requests")


def run_updates(stream: DataFrame, target: str, checkpoint: str, keys: list[str], fold_after: int = versions.FOLD_AFTER,
                trigger: dict = AVAILABLE) -> StreamingQuery:
    """Run an update-mode query over what is available; its updates are a table of versions by batch number.

    A batch that runs again replaces itself.  Batches before it are folded to the newest update of each key
    when they are many.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        name = f"{batch_id:012d}"
        versions.fold_if_long(batch.sparkSession, target, lambda rows: newest_rows(rows, keys, ["batch_id"]), fold_after, [name])
        versions.append(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), target, name)

    query = (stream.writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", checkpoint).trigger(**trigger).start())
    query.awaitTermination()
    return query


def newest_updates(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    return newest_rows(versions.read(spark, target), keys, ["batch_id"]).drop("batch_id")
