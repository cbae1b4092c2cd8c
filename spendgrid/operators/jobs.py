"""Asynchronous jobs as an append-only table of status events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid.sources.versions import newest_rows

STATE = ("updated_at", "event_seq", "user_id", "status", "result_data", "error")


def latest_state(events: DataFrame) -> DataFrame:
    """Newest event per job, whatever order the events arrived in."""
    return newest_rows(events.select("job_id", *STATE), ["job_id"], ["updated_at", "event_seq"]).select("job_id", *STATE)


def latest_by_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of every key of an append-only table."""
    return newest_rows(rows, [key], [version])


def status_view(state: DataFrame, requester: Column | None = None) -> DataFrame:
    """What a client sees of a job: processing, completed with its payload, failed, or an error.

    A requester other than the owner is refused first.  A payload that is no JSON object makes the
    job failed; a missing payload leaves it completed with a note.
    """
    payload = F.col("result_data")
    parsed = F.try_parse_json(payload)
    broken = payload.isNotNull() & parsed.isNull()
    denied = F.lit(False) if requester is None else ~requester.eqNullSafe(F.col("user_id"))
    running = F.col("status").isin("PENDING", "PROCESSING")
    done, failed = F.col("status") == "COMPLETED", F.col("status") == "FAILED"
    status = (F.when(denied, F.lit("error")).when(running, F.lit("processing"))
              .when(done & broken, F.lit("failed")).when(done, F.lit("completed"))
              .when(failed, F.lit("failed")).otherwise(F.lit("error")))
    message = (F.when(denied, F.lit("Access denied to job status."))
               .when(running, F.concat(F.lit("Job is currently "), F.lower("status"), F.lit(".")))
               .when(done & broken, F.lit("Failed to parse results from completed job."))
               .when(done & payload.isNull(), F.lit("Job completed but no result data found."))
               .when(failed, F.lit("Job processing failed."))
               .when(~done, F.concat(F.lit("Unknown or inconsistent job status: "), F.col("status"))))
    code = (F.when(denied, F.lit(403)).when(done & broken, F.lit(500))
            .when(~running & ~done & ~failed, F.lit(500)))
    shown = ~denied & done & ~broken
    return state.select(
        "job_id", "user_id", status.alias("client_status"), message.alias("message"), code.alias("error_code"),
        F.when(shown, payload).alias("payload"),
        F.when(~denied & failed, F.coalesce("error", F.lit("No error details provided."))).alias("error_details"))
