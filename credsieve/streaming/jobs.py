"""Incremental scans, new findings across batches, circuit breaker and rate limit, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalar import content_hash
from ..operators.findings import changed_files

FAILURES, COOL_SECONDS = 5, 60.0


def incremental_scan(spark: SparkSession, path: str, checkpoint: str, state_path: str, scan: Callable[[DataFrame], None]) -> StreamingQuery:
    """Scans files that are new or whose content has changed. scan gets (path, content_hash, content) of each batch; the state
    is a table of (path, content_hash) that grows by what was scanned, written after the scan, so a failed batch is scanned again.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(path).select("path", "content").withColumn("content_hash", content_hash(F.col("content")))

    def each(batch: DataFrame, _: int) -> None:
        try:
            state = spark.read.parquet(state_path)
        except Exception as e:  # no state yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            state = spark.createDataFrame([], "path string, content_hash string")
        fresh = changed_files(batch, state)
        scan(fresh)
        fresh.select("path", "content_hash").write.mode("append").parquet(state_path)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(findings: DataFrame, time_col: str, delay: str = "1 day") -> DataFrame:
    """Findings whose hash has not come before within the watermark."""
    return findings.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["finding_hash"])


def event_counts(events: DataFrame, time_col: str = "ts", delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, width), "event_type").agg(F.count("*").alias("n"))


def breaker_step(state: tuple[str, int, float], at: float, ok: bool, failures: int = FAILURES, cool: float = COOL_SECONDS) -> tuple[tuple[str, int, float], bool]:
    """The next state (closed, open or half_open; failures in a row; when it opened) and whether the call was let through."""
    kind, run, opened = state
    if kind == "open":
        if at - opened < cool:
            return state, False
        kind = "half_open"
    if ok:
        return ("closed", 0, 0.0), True
    run += 1
    if kind == "half_open" or run >= failures:
        return ("open", run, at), True
    return ("closed", run, 0.0), True


def bucket_step(state: tuple[float, float], at: float, rate: float, burst: float) -> tuple[tuple[float, float], bool]:
    """A token bucket: (tokens, time) after the call, and whether it was let through."""
    tokens, last = state
    tokens = min(burst, tokens + max(0.0, at - last) * rate)
    return ((tokens - 1, at), True) if tokens >= 1 else ((tokens, at), False)


_BREAKER = "provider string, ts timestamp, ok boolean, allowed boolean, state string"


def _fold(rows: pd.DataFrame, state: tuple[str, int, float]) -> tuple[pd.DataFrame, tuple[str, int, float]]:
    rows = rows.sort_values(["ts", "ok"], kind="stable")
    allowed, kinds = [], []
    for at, ok in zip(rows["ts"], rows["ok"]):
        state, let = breaker_step(state, at.timestamp(), bool(ok))
        allowed.append(let)
        kinds.append(state[0])
    return rows.assign(allowed=allowed, state=kinds)[["provider", "ts", "ok", "allowed", "state"]], state


def breaker_stream(attempts: DataFrame) -> DataFrame:
    """attempts: streaming (provider, ts, ok). What a breaker per provider does; batches must come in order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ("closed", 0, 0.0)
        out, held = _fold(pd.concat(list(batches)), tuple(held))
        state.update(held)
        yield out

    return attempts.groupBy("provider").applyInPandasWithState(run, _BREAKER, "kind string, run int, opened double", "append", GroupStateTimeout.NoTimeout)


def breaker_batch(attempts: DataFrame) -> DataFrame:
    """The same over a table: attempts of a provider in order of time."""
    return attempts.groupBy("provider").applyInPandas(lambda pdf: _fold(pdf, ("closed", 0, 0.0))[0], _BREAKER)


def limit_batch(calls: DataFrame, rate: float = 10.0, burst: float = 10.0) -> DataFrame:
    """calls: (provider, ts). Which of them a token bucket per provider lets through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        state, let = (burst, pdf["ts"].iloc[0].timestamp()), []
        for at in pdf["ts"]:
            state, ok = bucket_step(state, at.timestamp(), rate, burst)
            let.append(ok)
        return pdf.assign(allowed=let)[["provider", "ts", "allowed"]]

    return calls.groupBy("provider").applyInPandas(run, "provider string, ts timestamp, allowed boolean")
