"""The incremental jobs as Structured Streaming queries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as K
from ..operators import dedup, outputs as O, replay

_LINES = "bucket long, clock timestamp, ts_ns long, seq long, line string, n long"
_STATE = "ts_ns array<long>, seq array<long>, line array<string>"
_SEEN = "name string, seq long"


def live_windows(
    lines: DataFrame, delay: str = "10 minutes", width_seconds: int = K.WINDOW_SECONDS,
    limit: int = K.WINDOW_LINE_LIMIT,
) -> DataFrame:
    """Latest error lines per window over a stream of (seq, ts, ts_ns, line).

    Rows are (bucket, rn, line, n). A window's lines are sent, the latest with rn 1, once the
    watermark has passed its end. A line that comes after that is sent at once with a null rn, so
    none gets lost unseen; ``n`` is the number of lines that such a row stands for.
    ``open_windows`` has those whose end the watermark has not reached. Each task first keeps the
    ``limit`` latest lines per window of its own batch, so a burst in one window stays small on
    the way to its state, and the state itself never holds more than ``limit`` lines.

    Lines carry no event time of their own on the way: Spark would drop late ones before they
    are seen. A row without a window per batch of rows carries the clock that moves the watermark.
    """

    def keep_latest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            rows = rows.sort_values(["ts_ns", "seq"], ascending=[False, True])
            groups = rows.groupby("bucket", sort=False)
            kept = groups.head(limit).copy()
            kept["n"] = 1
            first = ~kept["bucket"].duplicated()
            sizes = kept["bucket"].map(groups.size())
            kept.loc[first, "n"] = (sizes - sizes.clip(upper=limit) + 1)[first]
            kept["clock"] = pd.NaT
            tick = pd.DataFrame({"clock": [rows["ts"].max()]})
            yield pd.concat([kept, tick])[["bucket", "clock", "ts_ns", "seq", "line", "n"]].astype(
                {c: "Int64" for c in ("bucket", "ts_ns", "seq", "n")})

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None or pd.isna(key[0]):
            return  # the clock
        bucket = int(key[0])
        held = list(zip(*state.get)) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield _numbered(bucket, [line for _, _, line in held])
            return
        end_ms = (bucket + 1) * width_seconds * 1000
        if end_ms <= state.getCurrentWatermarkMs():
            for rows in batches:
                yield pd.DataFrame({"bucket": bucket, "rn": pd.array([None] * len(rows), "Int32"),
                                    "line": rows["line"].to_numpy(), "n": rows["n"].to_numpy()})
            return
        for rows in batches:
            held += zip(rows["ts_ns"], rows["seq"], rows["line"])
        held = heapq.nsmallest(limit, held, key=lambda x: (-x[0], x[1]))
        state.update(tuple([type_(v) for v in column] for type_, column in
                           zip((int, int, str), zip(*held))))
        state.setTimeoutTimestamp(end_ms)

    errors = replay.error_lines(lines).select(
        replay.bucket_of(F.col("ts_ns"), width_seconds).alias("bucket"), "ts", "ts_ns", "seq", "line")
    latest = errors.mapInPandas(keep_latest, _LINES).withWatermark("clock", delay)
    return latest.groupBy("bucket").applyInPandasWithState(
        update, "bucket long, rn int, line string, n long", _STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def _numbered(bucket: int, lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"bucket": bucket, "rn": range(1, len(lines) + 1), "line": lines, "n": 1})


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows a stopped stream still holds, as (bucket, rn, line, n) rows like its own: read
    from its state, which stays as it is, so the stream may be started again."""
    state = spark.read.format("statestore").load(checkpoint)
    held = F.arrays_zip("value.groupState.ts_ns", "value.groupState.seq", "value.groupState.line")
    return state.select(F.col("key.bucket").alias("bucket"), F.posexplode(held).alias("at", "held")).select(
        "bucket", (F.col("at") + 1).alias("rn"), F.col("held.line").alias("line"), F.lit(1).cast("long").alias("n"))


def late_lines(rows: DataFrame) -> DataFrame:
    """(bucket, lines) of the windows that lines came too late for, and how many."""
    return rows.where("rn IS NULL").groupBy("bucket").agg(F.sum("n").alias("lines"))


def windows_from_lines(latest: DataFrame, width_seconds: int = K.WINDOW_SECONDS) -> DataFrame:
    """(index, end_ns, samples, family) from finished (bucket, rn, line) rows, as the batch job has
    them; late lines stay out."""
    return replay.numbered_windows(replay.collect_windows(latest.where("rn IS NOT NULL"), width_seconds))


def candidate_intake(stream: DataFrame, accepted_path: str, checkpoint: str) -> DataStreamWriter:
    """Accept candidates whose content is new: (seq, name, signature) rows, appended to a folder.

    A keyed state holds each accepted signature, so a batch reads itself and the state of its own
    signatures, never what was accepted before. Of twins in one batch the first in input order is
    taken. A retried batch is committed once, by the file sink's log.
    """

    def first_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values("seq").drop_duplicates("signature")

    def take(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        seq, name = min((int(s), n) for rows in batches for s, n in zip(rows["seq"], rows["name"]))
        state.update((name, seq))
        yield pd.DataFrame({"seq": [seq], "name": [name], "signature": [key[0]]})

    signed = dedup.with_signature(stream).select("seq", "name", "signature")
    columns = "seq long, name string, signature string"
    fresh = signed.mapInPandas(first_of_batch, columns).groupBy("signature").applyInPandasWithState(
        take, columns, _SEEN, "append", GroupStateTimeout.NoTimeout)
    return fresh.writeStream.format("parquet").outputMode("append").option(
        "path", accepted_path).option("checkpointLocation", checkpoint)


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """Candidates accepted so far: (seq, name, signature)."""
    schema = "seq long, name string, signature string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def score_trials(trials: DataFrame, scenarios: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Score trials as they arrive and append them: a stream-static join, no state."""
    return O.trial_results(trials, scenarios).writeStream.format("parquet").outputMode(
        "append").option("path", path).option("checkpointLocation", checkpoint).partitionBy("run")
