"""Sinks: trials, raw outputs, candidates, chat files, markdown reports, and resuming."""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter


class Sink(Protocol):
    """Where result rows go. An own sink is any object with this method; it has to bear being
    called again with a batch it has already taken, in full or in part."""

    def write(self, rows: DataFrame, batch: str) -> None: ...


class CommittedFolder:
    """A Parquet folder to which each batch is added once, however often it is written.

    The rows of a batch are staged in a folder of their own under ``data``. Then a file that bears
    the batch's name and tells that folder is moved to ``commits``, in one step: from that moment on
    the batch is part of the table. A job that dies before leaves a stage nobody reads; the batch is
    then written anew. A batch that is committed already is skipped. ``read`` opens the committed
    stages only, ``discard_stages`` deletes the others.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by = spark, path, partition_by

    def write(self, rows: DataFrame, batch: str) -> None:
        if batch in self.commits():
            return
        self.commit(batch, self.stage(rows, batch))

    def stage(self, rows: DataFrame, batch: str) -> str:
        """Writes the rows where no reader sees them yet; returns the stage's name."""
        stage = f"{batch}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*self.partition_by).parquet(f"{self.path}/data/__stage={stage}")
        return stage

    def commit(self, batch: str, stage: str) -> None:
        """Makes a stage part of the table, unless another stage of that batch already is."""
        files, path = self._files()
        draft, final = path(f"commits/.{stage}"), path(f"commits/{batch}")
        out = files.create(draft, True)
        out.write(bytearray(stage.encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)

    def commits(self) -> dict[str, str]:
        """Stage by batch, as far as committed; one small file each."""
        files, path = self._files()
        if not files.exists(path("commits")):
            return {}
        found = {}
        for status in files.listStatus(path("commits")):
            name = status.getPath().getName()
            if not name.startswith("."):
                stream = files.open(status.getPath())
                found[name] = bytes(stream.readAllBytes()).decode()
                stream.close()
        return found

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        stages = sorted(set(self.commits().values()))
        if not stages:
            raise FileNotFoundError(f"nothing is committed in {self.path}")
        base = f"{self.path}/data"
        return self.spark.read.option("basePath", base).parquet(
            *[f"{base}/__stage={stage}" for stage in stages]).drop("__stage")

    def discard_stages(self) -> int:
        """Deletes what jobs that died have left; not to be called while one writes."""
        files, path = self._files()
        kept, gone = set(self.commits().values()), 0
        for status in files.listStatus(path("data")) if files.exists(path("data")) else []:
            if status.getPath().getName().partition("=")[2] not in kept:
                files.delete(status.getPath(), True)
                gone += 1
        return gone

    def _files(self):
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return (make(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()),
                lambda name: make(f"{self.path}/{name}"))


def trial_sink(spark: SparkSession, path: str) -> CommittedFolder:
    """Trial rows, one folder per run."""
    return CommittedFolder(spark, path, ("run",))


def raw_output_sink(spark: SparkSession, path: str) -> CommittedFolder:
    """The fact table with the raw text, so that scores can be looked into later."""
    return CommittedFolder(spark, path, ("arm",))


def stream_to(rows: DataFrame, sink: Sink, checkpoint: str, name: str = "batch") -> DataStreamWriter:
    """Streams rows into any sink; a batch keeps its number when it is tried again."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: sink.write(batch, f"{name}-{number}"))


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Survivors in the file layout, one JSON object per line."""
    candidates.select(
        F.col("seq").alias("input_seq"), "name", "question", "rubric", "source", "alert",
        F.col("log_samples").alias("logSamples"), F.col("log_environment").alias("logEnvironment"),
        "expected", "axis").write.mode("overwrite").json(path)


def write_chat(samples: DataFrame, path: str) -> None:
    """Chat samples as JSON lines, one folder per split."""
    samples.select("split", F.to_json(F.struct("messages")).alias("value")).write.mode(
        "overwrite").partitionBy("split").text(path)


def todo(scenarios: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Scenarios without results, in file order; ``limit`` stops after the first N."""
    left = scenarios.join(done.select(F.col("scenario").alias("name")).distinct(), "name", "left_anti")
    return left if limit is None else left.orderBy("seq").limit(limit)


def markdown(report: DataFrame, title: str, columns: list[str] | None = None) -> str:
    """Markdown table of a finished report (aggregate rows only)."""
    columns = columns or report.columns
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for row in report.select(*columns).collect():
        lines.append("| " + " | ".join(show(v) for v in row) + " |")
    return "\n".join(lines) + "\n"
