"""Scoring log files as they land, with a running accuracy per subset.

A file source picks up new JSON files in the log folder (not lines appended
to an old file, which is why logs are written as new part files). Each
micro-batch is scored with native expressions and folded into a per-subset
running aggregate kept in the state store; the complete result of every
batch replaces a small Parquet table, written with ``foreachBatch`` so the
report never passes through the driver. The checkpoint lives in the shared
folder, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import report, score
from ..session import parallelism
from ..sources.runlog import LOG_SCHEMA


HORIZON = "1 hour"
KEYS = ["subset", "run_id", "id"]


def scored_stream(
    spark: SparkSession,
    log_path: str,
    mode: str | bool = "direct",
    dedupe: bool = False,
    max_files_per_trigger: int | None = None,
    fmt: str = "json",
    horizon: str = HORIZON,
) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if fmt == "json":
        rows = reader.option("mode", "FAILFAST").json(log_path)
    else:
        rows = reader.format(fmt).load(log_path)
    if dedupe:
        # the first line seen of an item and run; unlike the batch report, where a
        # repeated line counts again. A key leaves the state once files are newer than its
        # file by the horizon, so the state holds the lines of that time alone
        rows = rows.withColumn("_landed", F.col("_metadata.file_modification_time")).withWatermark(
            "_landed", horizon).dropDuplicatesWithinWatermark(KEYS)
    return score(rows, mode)


def running_report(scored: DataFrame) -> DataFrame:
    return scored.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").cast("long").alias("n_correct"),
        F.avg("correct").alias("avg_score"),
    )


def first_lines(spark: SparkSession, seen_path: str):
    """``foreachBatch`` function that adds a batch's scored lines to the Parquet table at
    ``seen_path`` but for those it holds: repeats that come after the stream's state has
    let go of their key are found by this anti-join. A batch that is run again replaces
    what it wrote before."""
    def add(batch: DataFrame, epoch: int) -> None:
        folder = f"{seen_path.rstrip('/')}/epoch={epoch}"
        try:
            seen = batch.sparkSession.read.parquet(seen_path).where(F.col("epoch") != epoch).select(*KEYS)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            seen = None
        # null ids and runs are keys like others
        key = F.to_json(F.struct(*KEYS), {"ignoreNullFields": "false"})
        fresh = batch.select(*KEYS, "prediction", "correct").withColumn("_key", key)
        if seen is not None:
            fresh = fresh.join(seen.select(key.alias("_key")), "_key", "left_anti")
        fresh.drop("_key").write.mode("overwrite").parquet(folder)

    return add


def deduped_report(
    spark: SparkSession, log_path: str, seen_path: str, checkpoint: str, mode: str | bool = "direct",
    horizon: str = HORIZON, max_files_per_trigger: int | None = None, fmt: str = "json",
) -> DataFrame:
    """``run_id, subset, n, n_correct, avg_score`` of the first line of each item and run,
    after all files present now."""
    scored = scored_stream(spark, log_path, mode, True, max_files_per_trigger, fmt, horizon)
    query = (scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
             .foreachBatch(first_lines(spark, seen_path)).trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return report(spark.read.parquet(seen_path), by=("run_id", "subset"))


def score_stream(
    spark: SparkSession,
    log_path: str,
    report_path: str,
    checkpoint: str,
    mode: str | bool = "direct",
    dedupe: bool = False,
    available_now: bool = True,
    processing_time: str | None = None,
    fmt: str = "json",
    state_partitions: int | None = None,
):
    """Start the streaming report; returns the ``StreamingQuery``.

    The number of state-store partitions is fixed when a checkpoint is first
    created (from ``spark.sql.shuffle.partitions``); a per-subset report needs
    few, so it is set explicitly for this query's start (default: the
    cluster's cores, at most 64; more when ``dedupe`` keeps per-item state).
    """
    agg = running_report(scored_stream(spark, log_path, mode, dedupe, fmt=fmt))
    if state_partitions is None:
        state_partitions = parallelism(spark) if dedupe else min(parallelism(spark), 64)

    def publish(batch: DataFrame, _epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(report_path)

    writer = (
        agg.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)


def stream_report_once(
    spark: SparkSession,
    log_path: str,
    report_path: str,
    checkpoint: str,
    mode: str | bool = "direct",
    dedupe: bool = False,
    fmt: str = "json",
) -> DataFrame:
    """Process every file present now, then return the report table."""
    q = score_stream(
        spark, log_path, report_path, checkpoint, mode, dedupe, available_now=True, fmt=fmt
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(report_path)
