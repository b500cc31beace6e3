"""What changes from run to run, as a stream over the runs as they land."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeloom.functions.text import norm_title
from noticeloom.streaming.incremental import RUN_STAMPS

#: Keeps state on disk, not in the memory of the executors.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Of the state, which every batch writes to the shared folder, the last batches stay, to go on after a failure.
#: It is written compressed well, as it is read by the next batch only.
STATE_KEPT = {
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


def keep_state_on_disk(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)
    for key, value in STATE_KEPT.items():
        spark.conf.set(key, value)


def content_hash(columns: Sequence[str]):
    """One number for what counts as the content of a notice. It is only compared with that of the same notice in
    another run, so 64 bits tell all changes but one in 2 to the 64th."""
    return F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def compared_runs(found: DataFrame, every: timedelta, late: timedelta, key: str = "utility_id",
                  content: Sequence[str] | None = None) -> DataFrame:
    """The notices of complete runs beside those of the runs up to ``every`` before, as a stream.

    ``found`` is a stream of the notices of regular runs: ``run_ts`` (timestamp of the run), ``key``,
    ``title``, ``seq`` and the content. A run is complete when a run more than ``late`` after it has
    landed. Its files may land in any order, twice, or after those of the next run; what
    lands later than that is dropped and counted in the query's progress. Of equal titles of a run
    the first counts, as in ``snapshot_diff``.

    A row is a notice of a run (``run_ts``, ``now``) with what it was before (``before_ts``, ``was``), NULL where
    no such run had it; or what was before with no run ``every`` on that has it. All rows of
    a notice's run come in one batch.

    Copies are merged within tasks before they move, and what moves is a hash. State is kept and met in
    the JVM and ends a run later, so it has the size of the last runs, not of the history.
    """
    if content is None:
        content = [c for c in found.columns if c not in (key, "title", *RUN_STAMPS, "run_ts")]
    # A join of streams still waits for a run at the watermark itself, though such a run is complete; a
    # millisecond less has it see that no run will follow.
    delay = max(late // timedelta(milliseconds=1) - 1, 0)
    firsts = (
        found.withColumn("norm_title", norm_title(F.col("title")))
        .withWatermark("run_ts", f"{delay} milliseconds")
        .groupBy("run_ts", F.col(key).alias("key"), "norm_title")
        .agg(F.min(F.struct("seq", content_hash(content).alias("now"))).alias("first"))
        .select("run_ts", "key", "norm_title", F.col("first.now").alias("now"))
    )
    before = firsts.select(F.col("run_ts").alias("before_ts"), F.col("key").alias("before_key"),
                           F.col("norm_title").alias("before_title"), F.col("now").alias("was"))
    return before.join(firsts, F.expr(f"""
        before_key <=> key AND before_title <=> norm_title
        AND before_ts < run_ts AND before_ts >= run_ts - {_interval(every)}"""), "full_outer")


def _interval(span: timedelta) -> str:
    return f"INTERVAL {span // timedelta(microseconds=1)} MICROSECONDS"


def notice_changes(compared: DataFrame, every: timedelta, key: str = "utility_id") -> DataFrame:
    """Notices that are new, gone, changed or back, by issuer and normalised title, of a batch of ``compared_runs``.

    A notice that no run up to ``every`` later has is gone as of then; if it comes back it is new.
    Where more than one run came before, the last one counts.
    """
    gone = F.col("run_ts").isNull()
    known = compared.select(
        F.when(gone, F.col("before_key")).otherwise(F.col("key")).alias(key),
        F.when(gone, F.col("before_title")).otherwise(F.col("norm_title")).alias("norm_title"),
        F.when(gone, F.expr(f"before_ts + {_interval(every)}")).otherwise(F.col("run_ts")).alias("run_ts"),
        gone.alias("gone"), "now", F.struct("before_ts", "was").alias("before"))
    was = F.col("before.was")
    change = F.when(F.col("gone"), "gone").when(was.isNull(), "new").when(was != F.col("now"), "changed")
    return (
        known.groupBy(key, "norm_title", "run_ts", "gone").agg(
            F.first("now").alias("now"), F.max("before").alias("before"))
        .select(key, "norm_title", "run_ts", change.alias("change")).where("change IS NOT NULL")
    )


def follow_runs(spark: SparkSession, source: str, schema: str, out: str, progress: str,
                every: timedelta, late: timedelta, key: str = "utility_id",
                content: Sequence[str] | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Read the run files that have landed since the last call, and return all changes so far.

    A call ends when everything that has landed is worked off; ``progress`` keeps the place in the source
    and the state. Results are written by batch, so a batch that is repeated after a failure replaces its own.
    """
    keep_state_on_disk(spark)
    stream = spark.readStream.schema(schema)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    compared = compared_runs(stream.parquet(source), every, late, key, content)

    def batch(df: DataFrame, batch_id: int) -> None:
        notice_changes(df, every, key).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (compared.writeStream.outputMode("append").foreachBatch(batch)
             .option("checkpointLocation", progress).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(notice_changes(compared, every, key).schema).parquet(f"{out}/batch=*")
