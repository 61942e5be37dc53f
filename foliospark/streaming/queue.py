"""The command queue: a file stream into idempotent outcomes, its log, status and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.sources.ocr import COMMAND, resolve_command

OUTCOMES = ("ok", "command_error", "input_error", "validation_error", "pipeline_error")


def read_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Commands as they arrive, oldest first; files being written (.tmp) are not seen."""
    raw = spark.readStream.schema(COMMAND).option("multiLine", True).option("pathGlobFilter", "*.json").option(
        "maxFilesPerTrigger", per_trigger
    ).json(path)
    named = raw.withColumns(
        {"file_name": F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), "arrived_at": F.col("_metadata.file_modification_time")}
    )
    return resolve_command(named)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


#: Folders of the log: a batch reads only those of its requests.
BUCKETS = 256
LOG = "request_id string, state string, outcome string, batch long, bucket int"


def outcome(status: Column, corrupt: Column, named: Column, there: Column, failed: Column) -> Column:
    """One of OUTCOMES; ``named``: the command says which image, ``there``: it exists.  Only a result without any issue is ok."""
    return F.when(
        corrupt | ~named, "command_error"
    ).when(~there, "input_error").when(failed, "pipeline_error").when(status == "ok", "ok").otherwise("validation_error")


def run(commands: DataFrame, process: Callable[[DataFrame], DataFrame], log_path: str, checkpoint: str, once: bool = True):
    """Processes each request at most once.

    ``process`` turns claimed commands into rows with request_id and outcome.  A request is logged as
    started before its side effects, so a batch that runs again after a failure marks what it had begun
    as stale instead of repeating it.
    """

    def note(rows: DataFrame, state: str, outcome: Column, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS)).cast("int")
        row = rows.select(
            "request_id", F.lit(state).alias("state"), outcome.cast("string").alias("outcome"),
            F.lit(batch_id).cast("long").alias("batch"), bucket.alias("bucket")
        )
        row.write.mode("append").partitionBy("bucket").parquet(log_path)

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        asked = rows.select(F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct().collect()
        log = spark.read.schema(LOG).parquet(log_path) if exists(spark, log_path) else spark.createDataFrame([], LOG)
        mine = log.where(F.col("bucket").isin([r.bucket for r in asked]))
        seen = mine.select("request_id").distinct()
        again = rows.select("request_id").distinct().join(seen, "request_id", "left_semi").join(
            mine.where("state = 'done'").select("request_id"), "request_id", "left_anti"
        )
        # Tables of their own: what reads the log would change as the log is written.
        parts = {"stale": again, "new": rows.join(seen, "request_id", "left_anti").dropDuplicates(["request_id"])}
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{log_path}-claims/{batch_id}/{name}")
            parts[name] = spark.read.schema(part.schema).parquet(f"{log_path}-claims/{batch_id}/{name}")
        note(parts["stale"], "done", F.lit("stale"), batch_id)
        note(parts["new"], "started", F.lit(None), batch_id)
        note(process(parts["new"]), "done", F.col("outcome"), batch_id)

    writer = commands.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def fifo(commands: DataFrame, keys: tuple[str, str] = ("arrived_at", "file_name"), owner: str = "owner") -> DataFrame:
    """The place of each command in its owner's queue; a file without a time comes first."""
    return commands.withColumn("position", F.row_number().over(Window.partitionBy(owner).orderBy(*[F.col(k).asc_nulls_first() for k in keys])))


def service_status(log: DataFrame, key: str | None = None) -> DataFrame:
    """Counters and the last request of the log (request_id, finished_at, outcome)."""
    ok, when = F.col("outcome") == "ok", F.struct("finished_at", "request_id")
    last = {
        "last_success_at": F.max(F.when(ok, F.col("finished_at"))),
        "last_error_at": F.max(F.when(~ok, F.col("finished_at"))),
        "last_error_status": F.max_by(F.when(~ok, F.col("outcome")), F.when(~ok, when))
    }
    aggs = [
        F.count_if(ok).alias("processed"), F.count_if(~ok).alias("errors"), *[v.alias(n) for n, v in last.items()],
        F.max("finished_at").alias("last_finished_at"),
        F.max_by("request_id", F.struct("finished_at", "request_id")).alias("last_request_id")
    ]
    return log.groupBy(*([key] if key else [])).agg(*aggs)


def expired_by_days(listing: DataFrame, today: Column, days: int) -> DataFrame:
    """Days of the archive older than ``days``; 0 or less turns it off."""
    return listing.where(F.lit(days > 0) & (F.col("day") < F.date_sub(today, days)))


def expired_by_size(listing: DataFrame, most: int, key: str) -> DataFrame:
    """The oldest cases whose removal brings each archive (``key``) to at most ``most`` bytes."""
    newer = Window.partitionBy(key).orderBy("day", "mtime", "path").rowsBetween(0, Window.unboundedFollowing)
    return listing.withColumn("kept_bytes", F.sum("size_bytes").over(newer)).where(F.col("kept_bytes") > most)


def archive_removals(listing: DataFrame, today: Column, days: int, most: int, key: str) -> DataFrame:
    """What goes from each archive: cases older than ``days``, then the oldest of the others until ``most`` bytes are left; 0 or less turns either off."""
    old = F.lit(days > 0) & (F.col("day") < F.date_sub(today, days))
    left = listing.where(~old)
    big = expired_by_size(left, most, key).drop("kept_bytes") if most > 0 else left.limit(0)
    return listing.where(old).withColumn("reason", F.lit("days")).unionByName(big.withColumn("reason", F.lit("size")))


def expired_results(listing: DataFrame, now: Column, days: int) -> DataFrame:
    return listing.where(F.lit(days > 0) & (F.col("mtime") < now - F.expr(f"interval {days} days")))


def archive_path(request_id: Column, day: Column) -> Column:
    from foliospark.functions.text import sanitize_archive_name

    return F.concat_ws("/", F.date_format(day, "yyyy-MM"), F.date_format(day, "yyyy-MM-dd"), sanitize_archive_name(request_id))
