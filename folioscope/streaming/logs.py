"""Streams over append-only logs and dated tags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..sources.manifest import MANIFEST_SCHEMA
from ..sources.sinks import read_snapshot, write_snapshot


def read_manifest_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MANIFEST_SCHEMA).json(folder)


def maintain_latest(manifest: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest record per content hash in snapshots below `store`.

    Records are ordered by their own times, those of the snapshot included, so an older record
    that comes later changes nothing, nor does a batch that is replayed after a failure.
    """

    def merge(batch: DataFrame, _: int) -> None:
        others = [name for name in batch.columns if name != "sha256"]
        rows = batch.where(F.col("sha256").isNotNull()).withColumn("newer", F.lit(1))
        current = read_snapshot(batch.sparkSession, store)
        if current is not None:
            rows = rows.unionByName(current.withColumn("newer", F.lit(0)))
        # A record without times comes before all others; of equal times the later batch stands.
        when = F.coalesce(F.greatest("started_at", "uploaded_at", "finished_at").cast("string"), F.lit(""))
        latest = rows.groupBy("sha256").agg(F.max_by(F.struct(*others), F.struct(when, "newer")).alias("last"))
        write_snapshot(latest.select("sha256", "last.*"), store)

    return (
        manifest.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def split_future(reports: DataFrame, today: dt.date) -> tuple[DataFrame, DataFrame]:
    """(trusted, quarantined): dates beyond the tolerance would push a watermark past real data, and so goes no date."""
    limit = F.lit(today + dt.timedelta(days=fixed.FUTURE_TOLERANCE_DAYS + 1)).cast("timestamp")
    return reports.where(F.col("ts") < limit), reports.where(F.col("ts").isNull() | (F.col("ts") >= limit))


def only_new(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a stream whose doc_id is neither in the stored table `known` nor was in the stream before.

    State holds the ids, spread by their hash; of repeated rows of one id in one batch any one stands.
    """
    return documents.join(known.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])


def theme_heat(tagged: DataFrame, lateness: str = "7 days", by: str = "week") -> DataFrame:
    """Distinct documents per theme and calendar window of a stream (doc_id, theme, ts), for update mode.

    Weeks start on Monday; the epoch was a Thursday, hence the four-day shift. Repeats are known for the whole window,
    however far apart they lie. Months differ in length: a document counts on the day where its month first met it,
    remembered for 31 days beyond the lateness, and `latest_heat` sums the days. Rows later than `lateness` may be dropped.
    """
    if by == "week":
        marked = tagged.withWatermark("ts", lateness).withColumn("window", F.window("ts", "7 days", startTime="4 days"))
        return marked.dropDuplicates(["doc_id", "theme", "window"]).groupBy("window", "theme").agg(F.count("*").alias("docs"))
    marked = tagged.withColumn("month", F.date_trunc("month", "ts")).withWatermark("ts", f"31 days {lateness}")
    once = marked.dropDuplicatesWithinWatermark(["doc_id", "theme", "month"])
    return once.groupBy(F.window("ts", "1 day"), "theme").agg(F.count("*").alias("docs"))


def write_updates(heat: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes the counts that a batch changed into a folder of its own, which a replay after a failure writes again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        heat.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_heat(spark: SparkSession, target: str, by: str = "week") -> DataFrame:
    """start, theme and docs of all windows, open ones included; counts only grow, so the highest one is the latest."""
    schema = "window struct<start timestamp, end timestamp>, theme string, docs long"
    latest = spark.read.schema(schema).parquet(target).groupBy("window", "theme").agg(F.max("docs").alias("docs"))
    start = F.to_date(F.date_trunc(by, F.col("window.start")))
    return latest.groupBy(start.alias("start"), "theme").agg(F.sum("docs").alias("docs"))


def write_append(frame: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (
        frame.writeStream.outputMode("append").format("parquet")
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
