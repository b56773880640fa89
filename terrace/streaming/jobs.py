"""The running side of the store: spans as they arrive, the index as documents change, calls counted as they come."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace.operators.chunking import last_by_path, split_chapters
from terrace.sources.tables import table


def stream(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    """A table's files as a stream, at most ``files`` of them in a batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parque[t]")  # a pattern, so that one file will do


def replay(spark: SparkSession, folder: str, name: str, time_col: str, copy: str, *, close: str | None = None, files: int = 8) -> DataFrame:
    """A stored table as a stream in the order of ``time_col``, however many files hold it, so that no row is late.

    Rows with a time are written once more, below ``copy``, cut into ranges of time. A stream takes files in the order
    of their times of change, which are set to follow the ranges; the file system has to keep such times. ``close``: a
    last row, empty but for a time that much after the newest, moves the watermark on, so that all windows end.
    """
    rows = table(spark, folder, name).filter(F.col(time_col).isNotNull())
    at, kind = F.col(time_col).cast("timestamp"), rows.schema[time_col].dataType
    rows.repartitionByRange(at).write.parquet(f"{copy}/0-rows")
    if close:
        last = rows.agg((F.max(at) + F.expr(f"INTERVAL {close}")).cast(kind).alias(time_col)).filter(F.col(time_col).isNotNull())
        last.select(*[F.col(time_col) if f.name == time_col else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]).write.parquet(f"{copy}/1-end")
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{copy}/*/part-*")
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = int(time.time()) * 1000
    for k, path in enumerate(sorted(x.getPath().toString() for x in fs.globStatus(found))):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(path), now + 1000 * k, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{copy}/*")


def arriving_spans(spans: DataFrame, late: str = "3 days") -> DataFrame:
    """Each span once: its first delivery; deliveries that come more than ``late`` after the newest are left out."""
    return spans.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def calls_in_windows(calls: DataFrame, time_col: str, key_col: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, key, calls`` for each window and key, once no more calls of it can come."""
    stamped = calls.withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width), F.col(key_col).alias("key")).agg(F.count("*").alias("calls")).select(F.col("window.start").alias("start"), "key", "calls")


def follow_documents(documents: DataFrame, index_path: str, checkpoint: str, *, status: str = "cold") -> StreamingQuery:
    """Keeps a table of chapters that follows changed documents: each batch cuts its documents anew.

    A batch writes only its own documents' chapters, below ``batch=<number>``, and a row without path for documents
    that have none any more; ``current_index`` reads what holds. A repeated batch writes the same again. Of a document
    that comes several times in a batch, the row updated last counts.
    """

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by(F.struct("title", "content", "status"), "updated_at").alias("d")).select("id", "d.*")
        cut = last_by_path(split_chapters(newest.filter(F.col("status") == status), "id", "title", "content"))
        gone = newest.filter(F.col("status").isNull() | (F.col("status") != status)).select(F.col("id").alias("document_id"))
        cut.unionByName(gone, allowMissingColumns=True).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The chapters that hold after all batches: those of each document's last one."""
    rows = spark.read.parquet(index_path)
    last = rows.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["document_id", "batch"], "left_semi").filter("path IS NOT NULL").drop("batch")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now and writes its rows as Parquet."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
