"""The store's tables: their columns, empty ones where they are missing, and reading them over JDBC."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.sources.tables import table

#: Names and types of the store's columns.
TABLES = {
    "documents": "id string, title string, summary string, content string, format string, tags array<string>, status string, hot_score double, query_count int, last_query_at timestamp, embedding array<float>, created_at timestamp, updated_at timestamp",
    "chapters": "id string, document_id string, path string, title string, summary string, content string, created_at timestamp, updated_at timestamp",
    "topics": "id string, name string, description string, tag_names array<string>, created_at timestamp, updated_at timestamp",
    "tags": "id string, name string, topic_id string, document_count int, created_at timestamp, updated_at timestamp",
    "otel_spans": "id bigint, trace_id string, span_id string, parent_span_id string, name string, kind string, start_time_unix_nano bigint, end_time_unix_nano bigint, status_code string, status_message string, attributes_json string, created_at timestamp",
    "deleted_documents": "id string, document_id string, created_at timestamp",
}


def schema(name: str) -> T.StructType:
    """The columns of a table of the store."""
    return T.StructType.fromDDL(TABLES[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """A table's rows with exactly the store's columns: others dropped, missing ones null, values that don't cast null."""
    held = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name)])


def ensured(spark: SparkSession, folder: str) -> list[str]:
    """Writes an empty table for each that the folder lacks, and says which; a second call writes nothing."""
    made = []
    for name in TABLES:
        try:
            table(spark, folder, name)
        except AnalysisException:
            spark.createDataFrame([], schema(name)).write.parquet(f"{folder}/{name}.parquet")
            made.append(name)
    return made


def from_database(spark: SparkSession, url: str, name: str, *, driver: str | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table read over JDBC, in parallel if ``partition`` gives a numeric column, its bounds and how many parts.

    The driver's archive must be on the class path. Arrays that come as literals are parsed.
    """
    from terrace.functions.text import parse_array

    options = {"url": url, "dbtable": name} | ({"driver": driver} if driver else {})
    if partition:
        column, low, high, parts = partition
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    df = spark.read.format("jdbc").options(**options).load()
    for f in schema(name):
        if isinstance(f.dataType, T.ArrayType) and f.name in df.columns and dict(df.dtypes)[f.name] == "string":
            df = df.withColumn(f.name, parse_array(F.col(f.name)).cast(f.dataType))
    return conformed(df, name)
