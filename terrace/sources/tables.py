"""Reading the tables of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *, spread: bool = False) -> DataFrame:
    """One stored table as a DataFrame; filters and column choices reach its Parquet scan.

    ``spread``: for work that is heavier than reading. A table in one file of fewer row groups than there are cores,
    which so few tasks would have to read, is then dealt out to all cores; any other is left as it is read.
    """
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and _row_groups(spark, path, cores) < cores else df


def _row_groups(spark: SparkSession, path: str, enough: int) -> int:
    """How many row groups a single file has; ``enough`` for a folder of files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).getFileStatus(where).isFile():
        return enough
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
    try:
        return reader.getRowGroups().size()
    finally:
        reader.close()
