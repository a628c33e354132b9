"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder below the warehouse where that is unset.

    A folder of the local file system that nobody named as shared is an error
    on a cluster: each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = (named or spark.conf.get("spark.sql.warehouse.dir") + "/_stages").rstrip("/")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    scheme = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    if not named and scheme == "file" and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset and the warehouse is a folder of one machine; name a folder that all executors share")
    return root


def files_for(spark: SparkSession) -> int:
    """So many files are enough for a narrow table: two for each core of the cluster."""
    return max(8, 2 * spark.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written once as parquet and read back.

    It cuts the lineage (a lost executor costs no recomputation of what lies
    before) and lets several consumers share one pass. ``files`` is the most
    files to write, for narrow tables behind a shuffle. The table goes when the
    driver's JVM ends, or with ``forget``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/wakeline-{sc.applicationId}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(df._written_at)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
