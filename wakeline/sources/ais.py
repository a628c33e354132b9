"""Reading and writing tables of position reports and stage results."""

from __future__ import annotations

import datetime as dt
import io
import urllib.request
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.schema import REPORT

CHUNK, TIMEOUT, ARCHIVE_ROWS = 1 << 20, 60, 200_000
# Column names of the public daily files, in the order of the schema.
RAW_NAMES = ["MMSI", "IMO", "BaseDateTime", "LAT", "LON", "SOG", "Heading", "VesselType"]


def day_files(start: dt.date, end: dt.date, base_url: str, name: str = "AIS_{:%Y_%m_%d}.zip") -> list[str]:
    """One address for each day, both ends included."""
    days = (end - start).days + 1
    return [f"{base_url.rstrip('/')}/{name.format(start + dt.timedelta(days=k))}" for k in range(max(0, days))]


def download(url: str, path: str) -> bool:
    """Stream one file to disk; any answer other than 200 is skipped."""
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
            if answer.status != 200:
                return False
            with open(path, "wb") as f:
                while part := answer.read(CHUNK):
                    f.write(part)
        return True
    except OSError:
        return False


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            try:
                z = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                continue
            with z:
                for member in z.namelist():
                    if member.lower().endswith(".csv"):
                        with z.open(member) as f:
                            for part in pd.read_csv(f, usecols=RAW_NAMES, dtype={"IMO": str}, chunksize=200_000):
                                part = part[RAW_NAMES].set_axis([x.name for x in REPORT], axis=1)
                                part["imo"] = part["imo"].where(part["imo"].notna(), None)
                                part["vessel_type"] = part["vessel_type"].astype("Int32")
                                yield part


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """Reports of all CSV members of zip files, one archive to a task, read in chunks; ``broken_zips`` names the files that are none."""
    return unzipped(spark.read.format("binaryFile").load(path))


def unzipped(archives: DataFrame) -> DataFrame:
    """Reports of archives held in the binary column ``content``."""
    return archives.select("content").mapInPandas(_members, REPORT)


def _archive(part: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("reports.csv", part[RAW_NAMES].to_csv(index=False))
    return pd.DataFrame({"content": [out.getvalue()]})


def zipped(files: DataFrame, day: str = "BaseDateTime", most: int = ARCHIVE_ROWS) -> DataFrame:
    """Rows with the columns of the daily files as archives (content), one or more a day with about ``most`` rows each."""
    days = files.withColumn("_day", F.substring(day, 1, 10))
    largest = days.groupBy("_day").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-largest // most))
    return days.withColumn("_part", F.pmod(F.xxhash64(*RAW_NAMES), F.lit(parts))).groupBy("_day", "_part").applyInPandas(_archive, "content binary")


def _broken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.loc[[not zipfile.is_zipfile(io.BytesIO(c)) for c in batch["content"]], ["path"]]


def broken_zips(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files that cannot be opened as archives."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_broken, "path string")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reports of unpacked CSV files, with the declared schema."""
    names = spark.read.option("header", True).csv(path)
    return names.select(*(F.col(r).cast(x.dataType).alias(x.name) for r, x in zip(RAW_NAMES, REPORT, strict=True)))


def with_time(reports: DataFrame) -> DataFrame:
    """The time string as ts (no time zone) and as t, seconds since 2000; seq as the tie-break."""
    ts = F.expr("try_to_timestamp(base_date_time)").cast("timestamp_ntz")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2000-01-01 00:00:00', ts)") / 1e6
    return reports.withColumn("ts", ts).withColumn("t", t).withColumn("seq", F.xxhash64("mmsi", "base_date_time", "lat", "lon"))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object code -> name as rows (code, name)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("code", "name"))


def write_days(reports: DataFrame, path: str) -> None:
    """Parquet by day; days that are written replace only themselves, so a resumed ingest keeps the others."""
    reports.withColumn("date", F.to_date("ts")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def missing_days(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> list[dt.date]:
    """Days of the range that the partitioned table lacks."""
    days = {start + dt.timedelta(days=k) for k in range((end - start).days + 1)}
    if not exists(spark, path):
        return sorted(days)
    have = {r[0] for r in spark.read.parquet(path).select("date").distinct().collect()}
    return sorted(days - have)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def resume(df: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``work`` on rows whose keys are not yet in the table at ``path``, appends, and reads it all."""
    spark = df.sparkSession
    todo = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if exists(spark, path) else df
    append(work(todo), path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header, rows sorted by all columns."""
    df.coalesce(1).sortWithinPartitions(*df.columns).write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
