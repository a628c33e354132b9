"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.sources.stage import files_for, forget, written  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
BATCH, _BATCH_KEY = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, with as many files as tasks: for what a scan of texts makes."""
    return written(df, name)


def keep_narrow(df: DataFrame, name: str) -> DataFrame:
    """The same with few files, for tables without texts behind a shuffle."""
    return written(df, name, files_for(df.sparkSession))


def by_text(df: DataFrame, kernel, schema) -> DataFrame:
    """``mapInArrow`` for rows that hold texts, in batches of ``BATCH`` rows.

    Spark's own batch of 10,000 rows may be gigabytes of texts in each worker.
    The setting is the session's and is left alone where the session has set it.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == "10000":
        conf.set(_BATCH_KEY, str(BATCH))
    return df.mapInArrow(kernel, schema)


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of rows that hold about so many bytes together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield lo, hi
        lo = hi


def pieces(text: str, most: int, ends_word) -> Iterator[str]:
    """A long text in parts of about so many characters that end between words; ``ends_word`` finds such a place in a text from a position on."""
    lo = 0
    while lo < len(text):
        cut = ends_word(text, lo + most) if len(text) - lo > most else None
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct) beside key columns, so that no name of the caller can clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(k.alias(n) for n, k in keys.items()))


def text_hash(text: str = "text") -> Column:
    """xxhash64 of the text, a null one taken as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def in_remainder(key: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key as text leaves this remainder; a null key counts as false."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def raws(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Sent:
    """A broadcast whose value may hold this package's own classes; loaded once per worker process."""

    def __init__(self, spark: SparkSession, value):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def gone(self) -> None:
        """Nothing uses it any more: the driver and the executors drop it."""
        self.bytes.destroy()

    @property
    def value(self):
        if not hasattr(self.bytes, "loaded"):
            self.bytes.loaded = cloudpickle.loads(self.bytes.value)
        return self.bytes.loaded
