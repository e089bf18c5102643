"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hot keys are those with more than 1/HOT_SHARE of all rows, so there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Rows are handed to per-row Python code in pieces of about so many bytes.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a session within one process (tests) gets one of its own where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="palisade-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path under the shared folder, as a URI."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: what is dear to make is made once."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or a plain local path. s3a:// and s3n://, Spark's names for S3, go by s3://."""
    import pyarrow.fs as pafs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme or os.path.isabs(uri):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PIECE_BYTES of the named column, so that Python holds few texts at once."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * PIECE_BYTES / max(batch.column(column).nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def map_texts(df: DataFrame, text: str, row: Callable[[str | None], tuple], keep: list[str], schema: str) -> DataFrame:
    """A row of row(text) beside the columns in keep, for each row of df. schema: of the new columns, as DDL."""
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    out = T.StructType.fromDDL(f"{kept}, {schema}" if kept else schema)
    new = out.names[len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                cols = list(zip(*(row(x) for x in part.column(text).to_pylist()), strict=True)) or [()] * len(new)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, type=to_arrow(out[n].dataType)) for n, c in zip(new, cols, strict=True))], names=out.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, out)


def filter_texts(df: DataFrame, text: str, keep: Callable[[str | None], bool]) -> DataFrame:
    """The rows of df whose text keep() accepts, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                yield part.filter(pa.array([keep(x) for x in part.column(text).to_pylist()], type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def join_skewed(df: DataFrame, lookup: DataFrame, keys: list[str], n_rows: str = "n_rows") -> DataFrame:
    """df left-joined with lookup on keys (null-safe), whatever the skew of df.

    lookup, best cut(), has one row per key and, in n_rows, how many rows of df have that key. Keys with over 1/HOT_SHARE
    of all rows (fewer than HOT_SHARE keys, whatever the input) are joined by broadcast, so their rows stay where they
    are; all other rows are joined by a shuffle. No row of lookup comes to the driver. n_rows itself isn't returned.
    """
    whole = lookup.agg(F.coalesce(F.sum(n_rows), F.lit(0)), F.coalesce(F.max(n_rows), F.lit(0))).first()
    is_hot = F.col(n_rows) * HOT_SHARE > F.lit(whole[0])
    cold = lookup.where(~is_hot).drop(n_rows)
    if whole[1] * HOT_SHARE <= whole[0]:
        return _left(df, cold, keys)
    flagged = _left(df, F.broadcast(lookup.where(is_hot).drop(n_rows).withColumn("__hot", F.lit(True))), keys)
    was_hot = F.coalesce("__hot", F.lit(False))
    return flagged.where(was_hot).drop("__hot").unionByName(_left(flagged.where(~was_hot).select(*df.columns), cold, keys))


def _left(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    renamed = other.select(*(F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in other.columns))
    on = None
    for k in keys:
        e = df[k].eqNullSafe(F.col(f"__k_{k}"))
        on = e if on is None else on & e
    return df.join(renamed, on, "left").drop(*(f"__k_{k}" for k in keys))
