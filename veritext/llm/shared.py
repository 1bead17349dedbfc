"""Helpers shared by the operators: written intermediate tables, safe columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.session import SHUFFLE_CLEANUP, scratch_path, shuffles_removed  # noqa: F401


def new_folder(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage: later stages read files that every executor can see, so
    a lost executor costs one re-read and not the whole chain before it.  The
    shuffles behind the frame are of no more use then and go with the write.
    """
    path = new_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(*frames: DataFrame | None) -> None:
    """Delete the tables behind frames that ``stored`` gave, which nothing reads any more."""
    for df in frames:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
