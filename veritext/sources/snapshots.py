"""Versioned tables: a table can be rebuilt while it is read.

``<base>/versions/<name>`` holds one version each, ``<base>/current`` names
the one that counts.  A new version is written whole before the name is
switched by one atomic rename, so a reader sees the old table or the new one.
A reader pins its version with a file below ``<base>/pins``; versions that are
neither current nor pinned can be removed at any time.  Everything goes
through the Hadoop file system of the path, which driver and executors share.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A pin older than this (a reader that died) holds nothing back.
PIN_SECONDS = 24 * 3600


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _write(spark: SparkSession, name: str, text: str) -> None:
    out = _fs(spark, name).create(_path(spark, name), True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, name: str) -> str:
    stream = _fs(spark, name).open(_path(spark, name))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _names(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """(name, seconds since the epoch of its last change) of a folder's entries; none if there is no folder."""
    fs, path = _fs(spark, folder), _path(spark, folder)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(path)] if fs.exists(path) else []


def current_version(spark: SparkSession, base: str) -> str | None:
    """The name of the version that counts, if any was published."""
    name = f"{base}/current"
    return _read(spark, name) if _fs(spark, name).exists(_path(spark, name)) else None


def publish(spark: SparkSession, base: str, write: Callable[[str], object]) -> str:
    """Write a new version by ``write(path)`` and make it the current one; returns its name.

    If ``write`` fails, the table stays as it was and the unfinished version
    is removed.  Of several writers the last to finish counts.
    """
    version = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    folder = f"{base}/versions/{version}"
    try:
        write(folder)
    except BaseException:
        _fs(spark, folder).delete(_path(spark, folder), True)
        raise
    draft = f"{base}/draft-{version}"
    _write(spark, draft, version)
    files = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    options[0] = files.Options.Rename.OVERWRITE
    files.FileContext.getFileContext(_path(spark, draft).toUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, draft), _path(spark, f"{base}/current"), options)
    return version


@contextmanager
def pinned(spark: SparkSession, base: str) -> Iterator[DataFrame]:
    """The current version as a frame; it stays readable until the block ends, whatever is published meanwhile."""
    while True:
        version = current_version(spark, base)
        if version is None:
            raise FileNotFoundError(f"nothing was published at {base}")
        pin = f"{base}/pins/{version}.{uuid.uuid4().hex}"
        _write(spark, pin, "")
        folder = f"{base}/versions/{version}"
        if _fs(spark, folder).exists(_path(spark, folder)):     # else it went between the two steps
            break
        _fs(spark, pin).delete(_path(spark, pin), False)
    try:
        yield spark.read.parquet(folder)
    finally:
        _fs(spark, pin).delete(_path(spark, pin), False)


def remove_unread(spark: SparkSession, base: str) -> list[str]:
    """Delete the versions before the current one that no reader has pinned; returns their names.

    Versions after the current one may still be in the writing and stay.
    """
    now, alive = current_version(spark, base), time.time() - PIN_SECONDS
    held = {name.split(".")[0] for name, changed in _names(spark, f"{base}/pins") if changed >= alive}
    gone = []
    for version, _ in _names(spark, f"{base}/versions"):
        if now is not None and version < now and version not in held:
            folder = f"{base}/versions/{version}"
            held = {name.split(".")[0] for name, changed in _names(spark, f"{base}/pins") if changed >= alive}
            if version not in held and _fs(spark, folder).delete(_path(spark, folder), True):
                gone.append(version)
    return sorted(gone)
