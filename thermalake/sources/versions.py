"""Outputs that are replaced whole: versions in folders of their own, and one small file that names the present one.

The file `CURRENT.<number>` is written under another name and renamed, which
never replaces anything: numbers only rise, and a rename to a name that exists
fails. A reader takes the largest number, so it sees the old version or the new
one, whatever dies in between. Old versions stay until `prune` removes them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_POINTER = re.compile(r"CURRENT\.(\d{12})$")


class Conflict(OSError):
    """Another writer published first."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, file) of all pointers, the present one last."""
    files, place = _files(spark, path)
    if not files.exists(place(path)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place(path))]
    return sorted((int(m[1]), n) for n in names if (m := _POINTER.match(n)))


def _read(spark: SparkSession, path: str) -> str:
    files, place = _files(spark, path)
    stream = files.open(place(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    files, place = _files(spark, path)
    stream = files.create(place(path), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, text: str, expected: int) -> int:
    """Makes `text` the content of the next pointer; raises `Conflict` if that number is taken."""
    files, place = _files(spark, path)
    number = expected + 1
    temporary, target = f"{path}/_pointer-{uuid.uuid4()}", f"{path}/CURRENT.{number:012d}"
    files.mkdirs(place(path))
    _write(spark, temporary, text)
    taken = files.exists(place(target)) or not files.rename(place(temporary), place(target))
    if taken:
        files.delete(place(temporary), False)
        raise Conflict(f"{path} has a version {number} already")
    return number


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the present version; None before the first."""
    held = _pointers(spark, path)
    return f"{path}/{_read(spark, f'{path}/{held[-1][1]}')}" if held else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Lets `write` fill a new folder, then makes it the present version; what was there stays readable. Returns the folder.

    If `write` fails, or another writer publishes meanwhile, nothing changes
    for readers; the unfinished folder is removed.
    """
    held = _pointers(spark, path)
    name = f"version-{uuid.uuid4()}"
    files, place = _files(spark, path)
    try:
        write(f"{path}/{name}")
        _point(spark, path, name, held[-1][0] if held else 0)
    except BaseException:
        files.delete(place(f"{path}/{name}"), True)
        raise
    return f"{path}/{name}"


def publish_table(df: DataFrame, path: str) -> str:
    return publish(df.sparkSession, path, df.write.parquet)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The present version; a query that began on it keeps reading it after the next one is published."""
    held = current(spark, path)
    if held is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(held)


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A small record as the pointer itself; the ones before it but one are removed."""
    held = _pointers(spark, path)
    _point(spark, path, text, held[-1][0] if held else 0)
    files, place = _files(spark, path)
    for _, name in held[:-1]:
        files.delete(place(f"{path}/{name}"), False)


def latest_text(spark: SparkSession, path: str) -> str | None:
    held = _pointers(spark, path)
    return _read(spark, f"{path}/{held[-1][1]}") if held else None


def prune(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all versions but the last `keep`, and folders that no pointer names; returns how many went.

    For times when no reader is on an older version and no writer is at work.
    """
    if keep < 1:
        raise ValueError("the present version stays")
    files, place = _files(spark, path)
    held = _pointers(spark, path)
    kept = {_read(spark, f"{path}/{n}") for _, n in held[-keep:]}
    for _, name in held[:-keep]:
        files.delete(place(f"{path}/{name}"), False)
    gone = 0
    for status in files.listStatus(place(path)) if files.exists(place(path)) else []:
        name = status.getPath().getName()
        if name.startswith("version-") and name not in kept:
            files.delete(status.getPath(), True)
            gone += 1
    return gone
