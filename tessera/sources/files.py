"""Single files on any file system that Spark reaches, by Hadoop's interface on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _open(spark, path)
    return fs.exists(place)


def size(spark: SparkSession, path: str) -> int:
    fs, place = _open(spark, path)
    return fs.getFileStatus(place).getLen()


def head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes, or all that there are."""
    fs, place = _open(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, size(spark, path))))
    finally:
        stream.close()


def same(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two paths name one place."""
    places = []
    for path in (a, b):
        fs, place = _open(spark, path)
        places.append(fs.makeQualified(place).toString().rstrip("/"))
    return places[0] == places[1]


def write(spark: SparkSession, path: str, parts: Iterable[bytes], overwrite: bool = False) -> None:
    """Write the parts one after the other; a file that exists is an error unless it is to be overwritten."""
    fs, place = _open(spark, path)
    stream = fs.create(place, overwrite)
    try:
        for part in parts:
            stream.write(part)
    finally:
        stream.close()
