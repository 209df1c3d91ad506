"""Small files and folders of the warehouse through Hadoop's file system API: works on any store that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, Hadoop path) of ``path``."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder in order; none if it does not exist."""
    fs, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def file_states(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """(name, bytes, time of the last change) of what a folder holds, in order."""
    fs, place = _at(spark, folder)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(place))) if fs.exists(place) else ()


def total_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder; 0 if it does not exist."""
    fs, place = _at(spark, folder)
    return fs.getContentSummary(place).getLength() if fs.exists(place) else 0


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file that appears whole: written under another name, then renamed. An existing one is an error."""
    fs, place = _at(spark, path)
    if fs.exists(place):
        raise FileExistsError(path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(draft, place):
        fs.delete(draft, False)
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)
