"""Folders in whatever store Spark's paths lead to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def complete(spark: SparkSession, path: str) -> list[str]:
    """The tables in a folder whose write has ended."""
    return [n for n in names(spark, path) if exists(spark, f"{path}/{n}/_SUCCESS")]


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, place = _place(spark, path)
        fs.delete(place, True)


def make(spark: SparkSession, path: str) -> None:
    """An empty folder."""
    fs, place = _place(spark, path)
    fs.mkdirs(place)
