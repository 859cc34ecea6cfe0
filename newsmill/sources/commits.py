"""Commit records: small files that make a finished write visible at once.

Data is written to a folder of its own, under a name that nobody reads; the
record that names the folder is then moved into place.  Readers take only
folders that a record names, so a write that was cut short is never seen.  One
driver at a time writes records of a folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F


def publish(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """Put the record ``name`` into ``folder``; False if there is one already, which stays as it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    final, draft = path(f"{folder}/{name}"), path(f"{folder}/.draft-{uuid.uuid4().hex}")
    store = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(final):
        return False
    with_out = store.create(draft)
    with_out.write(bytearray(content.encode()))
    with_out.close()
    return store.rename(draft, final)


def records(spark: SparkSession, folder: str) -> dict[str, str]:
    """Content of each record by its name; none if the folder isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return {}
    names = [s.getPath().getName() for s in store.listStatus(path)]
    if not any(not n.startswith(".") for n in names):
        return {}
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1), "value").collect()
    return {name: value for name, value in rows}


def latest(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """The record of the largest number, or None if there is none; only that one is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(n) for n in (s.getPath().getName() for s in store.listStatus(path)) if n.isdigit()] if store.exists(path) else []
    if not numbers:
        return None
    return max(numbers), spark.read.text(f"{folder}/{max(numbers)}", wholetext=True).first()[0]
