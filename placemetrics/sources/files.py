"""The few file operations that are not reads or writes of tables, through Hadoop's file system, so that they work where the tables lie."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(conf)


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _system(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; one that is not there is no fault."""
    where, system = _system(spark, path)
    system.delete(where, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file whole, if there is none; false if there is one. Of several writers one succeeds.

    The text goes to a file of its own first, which then takes the name: by a rename that does not
    replace, or by a link on a local file system, whose renames would.
    """
    where, system = _system(spark, path)
    system.mkdirs(where.getParent())
    draft, _ = _system(spark, f"{where.getParent()}/.{where.getName()}.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), where.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not system.exists(where) and system.rename(draft, where)
    finally:
        system.delete(draft, False)
