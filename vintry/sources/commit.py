"""Small files of the store, created once and never overwritten, on any Hadoop file system.

Manifests and generations are a few kilobytes each and are written by the driver. A file
appears whole or not at all: it is written under another name and renamed, and the rename
fails where the name is taken. That is one step on HDFS and on local disks; a store needs a
file system that has it.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _paths(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return jvm, where, where.getFileSystem(conf), conf


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``; False, and nothing changed, where it exists."""
    jvm, where, files, conf = _paths(spark, path)
    parent = where.getParent()
    files.mkdirs(parent)
    written = jvm.org.apache.hadoop.fs.Path(parent, f".{where.getName()}-{uuid.uuid4().hex}")
    out = files.create(written, False)
    out.write(text.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0
    )
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf) \
        if where.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    try:
        context.rename(written, where, options)
        return True
    except Py4JJavaError as error:
        files.delete(written, False)
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False


def read_text(spark: SparkSession, path: str) -> str:
    jvm, where, files, _ = _paths(spark, path)
    stream = files.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    _, where, files, _ = _paths(spark, path)
    return files.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, hidden ones left out; none where it does not exist."""
    _, where, files, _ = _paths(spark, folder)
    if not files.exists(where):
        return []
    found = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(name for name in found if not name.startswith((".", "_")))


def delete(spark: SparkSession, path: str) -> None:
    _, where, files, _ = _paths(spark, path)
    files.delete(where, True)
