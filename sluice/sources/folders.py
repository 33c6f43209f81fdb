"""Small files in a shared folder, made by the driver: whole or not at all, and only if they are not there yet."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, target, target.getFileSystem(conf)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file unless it exists; of two writers at once one gets false.

    The text is written beside it first, so a file that is there is whole.  A
    local folder links it under its name, other file systems rename it without
    overwriting; both are one step.
    """
    jvm, conf, target, system = _system(spark, path)
    if system.getScheme() == "file":
        local = target.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        beside = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(beside, "x") as out:
            out.write(text)
        try:
            os.link(beside, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(beside)
    return _renamed(spark, jvm, conf, target, system, text)


def _renamed(spark: SparkSession, jvm, conf, target, system, text: str) -> bool:
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = system.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(system.makeQualified(beside), system.makeQualified(target), options)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    finally:
        system.delete(beside, False)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all that is in it; one that is not there stays so."""
    _, _, target, system = _system(spark, path)
    system.delete(target, True)
