"""Folders, markers and small files on whatever file system Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; a missing folder is empty."""
    fs, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def found(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that fits a pattern, is there."""
    fs, p = _at(spark, path)
    return bool(fs.globStatus(p))


def version(spark: SparkSession, path: str) -> str:
    """What changes when a file or the files of a folder are written anew: sizes and times."""
    fs, p = _at(spark, path)
    return "-".join(f"{f.getLen()}.{f.getModificationTime()}" for f in ([fs.getFileStatus(p)] if fs.getFileStatus(p).isFile() else fs.listStatus(p)))


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; a file that is there already stays."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return
    draft = p.suffix(".draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(draft, p)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Like put, but says whether this call made the file: of several writers of one path only one does."""
    fs, p = _at(spark, path)
    draft = p.suffix(f".{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    try:  # this rename does not replace
        none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        hadoop.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, p, none)
        return True
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
