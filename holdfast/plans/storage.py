"""Where intermediate tables, checkpoints and stream state live."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session in one process may go without it: it gets a temporary folder. On a cluster that is an error, since
    driver and executors would not see the same files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="holdfast-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside the block goes when it ends; what is to stay has to be written elsewhere by then."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for path in paths:
            remove(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` returned and nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()[:1]}:
            remove(table.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file through the file system it is on; nothing happens if it is not there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def create_file(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with its whole content, or return False if ``path`` is taken: of several writers one wins.

    The content goes to a file of its own first, which is then moved (linked, on a local disk) to ``path`` in one step.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    try:
        if files.getScheme() == "file":
            jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)])
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.valueOf("NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except Py4JJavaError:
        if files.exists(target):
            return False
        raise
    finally:
        files.delete(draft, False)
    return True
