"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files go when the execution that made them ends, not when the driver's garbage is collected.
FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space as the contracts count it: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _folder(spark: SparkSession) -> str:
    """The shared checkpoint folder. Only where no setting names it and all runs in one process, a local one is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^,]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="termlens-"))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Frees the shuffle files of each execution inside at its end. For executions whose frames aren't executed again: what goes
    on is read from written files, so many steps in a row hold the disk of one."""
    before = spark.conf.get(FREEING, None)
    spark.conf.set(FREEING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREEING)
        else:
            spark.conf.set(FREEING, before)


def count(df: DataFrame) -> int:
    with freeing(df.sparkSession):
        return df.count()


def written(df: DataFrame, before: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again; it has the name of its folder as ``path``.

    Sizes of joins are estimated anew from the files. (A checkpoint hands its plan's estimates on, and in a loop of joins
    their digits would double with every turn.) ``before``: a folder that isn't needed any more; ``parts``: most files.
    """
    path = f"{_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.path = path
    if before:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(before)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests, a notebook)
    a local one is set, since then driver and executors are one process.
    """
    _folder(df.sparkSession)
    with freeing(df.sparkSession):
        return df.checkpoint(eager=True)
