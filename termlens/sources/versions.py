"""Tables that are refreshed as a whole or by slices, so that a reader or a failed write sees the old rows or the new ones.

A table is a folder with one sub-folder for each write and a manifest, a small JSON file that names the folders and slices that are the table
now. A write goes to a new sub-folder first; when all of it is there, the manifest is replaced by a rename, which the file system does as
one step. What the manifest doesn't name isn't part of the table; the sub-folders of the last two manifests are kept for readers under way.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict:
    """``{"parts": [{"folder": .., "slices": [..] or null}], "before": [folders]}``; no parts where there is no table yet."""
    p, fs = _at(spark, f"{path}/{MANIFEST}")
    if not fs.exists(p):
        return {"parts": [], "before": []}
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, parts: list[dict], old: dict) -> None:
    """Makes ``parts`` the table, then removes what neither this manifest nor the one before names."""
    new = {"parts": parts, "before": sorted({p["folder"] for p in old["parts"]})}
    draft, fs = _at(spark, f"{path}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    final, _ = _at(spark, f"{path}/{MANIFEST}")
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    replace = spark.sparkContext._gateway.new_array(option, 1)
    replace[0] = option.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(final), replace)
    kept = {p["folder"] for p in parts} | set(new["before"])
    for folder in set(old["before"]) - kept:
        p, _ = _at(spark, f"{path}/{folder}")
        fs.delete(p, True)


def refresh(df: DataFrame, path: str) -> None:
    """The rows of ``df``, which may come from the table itself, become the table."""
    spark = df.sparkSession
    old, folder = manifest(spark, path), f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _switch(spark, path, [{"folder": folder, "slices": None}], old)


def _slices(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Sub-folders ``a=x/b=y`` of a written folder: one for each slice."""
    found = [""]
    for _ in range(depth):
        below = []
        for s in found:
            p, fs = _at(spark, f"{path}/{s}")
            below += [f"{s}/{f.getPath().getName()}".lstrip("/") for f in fs.listStatus(p) if f.isDirectory() and "=" in f.getPath().getName()]
        found = below
    return sorted(found)


def refresh_slices(df: DataFrame, path: str, by: tuple[str, ...] = ("source_type", "method")) -> None:
    """The slices that ``df`` has rows of are replaced, all at once; the others stay. The table is always written by the same columns."""
    spark = df.sparkSession
    old, folder = manifest(spark, path), f"v-{uuid.uuid4().hex}"
    if any(p["slices"] is None for p in old["parts"]):
        raise ValueError("the table wasn't written by slices")
    df.write.partitionBy(*by).parquet(f"{path}/{folder}")
    new = _slices(spark, f"{path}/{folder}", len(by))
    parts = [{"folder": p["folder"], "slices": rest} for p in old["parts"] if (rest := [s for s in p["slices"] if s not in new])]
    _switch(spark, path, parts + ([{"folder": folder, "slices": new}] if new else []), old)


def table(spark: SparkSession, path: str) -> DataFrame:
    """The table as the manifest has it now; an error where there is none."""
    parts = manifest(spark, path)["parts"]
    if not parts:
        raise FileNotFoundError(f"no table at {path}")
    out = None
    for p in parts:
        base = f"{path}/{p['folder']}"
        rows = spark.read.parquet(base) if p["slices"] is None else spark.read.option("basePath", base).parquet(*[f"{base}/{s}" for s in p["slices"]])
        out = rows if out is None else out.unionByName(rows)
    return out
