"""Sources: folders, DataFrames and literal maps as corpora with the columns of the file table.

``register(spark)`` adds the format ``workspace_files``; ``spark.read.format("workspace_files").option("root", ...)`` lists a
folder as (path, size, mtime), pruned like a walk, with the options ``root``, ``under``, ``skip`` and ``limit``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths, text


def walk(root: str, under: str = "", skip: list[str] | None = None, limit: int | None = None) -> Iterator[tuple[str, int, float]]:
    """Regular files in order, those of a directory before its subdirectories; skipped names count for directories only."""
    skip_names = set(paths.SKIP_DIRS if skip is None else skip) | set(paths.PRUNE_DOT_DIRS)
    start = os.path.join(root, under) if under else root
    n = 0
    todo = [start]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            if e.is_file(follow_symlinks=False):
                if limit is not None and n >= limit:
                    return
                st = e.stat(follow_symlinks=False)
                n += 1
                yield os.path.relpath(e.path, root).replace(os.sep, "/"), st.st_size, st.st_mtime * 1000
        todo += [e.path for e in reversed(entries) if e.is_dir(follow_symlinks=False) and e.name not in skip_names]


class _Top(InputPartition):
    def __init__(self, under: str):
        self.under = under


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.under = options["root"], options.get("under", "")
        self.skip = [s for s in options["skip"].split(",") if s] if "skip" in options else None
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self):
        """One per directory at the top, so a wide tree is walked in parallel; a limit needs the whole order."""
        if self.limit is not None:
            return [_Top(self.under)]
        start = os.path.join(self.root, self.under)
        skip = set(paths.SKIP_DIRS if self.skip is None else self.skip) | set(paths.PRUNE_DOT_DIRS)
        tops = sorted(e.name for e in os.scandir(start) if e.is_dir(follow_symlinks=False) and e.name not in skip)
        return [_Top("\0" + self.under), *(_Top(os.path.join(self.under, t)) for t in tops)]

    def read(self, partition):
        if partition.under.startswith("\0"):
            under = partition.under[1:]
            for e in sorted(os.scandir(os.path.join(self.root, under)), key=lambda e: e.name):
                if e.is_file(follow_symlinks=False):
                    st = e.stat(follow_symlinks=False)
                    yield os.path.relpath(e.path, self.root).replace(os.sep, "/"), st.st_size, st.st_mtime * 1000
        else:
            yield from walk(self.root, partition.under, self.skip, self.limit)


class WorkspaceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace_files"

    def schema(self) -> str:
        return "path string, size bigint, mtime double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkspaceFiles)


def from_bytes(rows: DataFrame, ws: str) -> DataFrame:
    """File rows from (rel, bytes[, size, mtime]): secret and binary files are hashed, never decoded."""
    rel = F.col("rel")
    size = F.col("size") if "size" in rows.columns else F.octet_length("bytes").cast("bigint")
    mtime = F.col("mtime") if "mtime" in rows.columns else F.lit(None).cast("double")
    readable = paths.is_textual(rel, size)
    decoded, lossless = text.decode(F.col("bytes"))
    return rows.select(
        F.lit(ws).alias("ws"), "rel", text.sha1_upper(F.col("bytes")).alias("hash"), size.cast("bigint").alias("size"), mtime.alias("mtime"), paths.lang_of(rel).alias("lang"),
        F.when(readable, F.size(F.split(decoded, "\n"))).cast("bigint").alias("lines"), readable.alias("indexed"), F.when(~readable, paths.opaque_reason(rel)).alias("reason"),
        F.when(readable, lossless).otherwise(F.lit(True)).alias("lossless"), F.when(readable, decoded).alias("content"),
    )


def from_folder(spark: SparkSession, root: str, ws: str) -> DataFrame:
    """A folder that all executors reach as a corpus, the ignore file of its root heeded.

    Listed by ``workspace_files``, as Spark's own file reader leaves out names that begin with a dot. Bytes are read where
    the rows are; only files that pass the walk are opened.
    """
    register(spark)
    root = os.path.realpath(root)
    ignore = os.path.join(root, ".gitignore")
    rules = open(ignore, encoding="utf-8", errors="replace").read() if os.path.isfile(ignore) else None
    rows = spark.read.format("workspace_files").option("root", root).load().withColumnRenamed("path", "rel")
    return from_bytes(_with_bytes(rows.where(paths.walk_filter(F.col("rel"), rules)), root), ws)


def _with_bytes(rows: DataFrame, root: str) -> DataFrame:
    """Adds the bytes of each file; one that has gone meanwhile is left out."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for rel, size, mtime in pdf.itertuples(index=False):
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        out.append((rel, size, mtime, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["rel", "size", "mtime", "bytes"])

    return rows.select("rel", "size", "mtime").mapInPandas(run, "rel string, size bigint, mtime double, bytes binary")


def from_map(spark: SparkSession, files: dict[str, str | bytes], ws: str = "memory") -> DataFrame:
    """A literal map of paths to texts or bytes as a corpus."""
    rows = [(k, v.encode() if isinstance(v, str) else v) for k, v in files.items()]
    return from_bytes(spark.createDataFrame(rows, "rel string, bytes binary"), ws)


def read_paths(spark: SparkSession, root: str, rels: list[str]) -> DataFrame:
    """(rel, bytes) of some files; missing ones, and paths that lead out of the folder, are left out."""
    good = [(r, None, None) for r in rels if r and not r.startswith("/") and ".." not in r.split("/")]
    asked = spark.createDataFrame(good, "rel string, size bigint, mtime double")
    return _with_bytes(asked, os.path.realpath(root)).select("rel", "bytes")
