"""Bringing the stored index up to date: only files that are new, changed or of another analyser are read and analysed.

One run is a scan diff against the stored file rows, the analysis of what it names, and one generation of the store in
which the rows of every touched or removed file are replaced in all tables. A run that dies leaves no pointer, so the next
one starts from the same state; nothing is half visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shared_dir, table
from . import corpus, documents, edges, extract, fulltext, scan
from .store import Store

KEYS = ["ws", "rel"]


def file_rows(files: DataFrame) -> DataFrame:
    """Stored rows of files: what is known of them but their content."""
    lines = F.when(F.col("content").isNotNull(), F.size(F.split("content", "\n"))).cast("bigint")
    return files.dropDuplicates(KEYS).select(
        *KEYS, "hash", F.col("size").cast("bigint").alias("size"), "mtime", F.coalesce("indexed", F.lit(True)).alias("indexed"), lines.alias("lines"), F.lit(extract.analyzer_version()).alias("analyzer_version"),
    )


def tokens(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Postings with the file they belong to: of paths and contents, and of names, paths, docs and signatures of symbols."""
    f = corpus.content(files).dropDuplicates(KEYS)
    parts = [f.select(*KEYS, F.lit("file").alias("type"), F.col("rel").alias("key"), F.lit(c).alias("field"), F.col(c).alias("t")) for c in ("rel", "content")]
    s = symbols.withColumn("key", F.concat_ws("::", "rel", "path", F.col("line_start").cast("string")))
    parts += [s.select(*KEYS, F.lit("symbol").alias("type"), "key", F.lit(c).alias("field"), F.col(c).alias("t")) for c in ("name", "path", "doc", "signature")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("t IS NOT NULL").select(*KEYS, "type", "key", "field", F.inline(fulltext.counted_terms(F.col("t"))))


def analysed(files: DataFrame) -> dict[str, DataFrame]:
    """Every table of the index for some files with content."""
    symbols = materialise(extract.extract_files(files).where("reason IS NULL").drop("reason").withColumnRenamed("file", "rel"), "symbols")
    chunk = documents.chunk_rows(files)
    return {
        "files": file_rows(files), "symbols": symbols, "imports": edges.statements(files), "tokens": tokens(files, symbols),
        "chunks": chunk.drop("text") if "text" in chunk.columns else chunk,
    }


def sync(store: Store, files: DataFrame, force: bool = False) -> dict[str, int]:
    """Make ``store`` hold ``files`` (with content); how many files were in each state of the scan diff."""
    seen = files.select(*KEYS, "size", "mtime", "hash", F.lit(False).alias("gone"), F.current_timestamp().alias("seen_at"))
    if store.pointer() is None:
        n = files.select(*KEYS).distinct().count()
        store.save(analysed(files), "first")
        return {"new": n}
    states = materialise(scan.diff(seen, store.load("files"), version=extract.analyzer_version(), force=force), "states")
    counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    todo = states.where("state IN ('new', 'changed', 'stale')").select(*KEYS)
    gone = states.where("state IN ('new', 'changed', 'stale', 'removed')").select(*KEYS)
    if any(counts.get(s) for s in ("new", "changed", "stale", "removed")):
        made = analysed(files.join(todo, KEYS, "left_semi"))
        store.change({name: (df, gone, KEYS) for name, df in made.items()}, "sync")
    return counts


# -- queries


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").where("ws IS NOT NULL AND rel IS NOT NULL")


def sync_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs: over the files below src, over all, and over all again without documents; what each found and what is stored in the end."""
    store = Store(spark, shared_dir(spark, "sync"))
    files, rows = _corpus(spark, sf), []
    for n, some in enumerate((files.where("rel LIKE 'src/%'"), files, files.where("rel NOT LIKE '%.md'")), 1):
        rows += [(n, state, k) for state, k in sync(store, some).items() if state in ("new", "removed")]
    left = [(0, name, store.load(name).select(*KEYS).distinct().count()) for name in ("files",)]
    return spark.createDataFrame(rows + left, "run int, what string, files bigint")


QUERIES = {"sync_runs": sync_runs}
ORACLE = {
    "sync_runs": """WITH f AS (SELECT DISTINCT ws, rel FROM files WHERE ws IS NOT NULL AND rel IS NOT NULL), x AS (SELECT 1 AS run, 'new' AS what, count(*) AS files FROM f WHERE rel LIKE 'src/%'
 UNION ALL SELECT 2, 'new', count(*) FROM f WHERE rel NOT LIKE 'src/%' UNION ALL SELECT 3, 'removed', count(*) FROM f WHERE rel LIKE '%.md' UNION ALL SELECT 0, 'files', count(*) FROM f WHERE rel NOT LIKE '%.md') SELECT * FROM x WHERE files > 0 OR run = 0""",
}
