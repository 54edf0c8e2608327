"""The stored index: immutable generations behind a pointer, without any content, and the tables derived from them."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, table
from . import corpus, fulltext
from .ledger import _Fs

FILE_COLUMNS = ["ws", "rel", "hash", "size", "mtime", "lang", "lines", "parsed", "indexed", "reason", "lossless", "analyzer_version", "imports", "exports", "symbols"]


class Store:
    """``<root>/gen=<n>/<table>``, and ``<root>/pointer/<n>.json`` for each generation that was completed.

    A pointer names for every table the layers it is made of: a generation and the workspaces of it that still hold. A
    save of some tables carries all others forward, and a change writes only the workspaces it touches.
    A generation becomes visible when its pointer file is published, which is atomic and fails for the second of two
    writers. Readers take the newest pointer, so they never see half a write, and an older one stays readable meanwhile.
    """

    MOST_LAYERS, MOST_TOUCHED = 16, 10_000

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.fs = spark, root.rstrip("/"), _Fs(spark, root)

    def pointer(self, gen: int | None = None) -> dict | None:
        names = [n for n in self.fs.names(f"{self.root}/pointer") if n.endswith(".json")]
        if not names:
            return None
        return json.loads(self.fs.read(f"{self.root}/pointer/" + (names[-1] if gen is None else f"{gen:09d}.json")))

    def current(self) -> int | None:
        p = self.pointer()
        return p["gen"] if p else None

    def path(self, gen: int, name: str) -> str:
        return f"{self.root}/gen={gen}/{name}"

    def load(self, name: str, gen: int | None = None) -> DataFrame:
        p = self.pointer(gen)
        if p is None:
            raise LookupError("nothing is stored yet")
        if name not in p["tables"]:
            raise LookupError(f"no table {name} in generation {p['gen']}")
        out = None
        for layer in p["tables"][name]:
            df = self.spark.read.parquet(self.path(layer["gen"], name))
            if layer["without"]:  # whole directories, so they are not read
                df = df.where(~F.coalesce("ws", F.lit("")).isin(layer["without"]))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def _publish(self, gen: int, tables: dict[str, list[dict]], note: str) -> int:
        self.fs.publish(f"{self.root}/pointer/{gen:09d}.json", json.dumps({"gen": gen, "note": note, "at": time.time(), "tables": tables}))
        return gen

    def _write(self, gen: int, name: str, df: DataFrame) -> None:
        if "content" in df.columns or "text" in df.columns and name == "files":
            raise ValueError("content is not stored")
        df.write.mode("overwrite").partitionBy("ws").parquet(self.path(gen, name))

    def save(self, tables: dict[str, DataFrame], note: str = "") -> int:
        """Write whole tables as the next generation; those not named stay as they are. File rows never carry content."""
        p = self.pointer() or {"gen": -1, "tables": {}}
        gen = p["gen"] + 1
        for name, df in tables.items():
            self._write(gen, name, df)
        return self._publish(gen, {**p["tables"], **{name: [{"gen": gen, "without": []}] for name in tables}}, note)

    def change(self, changes: dict[str, tuple[DataFrame | None, DataFrame, list[str]]], note: str = "") -> int:
        """One generation from changes of several tables: for each (rows to put in, keys whose rows go, key columns).

        Only the workspaces that a change touches are written. Keys name whole groups of rows (a file), so stale rows of a
        touched file go with it.
        """
        p = self.pointer()
        if p is None:
            raise LookupError("nothing is stored yet")
        gen, tables = p["gen"] + 1, dict(p["tables"])
        for name, (rows, gone, keys) in changes.items():
            touched = [r["ws"] for r in gone.select(F.coalesce("ws", F.lit("")).alias("ws")).distinct().limit(self.MOST_TOUCHED + 1).collect()]
            if not touched:
                continue
            old = self.load(name)
            layers = tables[name]
            whole = len(touched) > self.MOST_TOUCHED or len(layers) >= self.MOST_LAYERS
            base = old if whole else old.where(F.coalesce("ws", F.lit("")).isin(touched))
            kept = base.join(gone.select(*keys).distinct(), keys, "left_anti")
            self._write(gen, name, kept if rows is None else kept.unionByName(rows, allowMissingColumns=True))
            tables[name] = [{"gen": gen, "without": []}] + ([] if whole else [{"gen": x["gen"], "without": sorted({*x["without"], *touched})} for x in layers])
        return self._publish(gen, tables, note)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], note: str = "") -> int:
        """``rows`` in place of those of the same keys."""
        return self.change({name: (rows, rows, keys)}, note)

    def remove(self, name: str, gone: DataFrame, keys: list[str], note: str = "") -> int:
        return self.change({name: (None, gone, keys)}, note)


def token_table(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The inverted index: (ws, type, key, field, term, tf) of symbols and of searchable contents."""
    f = corpus.content(files).dropDuplicates(["ws", "rel"])
    parts = [(f.select("ws", F.lit("file").alias("type"), F.col("rel").alias("key"), F.lit(name).alias("field"), F.col(c).alias("t"))) for name, c in (("rel", "rel"), ("content", "content"))]
    s = symbols.withColumn("key", F.concat_ws("::", "file", "path", F.col("line_start").cast("string"))).dropDuplicates(["ws", "key"])
    parts += [s.select("ws", F.lit("symbol").alias("type"), "key", F.lit(c).alias("field"), F.col(c).alias("t")) for c in ("name", "path", "doc", "signature")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("t IS NOT NULL").select("ws", "type", "key", "field", F.inline(fulltext.counted_terms(F.col("t"))))


# -- queries


def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Save file and symbol rows, replace some files in a second generation, read it back; the symbols are carried on."""
    store = Store(spark, shared_dir(spark, "store"))
    files = table(spark, sf, "files").select(*FILE_COLUMNS).dropDuplicates(["ws", "rel"])
    store.save({"files": files, "symbols": table(spark, sf, "symbols").distinct()})
    touched = files.where("rel LIKE 'src/%'").withColumn("analyzer_version", F.lit("a:4"))
    store.upsert("files", touched, ["ws", "rel"])
    of_files = store.load("files").groupBy("ws", "analyzer_version").agg(F.count("*").alias("files"))
    symbols = store.load("symbols").groupBy("ws").agg(F.count("*").alias("symbols"))
    return of_files.join(symbols, "ws", "left").select("ws", "analyzer_version", "files", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def index_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the inverted index by type and field, over everything."""
    t = token_table(table(spark, sf, "files"), table(spark, sf, "symbols"))
    return t.groupBy("type", "field").agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))


QUERIES = {f.__name__: f for f in (store_roundtrip, index_tokens)}
_W = "'[\\p{L}\\p{N}_]+'"
ORACLE = {
    "store_roundtrip": """WITH f AS (SELECT ws, rel, any_value(analyzer_version) AS v FROM files GROUP BY ws, rel)
, s AS (SELECT ws, count(*) AS symbols FROM (SELECT DISTINCT * FROM symbols) GROUP BY ws), g AS (SELECT ws, CASE WHEN rel LIKE 'src/%' THEN 'a:4' ELSE v END AS analyzer_version, count(*) AS files FROM f GROUP BY ALL)
 SELECT ws, analyzer_version, files, coalesce(symbols, 0) AS symbols FROM g LEFT JOIN s USING (ws)""",
    "index_tokens": f"""WITH {corpus.SEARCHABLE_SQL}, S AS (SELECT ws, file || '::' || path || '::' || line_start AS key, any_value(name) AS name, any_value(path) AS path, any_value(doc) AS doc, any_value(signature) AS signature FROM symbols GROUP BY 1, 2),
 A AS (SELECT 'file' AS type, ws, rel AS key, 'rel' AS field, rel AS t FROM C UNION ALL SELECT 'file', ws, rel, 'content', content FROM C UNION ALL SELECT 'symbol', ws, key, 'name', name FROM S
  UNION ALL SELECT 'symbol', ws, key, 'path', path FROM S UNION ALL SELECT 'symbol', ws, key, 'doc', doc FROM S UNION ALL SELECT 'symbol', ws, key, 'signature', signature FROM S),
 T AS (SELECT type, field, ws, key, left(unnest(regexp_extract_all(lower(t), {_W})), 64) AS term FROM A WHERE t IS NOT NULL), K AS (SELECT * FROM T WHERE len(term) >= 2 AND term NOT IN ({corpus.STOP_SQL})),
 G AS (SELECT type, field, ws, key, term, count(*) AS tf FROM K GROUP BY ALL) SELECT type, field, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences FROM G GROUP BY type, field""",
}
