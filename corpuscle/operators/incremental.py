"""Processing only new or changed records: which listed files have to be processed, each once.

Cases: rows without ``ws`` or ``rel`` name no file and are left out. Repeated rows count once. Among rows of a file the
greatest ``seen_at`` counts whenever it arrived (null is least; a tie, which true data do not have, falls to the
greatest remaining values). ``gone`` null means not gone. A blank hash counts as null. Hashes compare as hexadecimal
numbers. Empty tables give no rows, an empty ``files`` makes all listed files new. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import observed, shared_dir, table
from .ledger import Ledger, Runs, run_ledger, with_slot


def hash_number(c: Column) -> Column:
    """A hexadecimal hash as a canonical string: no sign of case or leading zeros; null for blank."""
    digits = F.regexp_replace(F.lower(F.trim(c)), "^(0x)?0*(?=.)", "")
    return F.when(F.length(F.trim(c)) > 0, digits)


KEY = ["ws", "rel"]
NAMED = "ws IS NOT NULL AND rel IS NOT NULL"


def newest_listing(listings: DataFrame) -> DataFrame:
    """(ws, rel, l): the row of each file with the greatest ``seen_at``, by map-side partial aggregation on (ws, rel)."""
    row = F.struct("seen_at", F.coalesce("gone", F.lit(False)).alias("gone"), "size", "mtime", hash_number(F.col("hash")).alias("hash"))
    return listings.where(NAMED).groupBy(*KEY).agg(F.max(row).alias("l"))


def known_files(files: DataFrame) -> DataFrame:
    """(ws, rel, f): what the index holds of each file."""
    return files.where(NAMED).groupBy(*KEY).agg(F.max(F.struct("mtime", "size", hash_number(F.col("hash")).alias("hash"))).alias("f"))


def differs(l: Column, k: Column) -> Column:  # noqa: E741
    """Whether the listing ``l`` says anything else than the known state ``k``, null where nothing is known."""
    moved = ~l["size"].eqNullSafe(k["size"]) | ~l["mtime"].eqNullSafe(k["mtime"])
    return k.isNull() | F.when(l["hash"].isNotNull(), ~l["hash"].eqNullSafe(k["hash"])).otherwise(moved)


def changed_files(listings: DataFrame, files: DataFrame) -> DataFrame:
    """One row (ws, rel, size, mtime, hash) per file whose newest listing is not what ``files`` holds.

    Both sides are reduced on (ws, rel), and the join runs on the same key, so each table is shuffled once. The key is
    spread evenly even if one ``ws`` holds a third of all rows.
    """
    compared = newest_listing(listings).where("NOT l.gone").join(known_files(files), KEY, "left")
    return compared.where(differs(F.col("l"), F.col("f"))).select(*KEY, "l.size", "l.mtime", "l.hash")


STATE = "ws string, rel string, seen_at {time}, gone boolean, known struct<mtime:double,size:bigint,hash:string>, size bigint, mtime double, hash string, slot int, changed boolean"


def state_schema(listings: DataFrame) -> str:
    return STATE.format(time=listings.schema["seen_at"].dataType.simpleString())


def plan_run(spark: SparkSession, listings: DataFrame, files: DataFrame, folder: str, left: dict | None) -> dict:
    """Write the state of every listed file after this run, with a mark at those that have to be processed in it.

    ``left`` is what the last successful run left: its state, and the greatest ``arrived_at`` it had seen. Of
    ``listings`` only rows that arrived since then are read; a row that arrives late but was seen before what is known
    changes nothing. What is known of a file is the last state that was processed, or that of ``files``.
    """
    mark = F.lit(left["mark"]).cast(listings.schema["arrived_at"].dataType) if left and left["mark"] else None
    fresh = listings if mark is None else listings.where((F.col("arrived_at") >= mark) | F.col("arrived_at").isNull())
    seen = newest_listing(fresh)
    if left:
        before = spark.read.schema(state_schema(listings)).parquet(left["state"]).select(*KEY, F.struct("seen_at", "gone", "known").alias("b"))
        joined = seen.join(before, KEY, "full_outer")
    else:
        joined = seen.withColumn("b", F.lit(None).cast(f"struct<seen_at:{listings.schema['seen_at'].dataType.simpleString()},gone:boolean,known:struct<mtime:double,size:bigint,hash:string>>"))
    joined = joined.join(known_files(files), KEY, "left")
    l, b, f = F.col("l"), F.col("b"), F.col("f")  # noqa: E741
    newer = l.isNotNull() & (b.isNull() | (l["seen_at"] > b["seen_at"]) | (b["seen_at"].isNull() & l["seen_at"].isNotNull()))
    known = F.when(b.isNull(), f).otherwise(b["known"])  # null for a file that was gone
    moved = newer & ~l["gone"] & differs(l, known)
    after = F.when(newer & l["gone"], F.lit(None)).when(moved, F.struct(l["mtime"].alias("mtime"), l["size"].alias("size"), l["hash"].alias("hash"))).otherwise(known)
    rows = joined.select(
        *KEY, F.when(newer, l["seen_at"]).otherwise(b["seen_at"]).alias("seen_at"), F.when(newer, l["gone"]).otherwise(b["gone"]).alias("gone"),
        after.alias("known"), l["size"].alias("size"), l["mtime"].alias("mtime"), l["hash"].alias("hash"), moved.alias("changed"),
    )
    state, watch = f"{folder}/state", Observation()
    rows = rows.observe(watch, F.count_if("changed").alias("n"))
    with_slot(rows, KEY).write.partitionBy("changed").parquet(state)
    n = observed(watch, "n")
    if n is None:
        n = spark.read.schema(state_schema(listings)).parquet(state).where("changed").count()
    last = fresh.agg(F.max("arrived_at").cast("string")).first()[0]
    return {"state": state, "mark": last or (left or {}).get("mark"), "changed": n}


def process_changes(spark: SparkSession, listings: DataFrame, files: DataFrame, root: str, process=None, **options) -> DataFrame:
    """Run ``process`` over the files that are new or changed since the last successful run in ``root``: the rows it gave.

    Every call is one run. If the last one failed, its plan is taken up again: what it completed is not repeated, what
    it did not is not skipped, and what arrived meanwhile waits for the next run. ``last_success`` tells how far
    ``root`` has come; it moves only when a run has processed everything.
    """
    process = process or (lambda df: df.select("unit", "ws", "rel", "size", "mtime", "hash"))
    runs = Runs(spark, root)
    run = runs.begin(lambda folder, left: plan_run(spark, listings, files, folder, left))
    planned = spark.read.schema(state_schema(listings)).parquet(run["left"]["state"]).where("changed").drop("changed")
    out = run_ledger(None, KEY, process, run["folder"], spark, planned=planned, count=run["left"]["changed"], **options)
    runs.finish(run)
    return out


def last_success(spark: SparkSession, root: str) -> str | None:
    """The greatest ``arrived_at`` of the last run that succeeded, as text; None if there is none."""
    head = Runs(spark, root).head()[1]
    left = head["left"] if head["state"] == "done" else head["before"]
    return left["mark"] if left else None


# -- queries


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = process_changes(spark, table(spark, sf_dir, "listings"), table(spark, sf_dir, "files"), shared_dir(spark, "changes"))
    return out.select("ws", "rel")


def p2_ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State counts of a ledger after a run in units of 500 files, as the operator leaves it."""
    root = shared_dir(spark, "changes")
    process_changes(spark, table(spark, sf_dir, "listings"), table(spark, sf_dir, "files"), root, rows_per_unit=500)
    ledger = Ledger(spark, Runs(spark, root).head()[1]["folder"])
    rows = [(u, s, t) for u, (s, t) in sorted(ledger.states().items())]
    return spark.createDataFrame(rows, "unit int, state string, token int").groupBy("state").agg(F.count("*").alias("units"))


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs on one root: over the listings of the first half of the time, over all of them, and once more."""
    listings, files = table(spark, sf_dir, "listings"), table(spark, sf_dir, "files")
    first, last = listings.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    middle = F.lit(str(first + (last - first) // 2)).cast(listings.schema["arrived_at"].dataType)
    root, out = shared_dir(spark, "changes"), None
    for n, some in enumerate((listings.where(F.col("arrived_at") <= middle), listings, listings), 1):
        found = process_changes(spark, some, files, root).select(*KEY, F.lit(n).alias("run"))
        out = found if out is None else out.unionByName(found)
    return out


QUERIES = {"p2_found": p2_found, "p2_ledger_states": p2_ledger_states, "p2_runs": p2_runs}

_CHANGED = """
WITH h AS (
  SELECT ws, rel, size, mtime, coalesce(gone, false) AS gone,
         ltrim(lower(nullif(trim(hash), '')), '0') AS hash,
         row_number() OVER (PARTITION BY ws, rel ORDER BY seen_at DESC NULLS LAST) AS rn
  FROM listings WHERE ws IS NOT NULL AND rel IS NOT NULL),
f AS (SELECT DISTINCT ws, rel, size, mtime, ltrim(lower(nullif(trim(hash), '')), '0') AS hash FROM files)
SELECT DISTINCT h.ws, h.rel FROM h LEFT JOIN f ON h.ws = f.ws AND h.rel = f.rel
WHERE h.rn = 1 AND NOT h.gone AND (f.ws IS NULL
  OR (h.hash IS NOT NULL AND h.hash IS DISTINCT FROM f.hash)
  OR (h.hash IS NULL AND (h.size IS DISTINCT FROM f.size OR h.mtime IS DISTINCT FROM f.mtime)))
"""
ORACLE = {
    "p2_found": _CHANGED,
    "p2_ledger_states": f"SELECT 'done' AS state, CAST(greatest(1, ceil(count(*) / 500.0)) AS BIGINT) AS units FROM ({_CHANGED})",
    "p2_runs": """
WITH m AS (SELECT make_timestamp((epoch_us(min(arrived_at)) + epoch_us(max(arrived_at))) // 2) AS t FROM listings),
h AS (SELECT ws, rel, seen_at, arrived_at, size, mtime, coalesce(gone, false) AS gone, ltrim(lower(nullif(trim(hash), '')), '0') AS hash FROM listings WHERE ws IS NOT NULL AND rel IS NOT NULL),
a AS (SELECT h.* FROM h, m WHERE arrived_at <= t QUALIFY row_number() OVER (PARTITION BY ws, rel ORDER BY seen_at DESC) = 1),
b AS (SELECT h.* FROM h, m WHERE arrived_at > t QUALIFY row_number() OVER (PARTITION BY ws, rel ORDER BY seen_at DESC) = 1),
f AS (SELECT DISTINCT ws, rel, true AS there, size, mtime, ltrim(lower(nullif(trim(hash), '')), '0') AS hash FROM files),
one AS (SELECT a.*, f.there, f.size AS fs, f.mtime AS fm, f.hash AS fh, NOT a.gone AND (f.there IS NULL OR CASE WHEN a.hash IS NOT NULL THEN a.hash IS DISTINCT FROM f.hash
    ELSE a.size IS DISTINCT FROM f.size OR a.mtime IS DISTINCT FROM f.mtime END) AS changed FROM a LEFT JOIN f ON a.ws = f.ws AND a.rel = f.rel),
k AS (SELECT coalesce(one.ws, f.ws) AS ws, coalesce(one.rel, f.rel) AS rel, one.seen_at, CASE WHEN one.ws IS NULL THEN f.there WHEN one.gone THEN NULL WHEN one.changed THEN true ELSE one.there END AS there,
    CASE WHEN one.ws IS NULL THEN f.size WHEN one.changed THEN one.size ELSE one.fs END AS size, CASE WHEN one.ws IS NULL THEN f.mtime WHEN one.changed THEN one.mtime ELSE one.fm END AS mtime,
    CASE WHEN one.ws IS NULL THEN f.hash WHEN one.changed THEN one.hash ELSE one.fh END AS hash FROM one FULL JOIN f ON one.ws = f.ws AND one.rel = f.rel)
SELECT ws, rel, 1 AS run FROM one WHERE changed
UNION ALL SELECT b.ws, b.rel, 2 FROM b LEFT JOIN k ON b.ws = k.ws AND b.rel = k.rel WHERE (k.seen_at IS NULL OR b.seen_at > k.seen_at) AND NOT b.gone
  AND (k.there IS NULL OR CASE WHEN b.hash IS NOT NULL THEN b.hash IS DISTINCT FROM k.hash ELSE b.size IS DISTINCT FROM k.size OR b.mtime IS DISTINCT FROM k.mtime END)""",
}
