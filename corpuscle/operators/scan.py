"""Scans against the stored state: full diff, moved and gone flags, removals, orphans, and verify-on-read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, table_lang
from .incremental import hash_number


def newest(listings: DataFrame) -> DataFrame:
    """The newest listed state of each file, whether it is gone or not."""
    key = F.col("ws").isNotNull() & F.col("rel").isNotNull()
    state = F.struct("seen_at", F.coalesce("gone", F.lit(False)).alias("gone"), "size", "mtime", hash_number(F.col("hash")).alias("hash"))
    return listings.where(key).groupBy("ws", "rel").agg(F.max(state).alias("l"))


def stored(files: DataFrame) -> DataFrame:
    state = F.struct("mtime", "size", hash_number(F.col("hash")).alias("hash"), F.coalesce("analyzer_version", F.lit("")).alias("version"))
    return files.where("ws IS NOT NULL AND rel IS NOT NULL").groupBy("ws", "rel").agg(F.max(state).alias("f"))


def moved(l: Column, f: Column) -> Column:  # noqa: E741
    """Size or time differ or are unknown on either side; null-safe, so never null."""
    return ~l["size"].eqNullSafe(f["size"]) | ~l["mtime"].eqNullSafe(f["mtime"]) | l["size"].isNull() | l["mtime"].isNull()


def diff(listings: DataFrame, files: DataFrame, version: str | None = None, force: bool = False) -> DataFrame:
    """(ws, rel, state) of every file on either side.

    new, removed (gone or no longer listed), touched (moved, same hash), changed (hash differs, or moved without a hash),
    stale (unchanged, but of another analyser version) and unchanged. ``force`` compares hashes even if nothing moved.
    One full outer join on the key that both aggregations already use.
    """
    j = newest(listings).join(stored(files), ["ws", "rel"], "full_outer")
    l, f = F.col("l"), F.col("f")  # noqa: E741
    there = l.isNotNull() & ~F.coalesce(l["gone"], F.lit(False))
    m = F.lit(True) if force else moved(l, f)
    same = l["hash"].eqNullSafe(f["hash"])
    state = (
        F.when(~there & f.isNotNull(), "removed")
        .when(~there, "absent")
        .when(f.isNull(), "new")
        .when(m & l["hash"].isNotNull() & ~same, "changed")
        .when(m & l["hash"].isNull() & moved(l, f), "changed")
        .when(F.lit(version is not None) & (f["version"] != F.lit(version or "")), "stale")
        .when(moved(l, f), "touched")
        .otherwise("unchanged")
    )
    return j.select("ws", "rel", state.alias("state")).where("state <> 'absent'")


def flags(listings: DataFrame, files: DataFrame) -> DataFrame:
    """``moved``, ``gone`` and ``unverified`` of each stored file against a fresh listing."""
    j = stored(files).join(newest(listings), ["ws", "rel"], "left")
    l, f = F.col("l"), F.col("f")  # noqa: E741
    return j.select("ws", "rel", F.coalesce(moved(l, f) & ~l["gone"], F.lit(False)).alias("moved"), F.coalesce(l["gone"], F.lit(False)).alias("gone"), l.isNull().alias("unverified"))


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` that nothing on the right claims."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def verify(result: DataFrame, listings: DataFrame, files: DataFrame) -> DataFrame:
    """A result set with the state of what it quotes: only files of the result are compared."""
    keys = result.select("ws", "rel").distinct()
    return result.join(flags(listings.join(keys, ["ws", "rel"], "left_semi"), files.join(keys, ["ws", "rel"], "left_semi")), ["ws", "rel"], "left")


def commit_outcome(before: Column, wanted: Column, after: Column) -> Column:
    """What became of a write, from hashes before, intended and read back."""
    return (
        F.when(after.isNull() & wanted.isNotNull(), F.when(before.isNull(), "missing").otherwise("removed"))
        .when(after.eqNullSafe(wanted), F.when(before.eqNullSafe(wanted), "unchanged").otherwise("written"))
        .when(after.eqNullSafe(before), "not written")
        .otherwise("changed by another")
    )


# -- queries


def _t(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "listings"), table(spark, sf, "files")


def scan_diff(spark: SparkSession, sf: str) -> DataFrame:
    return diff(*_t(spark, sf), version="a:3")


def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diff(*_t(spark, sf)).groupBy("ws", "state").agg(F.count("*").alias("files"))


def removed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Stored files that are gone by their newest listing, or not listed at all."""
    listings, files = _t(spark, sf)
    there = newest(listings).where("NOT l.gone").select("ws", "rel")
    return orphans(files.select("ws", "rel").distinct(), there, ["ws", "rel"])


def moved_flags(spark: SparkSession, sf: str) -> DataFrame:
    return flags(*_t(spark, sf))


def orphaned_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Files that the symbol table knows and the file table does not, and the reverse for code of every language."""
    s = table(spark, sf, "symbols").select("ws", F.col("file").alias("rel")).distinct()
    f = table(spark, sf, "files").where(F.col("content").isNotNull() & ~table_lang(F.col("rel")).isin("*", "json")).select("ws", "rel").distinct()
    a = orphans(s, f.union(table(spark, sf, "files").select("ws", "rel")), ["ws", "rel"]).withColumn("side", F.lit("symbols"))
    return a.unionByName(orphans(f, s, ["ws", "rel"]).withColumn("side", F.lit("files")))


def commit_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The stored hash as the one before, the newest listed as read back, the greatest listed as intended."""
    listings, files = _t(spark, sf)
    want = listings.where("hash IS NOT NULL").groupBy("ws", "rel").agg(F.max(hash_number(F.col("hash"))).alias("wanted"))
    j = stored(files).join(newest(listings), ["ws", "rel"]).join(want, ["ws", "rel"], "left")
    return j.groupBy(commit_outcome(F.col("f.hash"), F.col("wanted"), F.col("l.hash")).alias("outcome")).agg(F.count("*").alias("files"))


def scan_history(spark: SparkSession, sf: str) -> DataFrame:
    """Scans of each workspace: how many, how many succeeded, how many began after the last success."""
    s = table(spark, sf, "scans").distinct()
    ok = F.col("status").eqNullSafe(F.lit("ok"))
    last = s.groupBy("ws").agg(F.max(F.when(ok, F.col("started_at"))).alias("last_ok"), F.count("*").alias("scans"), F.count_if(ok).alias("succeeded"))
    after = s.join(last, "ws").where(F.col("last_ok").isNull() | (F.col("started_at") > F.col("last_ok"))).groupBy("ws").agg(F.count("*").alias("after"))
    return last.join(after, "ws", "left").select("ws", "scans", "succeeded", F.coalesce("after", F.lit(0)).alias("after_last_success"))


QUERIES = {f.__name__: f for f in (scan_diff, scan_summary, removed_files, moved_flags, orphaned_symbols, commit_outcomes, scan_history)}

_H = "ltrim(lower(nullif(trim(hash), '')), '0')"
_N = f"""L AS (SELECT ws, rel, size, mtime, coalesce(gone, false) AS gone, {_H} AS hash FROM listings WHERE ws IS NOT NULL AND rel IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY ws, rel ORDER BY seen_at DESC NULLS LAST) = 1),
 S AS (SELECT DISTINCT ws, rel, size, mtime, {_H} AS hash, coalesce(analyzer_version, '') AS version FROM files WHERE ws IS NOT NULL AND rel IS NOT NULL),
 J AS (SELECT coalesce(L.ws, S.ws) AS ws, coalesce(L.rel, S.rel) AS rel, L.ws IS NOT NULL AS listed, S.ws IS NOT NULL AS known, L.gone, L.hash AS lh, S.hash AS sh, S.version,
  L.size IS DISTINCT FROM S.size OR L.mtime IS DISTINCT FROM S.mtime OR L.size IS NULL OR L.mtime IS NULL AS moved FROM L FULL OUTER JOIN S ON L.ws = S.ws AND L.rel = S.rel)"""


def _state(stale: str) -> str:
    return f"""CASE WHEN (NOT listed OR gone) AND known THEN 'removed' WHEN NOT listed OR gone THEN 'absent' WHEN NOT known THEN 'new' WHEN moved AND lh IS NOT NULL AND lh IS DISTINCT FROM sh THEN 'changed'
 WHEN moved AND lh IS NULL THEN 'changed' {stale} WHEN moved THEN 'touched' ELSE 'unchanged' END"""


ORACLE = {
    "scan_diff": f"WITH {_N} SELECT ws, rel, {_state(chr(10) + "WHEN version <> 'a:3' THEN 'stale'")} AS state FROM J WHERE state <> 'absent'",
    "scan_summary": f"WITH {_N}, X AS (SELECT ws, rel, {_state('')} AS state FROM J) SELECT ws, state, count(*) AS files FROM X WHERE state <> 'absent' GROUP BY ws, state",
    "removed_files": f"WITH {_N} SELECT ws, rel FROM J WHERE known AND (NOT listed OR gone)",
    "moved_flags": f"WITH {_N} SELECT ws, rel, coalesce(moved AND NOT gone, false) AS moved, coalesce(gone, false) AS gone, NOT listed AS unverified FROM J WHERE known",
    "orphaned_symbols": """SELECT DISTINCT ws, file AS rel, 'symbols' AS side FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.ws = s.ws AND f.rel = s.file)
 UNION ALL SELECT DISTINCT ws, rel, 'files' FROM files f WHERE content IS NOT NULL AND regexp_matches(rel, '\\.(py|m?js|ts|go|java|rs)$') AND NOT EXISTS (SELECT 1 FROM symbols s WHERE f.ws = s.ws AND f.rel = s.file)""",
    "commit_outcomes": f"""WITH {_N}, W AS (SELECT ws, rel, max({_H}) AS w FROM listings WHERE hash IS NOT NULL GROUP BY ws, rel)
 SELECT CASE WHEN lh IS NULL AND w IS NOT NULL THEN CASE WHEN sh IS NULL THEN 'missing' ELSE 'removed' END WHEN lh IS NOT DISTINCT FROM w THEN CASE WHEN sh IS NOT DISTINCT FROM w THEN 'unchanged' ELSE 'written' END
 WHEN lh IS NOT DISTINCT FROM sh THEN 'not written' ELSE 'changed by another' END AS outcome, count(*) AS files FROM J LEFT JOIN W ON J.ws = W.ws AND J.rel = W.rel WHERE listed AND known GROUP BY 1""",
    "scan_history": """WITH s AS (SELECT DISTINCT * FROM scans), l AS (SELECT ws, max(started_at) FILTER (status = 'ok') AS last_ok, count(*) AS scans, count(*) FILTER (status = 'ok') AS succeeded FROM s GROUP BY ws)
 SELECT l.ws, scans, succeeded, (SELECT count(*) FROM s WHERE s.ws = l.ws AND (l.last_ok IS NULL OR s.started_at > l.last_ok)) AS after_last_success FROM l""",
}
