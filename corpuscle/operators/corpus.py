"""The corpus as DataFrames: searchable files, their lines, listings and statistics.

``files`` holds about one exact copy in a hundred rows. Operators on lines filter first and drop copies from what is left,
because a distinct over whole contents would shuffle all text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import match, paths, text
from ..session import table
from . import fulltext, ordered


def searchable(files: DataFrame) -> DataFrame:
    """Files whose content may be read: indexed (unknown counts as yes), not secret by name, with content."""
    return files.where(F.coalesce("indexed", F.lit(True)) & ~paths.is_secret(F.col("rel")) & F.col("content").isNotNull())


def content(files: DataFrame) -> DataFrame:
    return searchable(files).select("ws", "rel", "content")


def searchable_or_plain(files: DataFrame) -> DataFrame:
    """Content of small settings files that a walk lists but whose extension names no text."""
    return files.where(~paths.is_secret(F.col("rel")) & F.col("content").isNotNull()).select("ws", "rel", "content")


def file_rows(files: DataFrame) -> DataFrame:
    """One row per file without its content (never read from the scan): names, sizes and flags."""
    return files.select("ws", "rel", "hash", "size", "mtime", "lang", "lines", "parsed", "indexed", "reason", F.coalesce(F.size("symbols"), F.lit(0)).alias("n_symbols")).dropDuplicates(["ws", "rel"])


# -- queries: listings, statistics, addressing


def files_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Files below src of every workspace with language by name, directory and number of symbols."""
    rel = F.col("rel")
    rows = file_rows(table(spark, sf, "files")).where(paths.in_dir(rel, "src"))
    return rows.select("ws", "rel", "size", "lines", paths.lang_of(rel).alias("lang"), paths.dirname(rel).alias("dir"), "n_symbols", "hash")


def stats_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    rows = file_rows(table(spark, sf, "files"))
    return rows.groupBy(paths.lang_of(F.col("rel")).alias("lang")).agg(
        F.count("*").alias("files"), F.count_if(F.col("n_symbols") > 0).alias("with_symbols"), F.count_if(F.coalesce("indexed", F.lit(True))).alias("searchable"),
        F.count_if(F.coalesce("indexed", F.lit(True)) == F.lit(False)).alias("opaque"), F.count_if(F.col("parsed") == F.lit(False)).alias("failed_parse"),
    )


def structure_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Files, lines and symbols per directory, with totals of each workspace (dir null)."""
    rows = file_rows(table(spark, sf, "files")).select("ws", paths.dirname(F.col("rel")).alias("dir"), "lines", "n_symbols")
    agg = [F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.sum("n_symbols").alias("symbols")]
    return rows.groupingSets([["ws", "dir"], ["ws"]], "ws", "dir").agg(*agg)


def structure_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Structure of a plain string prefix: 'lib' also takes what begins like it."""
    rows = file_rows(table(spark, sf, "files")).where(F.col("rel").startswith("li"))
    return rows.groupBy("ws").agg(F.count("*").alias("files"), F.sum("n_symbols").alias("symbols"))


def largest_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve largest top-level symbols (a top-k report)."""
    s = table(spark, sf, "symbols").where("parent IS NULL").select("ws", "file", "name", "kind", (F.col("line_end") - F.col("line_start") + 1).alias("span")).distinct()
    return s.orderBy(F.desc("span"), "ws", "file", "name").limit(12)


def symbols_table(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of every file with their place, doc cut to 160."""
    s = table(spark, sf, "symbols")
    return s.select("ws", "file", "name", "path", "parent", "line_start", "line_end", F.substring("doc", 1, 160).alias("doc"), F.coalesce("exported", F.lit(False)).alias("exported")).distinct()


def secret_files(spark: SparkSession, sf: str) -> DataFrame:
    rel = F.col("rel")
    rows = table(spark, sf, "files").select("ws", "rel", "size").distinct()
    return rows.where(~paths.is_textual(rel, F.col("size"))).select("ws", "rel", paths.is_secret(rel).alias("secret"), paths.opaque_reason(rel).alias("why"))


def file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-1 of contents beside the stored hash."""
    f = table(spark, sf, "files").where("content IS NOT NULL")
    return f.select("ws", "rel", text.sha1_upper(F.col("content")).alias("sha1"), (text.sha1_upper(F.col("content")) == F.upper("hash")).alias("same")).distinct()


def eol_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files").where("content IS NOT NULL").select("ws", "rel", text.dominant_eol(F.col("content")).alias("eol"), F.length("content").alias("n_chars"), F.regexp_count("content", F.lit("\n")).alias("n_breaks")).distinct()
    return f.groupBy("ws", F.when(F.col("eol") == "\n", "lf").otherwise("crlf").alias("eol")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("n_chars"), F.sum("n_breaks").alias("n_breaks"))


def walk_listing(spark: SparkSession, sf: str) -> DataFrame:
    """What a walk would list under an ignore file: the newest listed state of each file."""
    rel = F.col("rel")
    rows = table(spark, sf, "listings").select("ws", "rel").distinct()
    return rows.where(paths.walk_filter(rel, "*.md\n/tools/\nfixtures/\n!keep\n") & paths.path_ok(rel)).select("ws", paths.clean_path(rel).alias("rel"), paths.basename(rel).alias("base"))


def glob_paths(spark: SparkSession, sf: str) -> DataFrame:
    m = paths.PathMatcher(roots=("src", "./lib/"), include=("*.{py,go}", "**/tide/**", "src/*-[a-m]*"), exclude=("lib/**/*_1*",))
    rows = file_rows(table(spark, sf, "files"))
    return rows.where(m.column(F.col("rel"))).select("ws", "rel", "size", "lines", paths.lang_of(F.col("rel")).alias("lang"), F.coalesce("indexed", F.lit(True)).alias("indexed"))


def addressing(spark: SparkSession, sf: str) -> DataFrame:
    """How each name addresses symbols: exact path, path suffix (with a dot), then bare name; only the best tier counts.

    Every name, path, path head and dotted path end of the table is asked. What a symbol answers to is exploded from its own
    row, which is the join of the names asked with the table: a head that is neither path nor name has no candidate.
    """
    s = table(spark, sf, "symbols").select("ws", "file", "path", "name").distinct()
    path, parts = F.col("path"), F.split(F.coalesce("path", F.lit("")), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = F.filter(ends, lambda q: (q == path) | q.contains("."))
    tiers = F.transform(ends, lambda q: F.struct(q.alias("q"), F.when(q == path, 0).otherwise(1).alias("tier")))
    each = s.select("ws", "file", "path", F.inline(F.array_append(tiers, F.struct(F.col("name").alias("q"), F.lit(2).alias("tier"))))).where("q IS NOT NULL")
    one = each.groupBy("q", "ws", "file", "path").agg(F.min("tier").alias("tier")).groupBy("q", "tier").agg(F.count("*").alias("candidates"))
    return one.groupBy("q").agg(F.min(F.struct("tier", "candidates")).alias("b")).select("q", "b.tier", "b.candidates")


def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols whose name occurs more than once in their workspace, with the ordinal that tells them apart."""
    s = table(spark, sf, "symbols").where("name IS NOT NULL").select("ws", "file", "name", "path", "line_start").distinct()
    often = s.groupBy("ws", "name").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    same = ordered.before(s.join(often, ["ws", "name"], "left_semi"), ["ws", "name"], ["file", "line_start", "path"])
    return same.select("ws", "file", "line_start", F.concat("name", F.lit(" §"), (F.col("before") + 1).cast("string")).alias("piece"))


def tokens_df(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and documents of every index term of all documents."""
    # counted in each row first, so that a frequent term reaches its task as few rows
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.inline(fulltext.counted_terms(F.col("text"))))
    return d.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))


QUERIES = {
    f.__name__: f
    for f in (files_listing, stats_by_lang, structure_dirs, structure_prefix, largest_symbols, symbols_table, secret_files, file_hashes, eol_stats, walk_listing, glob_paths, addressing, duplicate_names, tokens_df)
}

EXT_SQL = "lower(regexp_extract(rel, '(\\.[^./\\\\]+)$', 1))"
LANG_SQL = "CASE " + " ".join(f"WHEN {EXT_SQL} IN ({', '.join(repr(e) for e in exts.split())}) THEN '{lang}'" for lang, exts in paths.EXT_LANGS.items()) + " ELSE 'other' END"
DIR_SQL = "CASE WHEN rel NOT LIKE '%/%' THEN '.' WHEN regexp_matches(rel, '^/[^/]*$') THEN '/' ELSE regexp_extract(rel, '^(.*)/[^/]*$', 1) END"
SECRET_SQL = "(" + " OR ".join("regexp_matches(replace(rel, '\\', '/'), '" + p + "', 'i')" for p in paths.SECRET_PATTERNS) + ")"
FILES_SQL = f"""F AS (SELECT ws, rel, any_value(hash) AS hash, any_value(size) AS size, any_value(lines) AS lines, any_value(parsed) AS parsed,
 any_value(indexed) AS indexed, any_value(CAST(coalesce(len(symbols), 0) AS INTEGER)) AS n_symbols, any_value({LANG_SQL}) AS lang, any_value({DIR_SQL}) AS dir FROM files GROUP BY ws, rel)"""
SEARCHABLE_SQL = f"C AS (SELECT DISTINCT ws, rel, content FROM files WHERE coalesce(indexed, true) AND NOT {SECRET_SQL} AND content IS NOT NULL)"
LINES_SQL = SEARCHABLE_SQL + """,
 B AS (SELECT ws, rel, string_split(CASE WHEN content LIKE '%' || chr(10) THEN left(content, -1) ELSE content END, chr(10)) AS a FROM C WHERE len(content) > 0),
 U AS (SELECT ws, rel, unnest(a) AS raw, generate_subscripts(a, 1) AS ln FROM B),
 L AS (SELECT ws, rel, CAST(ln AS INTEGER) AS ln, CASE WHEN raw LIKE '%' || chr(13) THEN left(raw, -1) ELSE raw END AS line FROM U)"""
KNOWN_EXT_SQL = ", ".join(repr(e) for e in [*paths.LANG_OF_EXT, *paths.TEXT_EXT])
STOP_SQL = ", ".join(repr(w) for w in match.STOPWORDS)
TERMS_SQL = f"""T AS (SELECT doc_id, left(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), 64) AS term FROM documents WHERE text IS NOT NULL),
 K AS (SELECT doc_id, term FROM T WHERE len(term) >= 2 AND term NOT IN ({STOP_SQL}))"""

ORACLE = {
    "files_listing": f"WITH {FILES_SQL} SELECT ws, rel, size, lines, lang, dir, n_symbols, hash FROM F WHERE rel LIKE 'src/%'",
    "stats_by_lang": f"""WITH {FILES_SQL} SELECT lang, count(*) AS files, count(*) FILTER (n_symbols > 0) AS with_symbols, count(*) FILTER (coalesce(indexed, true)) AS searchable,
 count(*) FILTER (NOT coalesce(indexed, true)) AS opaque, count(*) FILTER (parsed = false) AS failed_parse FROM F GROUP BY lang""",
    "structure_dirs": f"WITH {FILES_SQL} SELECT ws, dir, count(*) AS files, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines, CAST(sum(n_symbols) AS BIGINT) AS symbols FROM F GROUP BY GROUPING SETS ((ws, dir), (ws))",
    "structure_prefix": f"WITH {FILES_SQL} SELECT ws, count(*) AS files, CAST(sum(n_symbols) AS BIGINT) AS symbols FROM F WHERE starts_with(rel, 'li') GROUP BY ws",
    "largest_symbols": "SELECT DISTINCT ws, file, name, kind, line_end - line_start + 1 AS span FROM symbols WHERE parent IS NULL ORDER BY span DESC, ws, file, name LIMIT 12",
    "symbols_table": "SELECT DISTINCT ws, file, name, path, parent, line_start, line_end, left(doc, 160) AS doc, coalesce(exported, false) AS exported FROM symbols",
    "secret_files": f"""SELECT DISTINCT ws, rel, {SECRET_SQL} AS secret, CASE WHEN {SECRET_SQL} THEN '{paths.OPAQUE_SECRET}' ELSE '{paths.OPAQUE_OTHER}' END AS why FROM files
 WHERE NOT ({EXT_SQL} IN ({KNOWN_EXT_SQL}) AND NOT {SECRET_SQL} AND coalesce(size <= {paths.TEXT_MAX}, true))""",
    "file_hashes": "SELECT DISTINCT ws, rel, upper(sha1(content)) AS sha1, upper(sha1(content)) = upper(hash) AS same FROM files WHERE content IS NOT NULL",
    "eol_stats": """WITH a AS (SELECT DISTINCT ws, rel, content FROM files WHERE content IS NOT NULL),
 b AS (SELECT ws, len(content) AS n, len(content) - len(replace(content, chr(10), '')) AS lf, (len(content) - len(replace(content, chr(13) || chr(10), ''))) // 2 AS crlf FROM a)
 SELECT ws, CASE WHEN crlf * 2 > lf THEN 'crlf' ELSE 'lf' END AS eol, count(*) AS files, CAST(sum(n) AS BIGINT) AS n_chars, CAST(sum(lf) AS BIGINT) AS n_breaks FROM b GROUP BY ALL""",
    "walk_listing": """SELECT DISTINCT ws, rel, regexp_extract(rel, '([^/]*)$', 1) AS base FROM listings
 WHERE NOT regexp_matches(rel, '(^|/)(node_modules|dist|build|coverage|vendor|fixtures)/') AND NOT regexp_matches(rel, '(^|/)\\.(git|hg|svn|idea|next|nuxt|cache|venv|vs|tox|yarn|expo)/')
 AND NOT regexp_matches(rel, '(^|/)[^/]*\\.md(/|$)') AND rel NOT LIKE 'tools/%'""",
    "glob_paths": f"""WITH {FILES_SQL} SELECT ws, rel, size, lines, lang, coalesce(indexed, true) AS indexed FROM F WHERE (rel LIKE 'src/%' OR rel LIKE 'lib/%')
 AND (regexp_matches(rel, '\\.(py|go)$') OR regexp_matches(rel, '(^|/)tide/') OR regexp_matches(rel, '^src/[^/]*-[a-m][^/]*(/|$)')) AND NOT regexp_matches(rel, '^lib/([^/]*/)*[^/]*_1[^/]*')""",
    "addressing": """WITH s AS (SELECT DISTINCT ws, file, path, name FROM symbols), p AS (SELECT *, string_split(path, '.') AS a FROM s),
 e AS (SELECT ws, file, path, array_to_string(a[i:], '.') AS q FROM (SELECT ws, file, path, a, unnest(range(1, len(a) + 1)) AS i FROM p)),
 t AS (SELECT path AS q, ws, file, path, 0 AS tier FROM s UNION ALL SELECT q, ws, file, path, 1 FROM e WHERE contains(q, '.') AND q <> path UNION ALL SELECT name, ws, file, path, 2 FROM s),
 b AS (SELECT q, ws, file, path, min(tier) AS tier FROM t WHERE q IS NOT NULL GROUP BY ALL),
 m AS (SELECT q, min(tier) AS tier FROM b GROUP BY q) SELECT b.q, CAST(b.tier AS INTEGER) AS tier, count(*) AS candidates FROM b JOIN m ON b.q = m.q AND b.tier = m.tier GROUP BY ALL""",
    "duplicate_names": """WITH s AS (SELECT DISTINCT ws, file, name, path, line_start FROM symbols),
 n AS (SELECT *, count(*) OVER (PARTITION BY ws, name) AS n, row_number() OVER (PARTITION BY ws, name ORDER BY file, line_start, path) AS i FROM s)
 SELECT ws, file, line_start, name || ' §' || i AS piece FROM n WHERE n > 1""",
    "tokens_df": f"WITH {TERMS_SQL} SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM K GROUP BY term",
}
