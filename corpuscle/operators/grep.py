"""Grep over the corpus with exact totals, context, tallies and pages; mentions and references.

Every plan is: content scan with pruned columns, the predicate on whole contents first where it can be (a text without
the literal has no matching line), explosion to lines, the predicate on lines. Only matches are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import match, paths, text
from ..session import materialise, table
from . import corpus, ordered


def candidates(files: DataFrame, m: match.Matcher) -> DataFrame:
    """Searchable contents that can hold a match."""
    c = corpus.content(files)
    return c.where(m.test(F.col("content"))) if m.literal is not None else c


def matching_lines(files: DataFrame, m: match.Matcher, where: paths.PathMatcher | None = None) -> DataFrame:
    """(ws, rel, ln, col, line), each once."""
    c = candidates(files, m)
    if where:
        c = c.where(where.column(F.col("rel")))
    lines = text.with_lines(c)
    return lines.where(m.test(F.col("line"))).select("ws", "rel", "ln", m.column(F.col("line")).alias("col"), "line").distinct()


def with_context(files: DataFrame, m: match.Matcher, before: int, after: int) -> DataFrame:
    """Matches with the lines around them, clipped at the ends of the file.

    The lines around a match come from the split content itself by position, so no window over lines is needed.
    """
    c = candidates(files, m).where(F.length("content") > 0)
    bare = F.regexp_replace(F.col("content"), "\n$", "")
    lines = F.transform(F.split(bare, "\n"), lambda s: F.regexp_replace(s, "\r$", ""))
    hit = c.select("ws", "rel", lines.alias("a")).select("ws", "rel", "a", F.posexplode("a").alias("p", "line")).where(m.test(F.col("line")))
    lo = F.greatest(F.lit(1), F.col("p") + 1 - before)
    return hit.select(
        "ws", "rel", (F.col("p") + 1).alias("ln"), "line",
        F.slice("a", lo, F.col("p") + 1 - lo).alias("before"), F.slice("a", F.col("p") + 2, F.lit(after)).alias("after"),
    ).distinct()


def tally(files: DataFrame, m: match.Matcher) -> DataFrame:
    """Distinct matched strings: how often, on how many lines, in how many files. Empty matches do not count.

    Counted per (string, file) first, so a string that is everywhere reaches its final task as one row a file.
    """
    lines = text.with_lines(candidates(files, m)).where(m.test(F.col("line"))).distinct()
    found = lines.select("ws", "rel", "ln", F.explode(m.all(F.col("line"))).alias("text")).where(F.length("text") > 0)
    per_line = found.groupBy("text", "ws", "rel", "ln").agg(F.count("*").alias("n"))
    per_file = per_line.groupBy("text", "ws", "rel").agg(F.sum("n").alias("n"), F.count("*").alias("l"))
    return per_file.groupBy("text").agg(F.sum("n").alias("count"), F.sum("l").alias("lines"), F.count("*").alias("files"))


@dataclass(frozen=True)
class Page:
    """One page of matches and what is true of all of them."""

    rows: DataFrame
    total: int
    files: int
    page: int
    next: int | None


def page_rows(counts: Iterable[tuple[str, int]], max_matches: int, max_files: int, max_per_file: int) -> Iterator[tuple[int, str, int, int]]:
    """(page, file, first match, matches) of every page of an answer, from the counts of its files in path order.

    A page has at most so many matches and files, and so many matches of one file. A file that fills a page goes on
    alone on the pages behind it; what a file has beyond ``max_per_file`` on a page is passed over.
    """
    page, matches, files = 1, 0, 0
    alone = min(max_matches, max_per_file)
    for rel, n in counts:
        if matches == max_matches or files == max_files:
            page, matches, files = page + 1, 0, 0
        head = min(n, max_per_file, max_matches - matches)
        yield page, rel, 0, head
        matches, files = matches + head, files + 1
        rest = n - head if head < max_per_file else 0
        more = min(1, rest) if alone == max_per_file else -(-rest // alone)
        for k in range(more):
            matches, files = min(alone, rest - k * alone), 1
            yield page + 1 + k, rel, head + k * alone, matches
        page += more


def assign_pages(counts: Iterable[tuple[str, int]], page: int, max_matches: int, max_files: int, max_per_file: int) -> dict[str, tuple[int, int]]:
    """rel -> (first match, matches) on one page."""
    out = {}
    for at, rel, first, take in page_rows(counts, max_matches, max_files, max_per_file):
        if at > page:
            break
        if at == page:
            out[rel] = (first, take)
    return out


FARTHEST = 1_000_000  # files up to the end of a page, whose counts go through the driver


def grep_page(files: DataFrame, ws: str, m: match.Matcher, page: int = 1, max_matches: int = 200, max_files: int = 50, max_per_file: int = 50) -> Page:
    """A page of one workspace. Totals are exact and aggregated in the cluster; the driver sees only the counts of the
    first ``page * max_files`` matching files, which is all a page can depend on, and refuses a page too far on."""
    if page * max_files > FARTHEST:
        raise ValueError(f"page {page} lies beyond {FARTHEST} files")
    hits = materialise(matching_lines(files.where(F.col("ws") == ws), m), "hits")  # read for totals, counts and rows
    counts = hits.groupBy("rel").agg(F.count("*").alias("n"))
    t = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("f")).first()
    # a page past the per-file cap may leave files behind, so that a page never needs more files than this
    first = [(r["rel"], r["n"]) for r in counts.orderBy("rel").limit(page * max_files + 1).collect()]
    window = assign_pages(first, page, max_matches, max_files, max_per_file)
    more = bool(assign_pages(first, page + 1, max_matches, max_files, max_per_file))
    spark = files.sparkSession
    rows = spark.createDataFrame([(r, a, n) for r, (a, n) in window.items()], "rel string, first int, take int")
    n = F.row_number().over(Window.partitionBy("rel").orderBy("ln")) - 1
    shown = hits.join(F.broadcast(rows), "rel").withColumn("n", n).where((F.col("n") >= F.col("first")) & (F.col("n") < F.col("first") + F.col("take")))  # at most max_files rows
    return Page(shown.select("rel", "ln", "col", text.clip_line(F.col("line"), F.col("col")).alias("text"), "n"), t["n"], t["f"], page, page + 1 if more else None)


def owners(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds to (ws, rel, ln, ...) the innermost symbol around each line, the earlier of equal ones; null at top level.

    An equi join on the file with the span as residual condition, then one aggregate by line.
    """
    s = symbols.select(F.col("ws").alias("_w"), F.col("file").alias("_f"), "name", "path", "line_start", "line_end", "ord")
    cond = (F.col("ws") == F.col("_w")) & (F.col("rel") == F.col("_f")) & F.col("ln").between(F.col("line_start"), F.col("line_end"))
    keys = lines.columns
    span = F.struct((F.col("line_end") - F.col("line_start")).alias("span"), F.col("line_start"), F.col("ord"), F.col("path"), F.col("name"))
    j = lines.join(s, cond, "left").groupBy(*keys).agg(F.min(F.when(F.col("path").isNotNull(), span)).alias("_o"))
    return j.select(*keys, F.col("_o.path").alias("owner"), F.col("_o.name").alias("owner_name"), F.col("_o.line_start").alias("owner_line"))


def references(files: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Lines that hold a name, as written, with owner, label and call flag; its own declaration lines are left out.

    ``local``: the file defines the name; ``imported``: an import statement of the file names it; else ``textual``.
    """
    hits = matching_lines(files, match.compile_matcher(name, case=True)).select("ws", "rel", "ln", "line")
    own = symbols.where(F.col("name") == name)
    declared = own.select("ws", F.col("file").alias("rel"), F.col("line_start").alias("ln")).distinct()
    hits = hits.join(declared, ["ws", "rel", "ln"], "left_anti")
    defines = own.select("ws", F.col("file").alias("rel")).distinct().withColumn("local", F.lit(True))
    word = rf"(?<![\w$]){re.escape(name)}(?![\w$])"
    imports = text.with_lines(candidates(files, match.compile_matcher(name, case=True))).where(F.col("line").rlike(r"^\s*(?:import|from|use)\b|^\s*export\b.*\bfrom\b") & F.col("line").rlike(word))
    imports = imports.select("ws", "rel").distinct().withColumn("imported", F.lit(True))
    o = owners(hits, symbols.select("ws", "file", "name", "path", "line_start", "line_end", "ord").distinct())
    o = o.join(defines, ["ws", "rel"], "left").join(imports, ["ws", "rel"], "left")
    label = F.when(F.col("local"), "local").when(F.col("imported"), "imported").otherwise("textual")
    return o.select("ws", "rel", "ln", F.coalesce("owner", F.lit("(top level)")).alias("owner"), label.alias("label"), F.col("line").rlike(rf"{word}\s*\(").alias("call"), F.substring(F.trim("line"), 1, 160).alias("text"))


# -- queries


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files")


def grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    hits = matching_lines(_files(spark, sf), match.compile_matcher("PASSWORD"))
    return hits.select("ws", "rel", "ln", "col", text.clip_line(F.col("line"), F.col("col")).alias("text"))


def grep_regex(spark: SparkSession, sf: str) -> DataFrame:
    return matching_lines(_files(spark, sf), match.compile_matcher(r"log\(.(dense|cold) \w+:", regex=True, case=True)).select("ws", "rel", "ln", "line")


def grep_smart_case(spark: SparkSession, sf: str) -> DataFrame:
    a = matching_lines(_files(spark, sf), match.compile_matcher("Tracer", case="smart")).withColumn("q", F.lit("Tracer"))
    b = matching_lines(_files(spark, sf), match.compile_matcher("copyright", case="smart")).withColumn("q", F.lit("copyright"))
    return a.unionByName(b).groupBy("q", "ws").agg(F.count("*").alias("lines"), F.countDistinct("rel").alias("files"))


def grep_files(spark: SparkSession, sf: str) -> DataFrame:
    return matching_lines(_files(spark, sf), match.compile_matcher("trellis")).groupBy("ws", "rel").agg(F.count("*").alias("count"), F.min("ln").alias("first"))


def grep_matches(spark: SparkSession, sf: str) -> DataFrame:
    return tally(_files(spark, sf), match.compile_matcher(r"[A-Za-z]+_[A-Za-z]+\(", regex=True, case=True))


def grep_context(spark: SparkSession, sf: str) -> DataFrame:
    c = with_context(_files(spark, sf), match.compile_matcher("<<<<<<<", case=True), 2, 1)
    return c.select("ws", "rel", "ln", "line", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


def grep_glob(spark: SparkSession, sf: str) -> DataFrame:
    where = paths.PathMatcher(include=("*.py", "*.rs"), exclude=("test",))
    return matching_lines(_files(spark, sf), match.compile_matcher("import"), where).groupBy("ws").agg(F.count("*").alias("lines"), F.countDistinct("rel").alias("files"))


def grep_stream_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where each file's matches begin in the answer of its workspace, in path order."""
    per = matching_lines(_files(spark, sf), match.compile_matcher("late")).groupBy("ws", "rel").agg(F.count("*").alias("count"))
    return ordered.before(per, ["ws"], ["rel"], F.col("count"), "start")


def mentions_first(spark: SparkSession, sf: str) -> DataFrame:
    hits = matching_lines(_files(spark, sf), match.compile_matcher("lantern"))
    return hits.groupBy("ws", "rel").agg(F.min("ln").alias("ln"), F.substring(F.trim(F.min_by("line", "ln")), 1, 160).alias("text"))


def refs_owner(spark: SparkSession, sf: str) -> DataFrame:
    return references(_files(spark, sf), table(spark, sf, "symbols"), "collect")


def grep_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Grep over the documents of all sources."""
    m = match.compile_matcher("cache")
    d = table(spark, sf, "documents").where(m.test(F.col("text"))).select("doc_id", "text")
    return text.with_lines(d, "text").where(m.test(F.col("line"))).select("doc_id", "ln", m.column(F.col("line")).alias("col"), "line")


QUERIES = {
    f.__name__: f
    for f in (grep_lines, grep_regex, grep_smart_case, grep_files, grep_matches, grep_context, grep_glob, grep_stream_positions, mentions_first, refs_owner, grep_documents)
}

_L = corpus.LINES_SQL
_CLIP = "CASE WHEN len(line) > 300 THEN CASE WHEN greatest(1, col - 80) > 1 THEN '…' ELSE '' END || substring(line, greatest(1, col - 80), 300) || CASE WHEN greatest(1, col - 80) + 300 <= len(line) THEN '…' ELSE '' END ELSE line END"
ORACLE = {
    "grep_lines": f"WITH {_L}, H AS (SELECT ws, rel, ln, line, CAST(instr(lower(line), 'password') AS INTEGER) AS col FROM L WHERE contains(lower(line), 'password')) SELECT ws, rel, ln, col, {_CLIP} AS text FROM H",
    "grep_regex": f"WITH {_L} SELECT ws, rel, ln, line FROM L WHERE regexp_matches(line, 'log\\(.(dense|cold) \\w+:')",
    "grep_smart_case": f"""WITH {_L} SELECT 'Tracer' AS q, ws, count(*) AS lines, count(DISTINCT rel) AS files FROM L WHERE contains(line, 'Tracer') GROUP BY ws
 UNION ALL SELECT 'copyright', ws, count(*), count(DISTINCT rel) FROM L WHERE contains(lower(line), 'copyright') GROUP BY ws""",
    "grep_files": f"WITH {_L} SELECT ws, rel, count(*) AS count, min(ln) AS first FROM L WHERE contains(lower(line), 'trellis') GROUP BY ws, rel",
    "grep_matches": f"""WITH {_L}, M AS (SELECT ws, rel, ln, unnest(regexp_extract_all(line, '[A-Za-z]+_[A-Za-z]+\\(')) AS text FROM L)
 SELECT text, count(*) AS count, count(DISTINCT (ws, rel, ln)) AS lines, count(DISTINCT (ws, rel)) AS files FROM M GROUP BY text""",
    "grep_context": f"""WITH {_L}, W AS (SELECT ws, rel, ln, line, lag(line, 1) OVER w AS b1, lag(line, 2) OVER w AS b2, lead(line, 1) OVER w AS a1 FROM L WINDOW w AS (PARTITION BY ws, rel ORDER BY ln))
 SELECT ws, rel, ln, line, concat_ws('|', b2, b1) AS before, coalesce(a1, '') AS after FROM W WHERE contains(line, '<<<<<<<')""",
    "grep_glob": f"WITH {_L} SELECT ws, count(*) AS lines, count(DISTINCT rel) AS files FROM L WHERE regexp_matches(rel, '\\.(py|rs)$') AND NOT regexp_matches(rel, '(^|/)test(/|$)') AND contains(lower(line), 'import') GROUP BY ws",
    "grep_stream_positions": f"""WITH {_L}, P AS (SELECT ws, rel, count(*) AS count FROM L WHERE contains(lower(line), 'late') GROUP BY ws, rel)
 SELECT ws, rel, count, CAST(coalesce(sum(count) OVER (PARTITION BY ws ORDER BY rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM P""",
    "mentions_first": f"""WITH {_L}, M AS (SELECT ws, rel, min(ln) AS ln FROM L WHERE contains(lower(line), 'lantern') GROUP BY ws, rel)
 SELECT M.ws, M.rel, M.ln, left(trim(L.line, ' '), 160) AS text FROM M JOIN L ON L.ws = M.ws AND L.rel = M.rel AND L.ln = M.ln""",
    "refs_owner": f"""WITH {_L}, S AS (SELECT DISTINCT ws, file, name, path, line_start, line_end, ord FROM symbols),
 H AS (SELECT ws, rel, ln, line FROM L WHERE contains(line, 'collect') AND NOT EXISTS (SELECT 1 FROM S WHERE S.ws = L.ws AND S.file = L.rel AND S.name = 'collect' AND S.line_start = L.ln)),
 O AS (SELECT H.ws, H.rel, H.ln, H.line, min({{'span': line_end - line_start, 'line_start': line_start, 'ord': ord, 'path': path}}) AS o FROM H LEFT JOIN S ON S.ws = H.ws AND S.file = H.rel AND H.ln BETWEEN line_start AND line_end GROUP BY ALL),
 I AS (SELECT DISTINCT ws, rel FROM L WHERE regexp_matches(line, '^\\s*(import|from|use)\\b|^\\s*export\\b.*\\bfrom\\b') AND regexp_matches(line, '(^|[^\\w$])collect([^\\w$]|$)'))
 SELECT O.ws, O.rel, O.ln, coalesce(O.o.path, '(top level)') AS owner, CASE WHEN EXISTS (SELECT 1 FROM S WHERE S.ws = O.ws AND S.file = O.rel AND S.name = 'collect') THEN 'local' WHEN I.rel IS NOT NULL THEN 'imported' ELSE 'textual' END AS label,
 regexp_matches(O.line, '(^|[^\\w$])collect\\s*\\(') AS call, left(trim(O.line, ' '), 160) AS text FROM O LEFT JOIN I ON I.ws = O.ws AND I.rel = O.rel""",
    "grep_documents": """WITH D AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, -1) ELSE text END, chr(10)) AS a FROM documents WHERE len(text) > 0),
 U AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS ln FROM D), L AS (SELECT doc_id, CAST(ln AS INTEGER) AS ln, CASE WHEN raw LIKE '%' || chr(13) THEN left(raw, -1) ELSE raw END AS line FROM U)
 SELECT doc_id, ln, CAST(instr(lower(line), 'cache') AS INTEGER) AS col, line FROM L WHERE contains(lower(line), 'cache')""",
}
