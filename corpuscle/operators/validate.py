"""Validation: syntax diagnostics by the checkers of ``corpuscle.syntax`` (bracket balance for languages without one), template tag balance, colour literals, and comparison with a baseline."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.text import Offsets
from ..session import spread, table
from ..syntax import LANGUAGES, syntax_errors
from . import corpus

DIAGNOSTICS = "ws string, rel string, source string, code string, severity string, message string, start int, `end` int, line int, col int"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.){1,10}\'|`[^`]*+`', re.S)
_PAIR = {")": "(", "]": "[", "}": "{"}


def balance(source: str) -> list[tuple[str, str, int, int]]:
    """(code, message, start, end) of brackets that do not match, outside strings and comments."""
    bare = _SKIP.sub(lambda m: " " * len(m[0]), source)
    stack, out = [], []
    for m in re.finditer(r"[()\[\]{}]", bare):
        c = m[0]
        if c in "([{":
            stack.append((c, m.start()))
        elif stack and stack[-1][0] == _PAIR[c]:
            stack.pop()
        else:
            out.append(("bracket", f"unmatched {c}", m.start(), m.end()))
    return out + [("bracket", f"{c} is never closed", a, a + 1) for c, a in stack]


def template_balance(source: str) -> list[tuple[str, str, int, int]]:
    """HTML tags in template literals that are closed in the wrong order, or opened and never closed.

    Substitutions count as text; void elements, self-closed tags and templates that hold only one side are no case.
    """
    out = []
    for lit in re.finditer(r"`((?:[^`\\]|\\.)*+)`", _no_comments(source), re.S):
        body = re.sub(r"\$\{(?:[^{}]|\{[^{}]*\})*\}", lambda m: " " * len(m[0]), lit[1])
        tags = list(re.finditer(r"<(/?)([A-Za-z][\w-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>", body))
        if not any(t[1] for t in tags) or not any(not t[1] for t in tags):
            continue
        stack = []
        for t in tags:
            name, at = t[2].lower(), lit.start(1) + t.start()
            if name in VOID or t[3].rstrip().endswith("/"):
                continue
            if not t[1]:
                stack.append((name, at, at + len(t[0])))
            elif stack and stack[-1][0] == name:
                stack.pop()
            else:
                out.append(("template", f"</{name}> closes nothing that is open", at, at + len(t[0])))
        out += [("template", f"<{n}> is never closed", a, b) for n, a, b in stack]
    return out


def _no_comments(source: str) -> str:
    return re.sub(r"(\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)|//[^\n]*|/\*.*?\*/", lambda m: m[0] if m[1] else re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def diagnose(rel: str, source: str) -> list[tuple]:
    """(source, code, severity, message, start, end, line, column) of a text."""
    ext = (re.search(r"(\.[^./\\]+)$", rel) or [""])[0].lower()
    lang = paths.LANG_OF_EXT.get(ext, "other")
    at = Offsets(source)
    rows: list[tuple[str, str, str, int, int]] = []
    if lang in LANGUAGES and not (lang == "json" and ext != ".json"):
        for line, cause in syntax_errors(lang, source):
            a = at.offset(line, 1)
            rows.append(("syntax", "syntax", cause, a, min(len(source), a + 1)))
        if lang in ("javascript", "typescript"):
            rows += [("template", *r) for r in template_balance(source)]
    elif lang in ("c", "cpp", "csharp", "php"):
        rows += [("balance", *r) for r in balance(source)]
    return [(src, code, "error", message, a, b, *at.line_col(min(a, len(source)))) for src, code, message, a, b in rows]


def diagnostics(files: DataFrame) -> DataFrame:
    names = [c.strip().split(" ")[0].strip("`") for c in DIAGNOSTICS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(ws, rel, *d) for ws, rel, source in pdf.itertuples(index=False) for d in diagnose(rel, source)]
            yield pd.DataFrame(rows, columns=names)

    return spread(corpus.content(files)).mapInPandas(run, DIAGNOSTICS).distinct()


def compare_diagnostics(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference by key: how many are new, resolved and remaining."""
    a = baseline.groupBy(*keys).agg(F.count("*").alias("a"))
    b = candidate.groupBy(*keys).agg(F.count("*").alias("b"))
    j = a.join(b, keys, "full_outer").select(*keys, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return j.select(*keys, F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("new"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("resolved"), F.least("a", "b").alias("remaining"))


# -- colours


def rgb(c: Column) -> Column:
    """Struct r, g, b of a hexadecimal literal of 3, 4, 6 or 8 digits or of rgb(), null for anything else."""
    h = F.regexp_extract(F.lower(c), r"^#([0-9a-f]{3,8})$", 1)
    n = F.length(h)
    short = lambda i: F.conv(F.concat(F.substring(h, i, 1), F.substring(h, i, 1)), 16, 10).cast("int")
    long = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    f = lambda i: F.regexp_extract(F.lower(c), r"^rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\b", i)
    dec = lambda i: F.try_to_number(f(i), F.lit("999")).cast("int")
    made = lambda a, b, d: F.struct(a.alias("r"), b.alias("g"), d.alias("b"))
    return F.when(n.isin(3, 4), made(short(1), short(2), short(3))).when(n.isin(6, 8), made(long(1), long(3), long(5))).when(f(1) != "", made(dec(1), dec(2), dec(3)))


def rgb_of(value: str | None) -> tuple[int, int, int] | None:
    """The same for a single string."""
    v = (value or "").lower()
    if re.fullmatch(r"#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", v):
        h = "".join(c * 2 for c in v[1:]) if len(v) < 6 else v[1:]
        return int(h[:2], 16), int(h[2:4], 16), int(h[4:6], 16)
    m = re.match(r"rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\b", v)
    return (int(m[1]), int(m[2]), int(m[3])) if m else None


def nearest_colour(literals: DataFrame, palette: DataFrame, cutoff: int = 3 * 64 * 64) -> DataFrame:
    """For each (literal) the palette entry at the least squared distance, if within the cutoff; ties by name.

    The palette is a list of design variables: at most 1,000 entries, kept as one array in the expression.
    """
    from ..session import bounded_rows

    rows = sorted((r["name"], c) for r in bounded_rows(palette.select("name", "value"), 1000, "palette") if (c := rgb_of(r["value"])))
    if not rows:
        return literals.select(*literals.columns, F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("distance")).limit(0)
    entry = F.array(*[F.struct(F.lit(name).alias("name"), *[F.lit(v).alias(i) for i, v in zip("rgb", c)]) for name, c in rows])
    sq = lambda a, b: (a - b) * (a - b)

    def best(c: Column) -> Column:
        scored = F.transform(entry, lambda p: F.struct((sq(p["r"], c["r"]) + sq(p["g"], c["g"]) + sq(p["b"], c["b"])).alias("d"), p["name"].alias("name")))
        return F.array_min(scored)

    # bound as a lambda variable, the parsed colour is computed once and not once an entry
    found = literals.select(*literals.columns, F.inline(F.transform(F.array(rgb(F.col("literal"))), lambda c: F.when(c.isNotNull(), best(c)))))
    return found.select(*literals.columns, "name", F.col("d").alias("distance")).where(F.col("distance") <= cutoff)


# -- queries


def file_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    d = diagnostics(table(spark, sf, "files"))
    return d.groupBy("ws", "source", "code").agg(F.count("*").alias("n"), F.countDistinct("rel").alias("files"))


def json_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """JSON files with a syntax diagnostic."""
    d = diagnostics(table(spark, sf, "files").where("lower(rel) LIKE '%.json'"))
    return d.where("source = 'syntax'").select("ws", "rel").distinct()


def template_tags(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics(table(spark, sf, "files").where("rel LIKE '%.js' OR rel LIKE '%.ts' OR rel LIKE '%.mjs'")).where("source = 'template'").select("ws", "rel", "line", "message")


def diag_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons stored by two analyser versions as baseline and candidate."""
    f = table(spark, sf, "files").where("reason IS NOT NULL").select("ws", "rel", "analyzer_version", F.regexp_replace("reason", r"\d+", "0").alias("cause")).distinct()
    return compare_diagnostics(f.where("analyzer_version = 'a:2'"), f.where("analyzer_version = 'a:3'"), ["ws", "cause"])


def color_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a colour of its first six hash digits against a palette of ten."""
    lit = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6)).alias("literal"))
    names = "black #000000 white #ffffff red #ff0000 lime #00ff00 blue #0000ff yellow #ffff00 cyan #0ff magenta #f0f gray #808080 navy #000080".split()
    palette = spark.createDataFrame(list(zip(names[::2], names[1::2])), "name string, value string")
    return nearest_colour(lit, palette)


def eol_normal(spark: SparkSession, sf: str) -> DataFrame:
    """Contents with their dominant line end throughout, as digests."""
    f = table(spark, sf, "files").where("content IS NOT NULL").select("ws", "rel", "content")
    return f.select("ws", "rel", F.md5(text.normalise_eol(F.col("content"), text.dominant_eol(F.col("content")))).alias("md5")).distinct()


QUERIES = {f.__name__: f for f in (file_diagnostics, json_diagnostics, template_tags, diag_compare, color_nearest, eol_normal)}
ORACLE = {
    # json_valid lets a comma at the end pass
    "json_diagnostics": f'''WITH {corpus.SEARCHABLE_SQL} SELECT DISTINCT ws, rel FROM C WHERE lower(rel) LIKE '%.json' AND (NOT json_valid(content)
 OR regexp_matches(regexp_replace(content, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), ',\\s*[}}\\]]'))''',
    "diag_compare": """WITH f AS (SELECT DISTINCT ws, rel, analyzer_version AS v, regexp_replace(reason, '\\d+', '0', 'g') AS cause FROM files WHERE reason IS NOT NULL),
 g AS (SELECT ws, cause, count(*) FILTER (v = 'a:2') AS a, count(*) FILTER (v = 'a:3') AS b FROM f WHERE v IN ('a:2', 'a:3') GROUP BY ws, cause)
 SELECT ws, cause, greatest(b - a, 0) AS new, greatest(a - b, 0) AS resolved, least(a, b) AS remaining FROM g""",
    "color_nearest": """WITH p(name, r, g, b) AS (VALUES ('black',0,0,0),('white',255,255,255),('red',255,0,0),('lime',0,255,0),('blue',0,0,255),('yellow',255,255,0),('cyan',0,255,255),('magenta',255,0,255),('gray',128,128,128),('navy',0,0,128)),
 l AS (SELECT p_partkey, '#' || left(md5(CAST(p_partkey AS VARCHAR)), 6) AS literal FROM part), x AS (SELECT *, CAST('0x' || literal[2:3] AS INTEGER) AS lr, CAST('0x' || literal[4:5] AS INTEGER) AS lg, CAST('0x' || literal[6:7] AS INTEGER) AS lb FROM l),
 d AS (SELECT p_partkey, literal, name, (r-lr)*(r-lr) + (g-lg)*(g-lg) + (b-lb)*(b-lb) AS distance FROM x, p QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY distance, name) = 1)
 SELECT p_partkey, literal, name, distance FROM d WHERE distance <= 12288""",
    "eol_normal": """WITH a AS (SELECT DISTINCT ws, rel, content, replace(content, chr(13) || chr(10), chr(10)) AS lf, (len(content) - len(replace(content, chr(13) || chr(10), ''))) // 2 AS n,
 len(content) - len(replace(content, chr(10), '')) AS k FROM files WHERE content IS NOT NULL)
 SELECT DISTINCT ws, rel, md5(CASE WHEN n * 2 > k THEN replace(lf, chr(10), chr(13) || chr(10)) ELSE lf END) AS md5 FROM a""",
}
