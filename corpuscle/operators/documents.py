"""Documents as titled regions, and texts as chunks: Arrow maps per file, as both are sequential within a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..session import spread, table
from . import corpus, grep

# fixed values: extensions of code, which has symbols instead of regions
CODE_EXT = ".js .mjs .cjs .jsx .ts .tsx .css .scss .sh .bash .ps1 .sql".split()
MAX_LINES, RUN, CHUNK, CHUNK_MAX = 80, 200, 1400, 2600


def _title(s: str, most: int = 120) -> str:
    return " ".join(re.sub(r"<[^>]*>", "", s).split())[:most] if "<" in s and ">" in s and re.match(r"\s*<h", s, re.I) else " ".join(s.split())[:most]


def _ext(rel: str) -> str:
    m = re.search(r"(\.[^./\\]+)$", rel)
    return m[1].lower() if m else ""


def _nested(heads: list[tuple[int, int, str]], last: int, first_line: int = 1) -> list[tuple]:
    """Headings (line, level, title) with their extent: up to the next of the same or a higher level."""
    out = []
    for i, (line, level, title) in enumerate(heads):
        end = next((h[0] - 1 for h in heads[i + 1 :] if h[1] <= level), last)
        out.append(("heading", title, level, line, end))
    return out


def _trim(lines: list[str], a: int, b: int) -> tuple[int, int]:
    """Line range without blank lines at both ends."""
    while b > a and not lines[b - 1].strip():
        b -= 1
    while a < b and not lines[a - 1].strip():
        a += 1
    return a, b


def markdown(lines: list[str]) -> list[tuple]:
    heads, fence = [], None
    for n, line in enumerate(lines, 1):
        m = re.match(r"^ {0,3}(`{3,}|~{3,})", line)
        if m:
            fence = None if fence and m[1][0] == fence else fence or m[1][0]
            continue
        h = None if fence else re.match(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", line)
        if h:
            heads.append((n, len(h[1]), _title(h[2])))
    if not heads:
        return []
    out = []
    if heads[0][0] > 1:
        a, b = _trim(lines, 1, heads[0][0] - 1)
        if lines[a - 1].strip():
            out.append(("section", _title(lines[a - 1]), 0, a, b))
    return out + [(k, t, lv, a, _trim(lines, a, b)[1]) for k, t, lv, a, b in _nested(heads, len(lines))]


def html(text: str, lines: list[str]) -> list[tuple]:
    heads = [(text.count("\n", 0, m.start()) + 1, int(m[1]), " ".join(re.sub(r"<[^>]*>", "", m[2]).split())) for m in re.finditer(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", text)]
    if not heads:
        return []
    out = []
    if heads[0][0] > 1:
        a, b = _trim(lines, 1, heads[0][0] - 1)
        if lines[a - 1].strip():
            out.append(("section", " ".join(lines[a - 1].split())[:120], 0, a, b))
    return out + _nested(heads, len(lines))


def json_members(text: str) -> list[tuple]:
    """Members of the outer object, or groups of the elements of the outer array, by line; at least two on different lines."""
    tokens = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')
    depth, items, start, key, last, at = 0, [], None, None, None, 0
    kind = ""
    line, pos = 1, 0
    for m in tokens.finditer(text):
        line += text.count("\n", pos, m.start())
        pos = m.start()
        t = m[0]
        if t in "{[":
            if depth == 1 and start is None:
                start = line
            depth += 1
            if depth == 1:
                kind = t
                continue
        elif t in "}]":
            depth -= 1
            if depth == 0:
                if start is not None:
                    items.append((key if kind == "{" else f"[{at}]", start, last))
                break
        elif depth == 1 and t == ",":
            items.append((key if kind == "{" else f"[{at}]", start or line, last or line))
            start, key, at = None, None, at + 1
            continue
        elif depth == 1 and start is None:
            start = line
            if kind == "{":
                key = t[1:-1]
        last = line + t.count("\n")
    if len(items) < 2 or len({s for _, s, _ in items}) < 2:
        return []
    if kind == "{":
        return [("member", k or "", 1, a, b) for k, a, b in items]
    out = []
    for name, a, b in items:
        if out and b - out[-1][3] < MAX_LINES:
            out[-1] = ("member", f"{out[-1][1].split('–')[0]}–{name}", 1, out[-1][3], b)
        else:
            out.append(("member", name, 1, a, b))
    return out


def plain(lines: list[str], max_lines: int) -> list[tuple]:
    """Paragraphs merged up to ``max_lines``; a long one without blank lines is cut every 200 lines."""
    blocks, a = [], None
    for n, line in enumerate([*lines, ""], 1):
        if line.strip():
            a = a or n
        elif a:
            blocks.append((a, n - 1))
            a = None
    out: list[tuple] = []
    for a, b in blocks:
        if b - a + 1 > RUN:
            out += [("lines", _title(lines[k - 1]), 0, k, min(b, k + RUN - 1)) for k in range(a, b + 1, RUN)]
        elif out and out[-1][0] == "paragraph" and b - out[-1][3] + 1 <= max_lines:
            out[-1] = (*out[-1][:4], b)
        else:
            out.append(("paragraph", _title(lines[a - 1]), 0, a, b))
    return out


def regions(rel: str, text: str, max_lines: int = MAX_LINES) -> list[tuple] | None:
    """(kind, title, level, line_start, line_end) of a document; None for code, [] for a blank text."""
    ext = _ext(rel)
    if ext in CODE_EXT:
        return None
    text = text.replace("\r\n", "\n")
    if not text.strip():
        return []
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    found: list[tuple] = []
    if ext in (".md", ".markdown"):
        found = markdown(lines)
    elif ext in (".html", ".htm"):
        found = html(text, lines)
    elif ext in (".json", ".jsonc"):
        found = json_members(text)
    if not found and text.count("\f"):
        cuts, n = [1], 1
        for n, line in enumerate(lines, 1):
            if line.startswith("\f") and n > 1:
                cuts.append(n)
        if len(cuts) > 1:
            found = [("page", f"page {i + 1}", 0, a, (cuts[i + 1] - 1 if i + 1 < len(cuts) else len(lines))) for i, a in enumerate(cuts)]
    return found or plain(lines, max_lines)


def section_of(found: list[tuple], title: str) -> list[tuple]:
    """Regions of a title: exact ones, else those equal but for case; leading marks of a heading do not count."""
    want = re.sub(r"^#+\s*", "", title).strip()
    exact = [r for r in found if r[1] == want]
    return exact or [r for r in found if r[1].lower() == want.lower()]


REGIONS = "ws string, rel string, ord int, kind string, title string, level int, line_start int, line_end int"


def region_rows(files: DataFrame) -> DataFrame:
    """Regions of every searchable file that is no code."""
    from ..session import ext_of

    todo = corpus.content(files).where(~ext_of(F.col("rel")).isin(CODE_EXT))
    names = [c.strip().split(" ")[0] for c in REGIONS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(ws, rel, i, *r) for ws, rel, text in pdf.itertuples(index=False) for i, r in enumerate(regions(rel, text) or [])]
            yield pd.DataFrame(rows, columns=names)

    return todo.mapInPandas(run, REGIONS).distinct()


# -- chunks


def chunks(rel: str, text: str, target: int = CHUNK, most: int = CHUNK_MAX) -> list[tuple[int, int]]:
    """Spans that cover a text exactly once: greedy from boundary to boundary up to ``target``, none above ``most``.

    Boundaries are lines that begin a declaration, a heading, a member or a paragraph.
    """
    ext = _ext(rel)
    if not text:
        return []
    if ext in (".md", ".markdown"):
        pattern = r"^#{1,6}[ \t]|^(?=\S)(?<=\n\n)"
    elif ext in (".json", ".jsonc"):
        pattern = r"^[ \t]{0,4}\""
    elif ext in (".html", ".htm"):
        pattern = r"^[ \t]*<(?:h[1-6]|section|article|div|script|style|table|ul|p)\b"
    elif ext in (".txt", ".yml", ".yaml", ".ini", ".toml", ".csv", ".sh"):
        pattern = r"^(?=\S)(?<=\n\n)|^\[|^[\w-]+:"
    else:
        pattern = r"^(?:[ \t]{0,4})(?:export|import|async|function|class|const|let|var|def|func|fn|pub|impl|struct|enum|trait|interface|type|public|private|protected|static|package|use|mod|@|#\[|///|/\*\*)"
    cuts = [m.start() for m in re.finditer(pattern, text, re.M)]
    cuts = sorted({0, len(text), *cuts})
    out, start = [], 0
    for i in range(1, len(cuts)):
        nxt = cuts[i]
        while nxt - start > most:
            cut = text.rfind("\n", start + 1, start + most)
            cut = cut + 1 if cut > start else start + most
            prev = max((c for c in cuts[:i] if start < c), default=0)
            cut = prev if prev > start else cut
            out.append((start, cut))
            start = cut
        follow = cuts[i + 1] if i + 1 < len(cuts) else None
        if follow is None or follow - start > target:
            if nxt > start:
                out.append((start, nxt))
                start = nxt
    return out


CHUNKS = "ws string, rel string, i int, start int, `end` int, line_start int, text string"


def chunk_rows(files: DataFrame) -> DataFrame:
    """Chunks of every searchable file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ws, rel, text in pdf.itertuples(index=False):
                for i, (a, b) in enumerate(chunks(rel, text)):
                    skip = re.match(r"(?:[ \t\r]*\n)*", text[a : min(b, a + 400)]).end()
                    rows.append((ws, rel, i, a, b, text.count("\n", 0, a + skip) + 1, text[a:b]))
            yield pd.DataFrame(rows, columns=["ws", "rel", "i", "start", "end", "line_start", "text"])

    return spread(corpus.content(files)).mapInPandas(run, CHUNKS).dropDuplicates(["ws", "rel", "i"])


def headed(chunk: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks under a head that names their file and innermost symbol, as they are embedded."""
    keys = chunk.select("ws", "rel", "i", F.col("line_start").alias("ln"))
    s = symbols.select("ws", "file", "name", "path", "line_start", "line_end", "ord").distinct()
    own = grep.owners(keys, s).select("ws", "rel", "i", "owner")
    doc = symbols.groupBy("ws", F.col("file").alias("rel"), F.col("path").alias("owner")).agg(F.min("doc").alias("doc"))
    j = chunk.join(own, ["ws", "rel", "i"], "left").join(doc, ["ws", "rel", "owner"], "left")
    head = F.concat_ws("\n", F.concat(F.lit("// "), F.concat_ws(" › ", "rel", "owner")), F.when(F.length("doc") > 0, F.concat(F.lit("// "), F.substring(F.regexp_replace("doc", r"\s+", " "), 1, 200))), F.lit(""), F.col("text"))
    return j.select("ws", "rel", "i", "owner", head.alias("text"))


def prepare_text(rel: Column, content: Column, indexed: Column) -> Column:
    """What is embedded of a file: under its name, only if indexed and of 120 characters or more."""
    return F.when(F.coalesce(indexed, F.lit(True)) & (F.length(content) >= 120), F.concat(F.lit("//@ "), rel, F.lit("\n"), content))


# -- queries


def doc_regions(spark: SparkSession, sf: str) -> DataFrame:
    return region_rows(table(spark, sf, "files"))


def region_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that occur more than once in a file can not be addressed by title."""
    r = region_rows(table(spark, sf, "files"))
    return r.groupBy("ws", "rel", "title").agg(F.count("*").alias("n")).groupBy("ws", "rel").agg(F.count("*").alias("titles"), F.count_if(F.col("n") > 1).alias("ambiguous"))


def chunks_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Each text is covered exactly once by its chunks, none of which is too long."""
    c = chunk_rows(table(spark, sf, "files"))
    return c.groupBy("ws", "rel").agg(F.sum(F.length("text")).alias("n_chars"), F.max("end").cast("bigint").alias("last"), (F.max(F.length("text")) <= CHUNK_MAX).alias("within"))


def headed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    h = headed(chunk_rows(table(spark, sf, "files")), table(spark, sf, "symbols"))
    return h.select("ws", "rel", "i", "owner", F.md5("text").alias("text_md5"))


def prepared_files(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files").where("content IS NOT NULL")
    p = f.where(~paths.is_secret(F.col("rel"))).select("ws", "rel", prepare_text(F.col("rel"), F.col("content"), F.col("indexed")).alias("t"))
    return p.where("t IS NOT NULL").select("ws", "rel", F.length("t").alias("n_chars"), F.md5("t").alias("md5")).distinct()


QUERIES = {f.__name__: f for f in (doc_regions, region_titles, chunks_cover, headed_chunks, prepared_files)}
ORACLE = {
    "chunks_cover": f"WITH {corpus.SEARCHABLE_SQL} SELECT ws, rel, CAST(len(content) AS BIGINT) AS n_chars, CAST(len(content) AS BIGINT) AS last, true AS within FROM C WHERE len(content) > 0",
    "prepared_files": f"""SELECT DISTINCT ws, rel, CAST(len('//@ ' || rel || chr(10) || content) AS INTEGER) AS n_chars, md5('//@ ' || rel || chr(10) || content) AS md5 FROM files
 WHERE content IS NOT NULL AND NOT {corpus.SECRET_SQL} AND coalesce(indexed, true) AND len(content) >= 120""",
}
