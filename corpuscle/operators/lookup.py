"""Addressing and reading: resolve a name to a symbol or file, read a symbol, a file or a range, outline a file, list packages."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..session import bounded_rows, table
from . import corpus, documents

# fixed values: how many rows a verb shows unless it is told otherwise
LIMITS = {"find": 20, "ask": 12, "mentions": 5, "refs": 40, "importers": 40, "outline": 80, "grep": 200, "grep_files": 50, "read_file": 600}
UNLIMITED_AT_ZERO = {"files", "symbols", "glob"}


def limit_of(verb: str, given) -> int | None:
    """None (all) or a number. Not given: the verb's default. 0 and what is no number: all for listings, the default for
    references and the like, an empty page for ranked answers."""
    if given is None:
        return LIMITS.get(verb)
    try:
        n = max(0, int(given))
    except (TypeError, ValueError):
        n = 0
    if n:
        return n
    if verb in UNLIMITED_AT_ZERO:
        return None
    return LIMITS[verb] if verb in ("refs", "mentions", "importers") else 0


@dataclass
class Page:
    """Rows of a page with the exact total, whether more follow, and where the next page begins."""

    rows: list
    total: int
    offset: int = 0
    truncated: bool = False
    next: int | None = None
    extra: dict = field(default_factory=dict)


def page(df: DataFrame, limit: int | None, offset: int = 0) -> Page:
    """A page of an ordered DataFrame. The total is counted in the cluster; only the page comes to the driver."""
    total = df.count()
    rows = (df.offset(offset) if limit is None else df.offset(offset).limit(limit)).collect()
    end = offset + len(rows)
    return Page(rows, total, offset, end < total, end if end < total else None)


def parse_range(target: str) -> tuple[str, int, int] | None:
    """``file:12-30``, ``file:12`` and ``file#12``."""
    m = re.fullmatch(r"(.+?)[:#](\d+)(?:-(\d+))?", target)
    return (m[1], int(m[2]), int(m[3] or m[2])) if m else None


def file_of(files: DataFrame, hint: str) -> str | None:
    """The file a hint means: exact, else equal but for case, else the only one that ends in it."""
    hint = hint.removeprefix("./")
    rel = F.col("rel")
    tier = F.when(rel == hint, 0).when(F.lower("rel") == hint.lower(), 1).when(rel.endswith("/" + hint), 2)
    got = files.select("rel", tier.alias("t")).where("t IS NOT NULL").distinct().groupBy("t").agg(F.count("*").alias("n"), F.min("rel").alias("rel")).orderBy("t").first()
    return got["rel"] if got and (got["t"] == 0 or got["n"] == 1) else None


def resolve(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols a query addresses: ``file#path``, a path, the end of a path (only with a dot), a bare name; best tier only."""
    s = symbols
    if "#" in query:
        file, query = query.split("#", 1)
        s = s.where((F.col("file") == file) | F.col("file").endswith("/" + file))
    dotted = F.col("path").endswith("." + query) if "." in query else F.lit(False)
    tiered = s.withColumn("tier", F.when(F.col("path") == query, 0).when(dotted, 1).when(F.col("name") == query, 2)).where("tier IS NOT NULL")
    best = tiered.agg(F.min("tier").alias("t")).first()["t"]
    return tiered.where(F.col("tier") == F.lit(best)).drop("tier").distinct() if best is not None else tiered.drop("tier")


def near_files(files: DataFrame, hint: str, most: int = 8) -> list[str]:
    """Existing files that share a token of three letters or more with the name asked for."""
    tokens = [t for t in re.split(r"[^0-9a-z]+", hint.rsplit("/", 1)[-1].lower()) if len(t) >= 3]
    if not tokens:
        return []
    own = F.split(F.lower(paths.basename(F.col("rel"))), "[^0-9a-z]+")
    score = F.size(F.array_intersect(own, F.array(*[F.lit(t) for t in tokens])))
    rows = files.select("rel", score.alias("n")).where("n > 0").distinct().orderBy(F.desc("n"), "rel").limit(most).collect()
    return [r["rel"] for r in rows]


def explain_target(files: DataFrame, symbols: DataFrame, target: str) -> str:
    """Why a target does not resolve."""
    file, sep, name = target.partition("#")
    if not sep:
        n = resolve(symbols, target).count()
        if n > 1:
            first = [f"{r['file']}#{r['path']}" for r in resolve(symbols, target).orderBy("file", "path").limit(8).collect()]
            return f"{n} symbols are called {target}: " + ", ".join(first)
        return f"no symbol is called {target}; near files: {', '.join(near_files(files, target)) or 'none'}"
    rel = file_of(files, file)
    if rel is None:
        return f"no file {file}; near files: {', '.join(near_files(files, file)) or 'none'}"
    return f"{rel} has no symbol {name}"


def read_range(files: DataFrame, rel: str, first: int, last: int, at: str | None = None) -> dict:
    """Lines of a file, the end clamped; refused if ``at`` is not the hash of what is there."""
    row = corpus.content(files.where(F.col("rel") == rel)).first()
    if row is None:
        raise LookupError(f"no readable file {rel}")
    body = row["content"]
    digest = text.sha1_text(body)
    if at is not None and at != digest:
        raise ValueError("stale: the file is another one now")
    lines = body.split("\n")
    last = min(last, len(lines))
    return {"rel": rel, "line_start": first, "line_end": last, "text": "\n".join(lines[first - 1 : last]), "at": digest}


def read_file(files: DataFrame, rel: str, max_lines: int = LIMITS["read_file"]) -> dict:
    out = read_range(files, rel, 1, max_lines)
    row = corpus.content(files.where(F.col("rel") == rel)).select(F.size(F.split("content", "\n")).alias("n")).first()
    return {**out, "truncated": row["n"] > max_lines, "more": max(0, row["n"] - max_lines)}


def read(files: DataFrame, symbols: DataFrame, target: str) -> dict:
    """A symbol, ``file#symbol``, ``file#Heading``, a file, or a range. Symbols come first; an ambiguous one is an error."""
    span = parse_range(target)
    if span and file_of(files, span[0]):
        return read_range(files, file_of(files, span[0]), span[1], span[2])
    if "#" not in target and (rel := file_of(files, target)):
        return read_file(files, rel)
    found = resolve(symbols, target).limit(2).collect()
    if len(found) > 1:
        raise LookupError(explain_target(files, symbols, target))
    if found:
        s = found[0]
        return {**read_range(files, s["file"], s["line_start"], s["line_end"]), "symbol": s["path"]}
    file, sep, title = target.partition("#")
    rel = file_of(files, file) if sep else None
    if rel:
        row = corpus.content(files.where(F.col("rel") == rel)).first()
        hits = documents.section_of(documents.regions(rel, row["content"]) or [], title) if row else []
        if len(hits) == 1:
            return {**read_range(files, rel, hits[0][3], hits[0][4]), "heading": hits[0][1]}
    raise LookupError(explain_target(files, symbols, target))


def outline(files: DataFrame, symbols: DataFrame, rel: str) -> tuple[str, list]:
    """How a file is divided and into what: symbols, else sections, else chunks."""
    s = symbols.where(F.col("file") == rel).select("name", "kind", "path", "line_start", "line_end").distinct().orderBy("line_start", "path")
    rows = bounded_rows(s, 100_000, "symbols of a file")
    if rows:
        return "symbols", [tuple(r) for r in rows]
    row = corpus.content(files.where(F.col("rel") == rel)).first()
    if row is None:
        return "none", []
    found = documents.regions(rel, row["content"])
    if found:
        return "sections", found
    at = text.Offsets(row["content"])
    return "chunks", [("chunk", "", 0, at.line_col(a)[0], at.line_col(max(a, b - 1))[0]) for a, b in documents.chunks(rel, row["content"])]


# -- packages

PACKAGES = "ws string, name string, version string, description string, main string, types string, export_keys array<string>, declared array<string>, source string"


def declared(manifest: dict) -> list[str]:
    """Names of dependencies in the order of their groups; the first mention counts."""
    out: dict[str, None] = {}
    for group in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"):
        for name in manifest.get(group) or {}:
            out.setdefault(name)
    return list(out)


def members_of_declarations(source: str, most: int = 1500) -> tuple[list[str], list[str], list[str]]:
    """(exported names, members as Owner.name, relative re-exports) of a declaration file."""
    names = re.findall(r"(?m)^\s*export\s+(?:declare\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var|namespace)\s+([\w$]+)", source)
    for group in re.findall(r"(?m)^\s*export\s*(?:type\s*)?\{([^}]*)\}", source):
        names += [p.split(" as ")[-1].strip() for p in group.split(",") if p.strip()]
    members, owner, depth = [], None, 0
    for line in source.split("\n"):
        head = re.match(r"\s*(?:export\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class|interface)\s+([\w$]+)", line)
        if head and depth == 0:
            owner = head[1]
        elif owner and depth == 1:
            m = re.match(r"\s*(?:(?:readonly|static|public|get|set|abstract)\s+)*([\w$]+)\s*[?!]?\s*[(:<]", line)
            if m:
                members.append(f"{owner}.{m[1]}")
        depth += line.count("{") - line.count("}")
        if depth <= 0:
            depth, owner = 0, owner if head and "{" not in line else None
    hops = re.findall(r"(?m)^\s*export\s+(?:\*|\{[^}]*\})\s*(?:as\s+\w+\s*)?from\s*['\"](\.[^'\"]+)['\"]", source)
    return list(dict.fromkeys(names))[:500], list(dict.fromkeys(members))[:most], hops


def packages(files: DataFrame) -> DataFrame:
    """Every manifest as a row, with what it declares."""
    import pandas as pd

    names = [c.strip().split(" ")[0] for c in PACKAGES.split(",")]

    def run(batches):
        for pdf in batches:
            rows = []
            for ws, rel, source in pdf.itertuples(index=False):
                m = text.jsonc(source)
                if isinstance(m, dict) and m.get("name"):
                    exp = m.get("exports")
                    keys = sorted(exp) if isinstance(exp, dict) else []
                    rows.append((ws, str(m["name"]), m.get("version"), (m.get("description") or "")[:200] or None, m.get("main"), m.get("types") or m.get("typings"), keys, declared(m), rel))
            yield pd.DataFrame(rows, columns=names)

    manifests = corpus.content(files).where(paths.basename(F.col("rel")) == "package.json")
    return manifests.mapInPandas(run, PACKAGES).distinct()


# -- queries


def read_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every symbol by its lines, as a digest: symbols joined to their content once."""
    f = table(spark, sf, "files")
    s = table(spark, sf, "symbols").select("ws", F.col("file").alias("rel"), "path", "line_start", "line_end").distinct()
    # spans are gathered by file, so that content is split once and shuffled once
    spans = s.groupBy("ws", "rel").agg(F.collect_list(F.struct("path", "line_start", "line_end")).alias("spans"))
    j = corpus.content(f).dropDuplicates(["ws", "rel"]).join(spans, ["ws", "rel"])
    lines = j.select("ws", "rel", F.split("content", "\n").alias("a"), F.explode("spans").alias("s"))
    body = F.array_join(F.slice("a", F.col("s.line_start"), F.col("s.line_end") - F.col("s.line_start") + 1), "\n")
    return lines.select("ws", "rel", "s.path", "s.line_start", F.md5(body).alias("md5"))


def symbol_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every symbol by its offsets, beside its first line number, as a digest."""
    f = corpus.content(table(spark, sf, "files")).dropDuplicates(["ws", "rel"])
    s = table(spark, sf, "symbols").where("start_off IS NOT NULL").select("ws", F.col("file").alias("rel"), "name", "start_off", "end_off", "line_start").distinct()
    j = f.join(s, ["ws", "rel"])
    before = F.substring(F.col("content"), F.lit(1), F.col("start_off"))
    cut = F.substring(F.col("content"), F.col("start_off") + 1, F.col("end_off") - F.col("start_off"))
    return j.select("ws", "rel", "name", "line_start", (F.regexp_count(before, F.lit("\n")) + 1).alias("line"), F.md5(cut).alias("md5"))


QUERIES = {f.__name__: f for f in (read_symbols, symbol_offsets)}
ORACLE = {
    "read_symbols": f"""WITH {corpus.SEARCHABLE_SQL}, S AS (SELECT DISTINCT ws, file AS rel, path, line_start, line_end FROM symbols)
 SELECT ws, rel, path, line_start, md5(array_to_string((string_split(content, chr(10)))[line_start:line_end], chr(10))) AS md5 FROM S JOIN C USING (ws, rel)""",
    "symbol_offsets": f"""WITH {corpus.SEARCHABLE_SQL}, S AS (SELECT DISTINCT ws, file AS rel, name, start_off, end_off, line_start FROM symbols WHERE start_off IS NOT NULL)
 SELECT ws, rel, name, line_start, CAST(start_off - len(replace(left(content, start_off), chr(10), '')) + 1 AS INTEGER) AS line, md5(substring(content, start_off + 1, end_off - start_off)) AS md5 FROM S JOIN C USING (ws, rel)""",
}
