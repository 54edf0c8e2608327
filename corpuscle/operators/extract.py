"""Symbols, imports and calls read from source: one scanner, languages as rows of data, Python by its own parser.

The registry takes further extractors: the first whose match accepts a path is used, in order of registration, and one that
is registered again under its id replaces the former in place. Errors become the reason of the file and never stop a run.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..session import spread, table
from . import corpus

VERSION = "corpuscle:1"
# lower index wins where two kinds claim the same range
KINDS = "method function class interface enum type constant module".split()
DOC_MAX, SIGNATURE_MAX = 400, 300


@dataclass(frozen=True)
class Spec:
    """A brace language: what begins a comment or a string, patterns by kind, and which names are exported."""

    skip: str
    patterns: tuple[tuple[str, str], ...]
    exported: str  # a pattern on the signature, or 'upper' for the first letter of the name


_QUOTED = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_COMMENT = r"//[^\n]*+|/\*.*?\*/"
_PAREN = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_SCRIPT = (
    ("class", r"^[ \t]*+(?:export\s++)?+(?:default\s++)?+(?:abstract\s++)?+class\s++(?P<n>[\w$]++)"), ("interface", r"^[ \t]*+(?:export\s++)?+interface\s++(?P<n>[\w$]++)"),
    ("enum", r"^[ \t]*+(?:export\s++)?+(?:const\s++)?+enum\s++(?P<n>[\w$]++)"), ("type", r"^[ \t]*+(?:export\s++)?+type\s++(?P<n>[\w$]++)\s*+[<=]"),
    ("function", r"^[ \t]*+(?:export\s++)?+(?:default\s++)?+(?:async\s++)?+function\b\s*+\*?+\s*+(?P<n>[\w$]++)"),
    ("function", rf"^[ \t]*+(?:export\s++)?+(?:const|let|var)\s++(?P<n>[\w$]++)(?:\s*+:[^=\n]++)?+\s*+=\s*+(?:async\s++)?+(?:function\b|{_PAREN}(?:\s*+:[^{{}};=]++)?+\s*+=>|[\w$]++\s*+=>)"),
    ("method", rf"^[ \t]++(?:(?:public|private|protected|static|async|get|set|override|readonly)\s++)*+\*?+(?P<n>#?+(?!(?:if|for|while|switch|catch|return|function|with)\b)[\w$]++)\s*+{_PAREN}(?:\s*+:[^{{}};=]++)?+\s*+\{{"),
    ("constant", r"^(?:export\s++)?+(?:const|let|var)\s++(?P<n>[\w$]++)(?:\s*+:[^=\n]++)?+\s*+="),
)
SPECS = {
    "javascript": Spec(rf"{_COMMENT}|{_QUOTED}|`(?:[^`\\]|\\.)*+`", _SCRIPT, r"\bexport\b"),
    "typescript": Spec(rf"{_COMMENT}|{_QUOTED}|`(?:[^`\\]|\\.)*+`", _SCRIPT, r"\bexport\b"),
    "go": Spec(rf"{_COMMENT}|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)++'|`[^`]*+`", (
        ("method", r"^func\s++\([^()]*+\)\s*+(?P<n>\w++)"), ("function", r"^func\s++(?P<n>\w++)"), ("class", r"^type\s++(?P<n>\w++)\s++struct\b"), ("interface", r"^type\s++(?P<n>\w++)\s++interface\b"),
        ("type", r"^type\s++(?P<n>\w++)\s++(?!struct\b|interface\b)"), ("constant", r"^(?:const|var)\s++(?P<n>\w++)"),
    ), "upper"),
    "java": Spec(rf"{_COMMENT}|\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|{_QUOTED}", (
        ("class", r"^[ \t]*+(?:(?:public|private|protected|static|final|abstract|sealed)\s++)*+(?:class|record)\s++(?P<n>\w++)"), ("interface", r"^[ \t]*+(?:(?:public|private|protected|static)\s++)*+@?+interface\s++(?P<n>\w++)"),
        ("enum", r"^[ \t]*+(?:(?:public|private|protected|static)\s++)*+enum\s++(?P<n>\w++)"),
        ("method", rf"^[ \t]++(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s++)*+(?!(?:return|new|else|throw|if|for|while|switch|catch)\b)(?:<[^;{{}}()]*?>\s*+)?+[\w.$]++(?:\s*+<(?:[^;{{}}()=<>]++|<(?:[^;{{}}()=<>]++|<[^;{{}}()=<>]*+>)*+>)*+>)?+(?:\s*+\[\s*+\])*+\s++(?P<n>\w++)\s*+{_PAREN}\s*+(?:throws\b[\w.,\s]++)?+[{{;]"),
        ("constant", r"^[ \t]++(?:(?:public|private|protected)\s++)?+static\s++final\s++[\w<>\[\], .]+?\s(?P<n>[A-Z][A-Z0-9_]*+)\s*+="),
    ), r"\bpublic\b"),
    "rust": Spec(rf"{_COMMENT}|r(?P<h>#*+)\".*?\"(?P=h)|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'", (
        ("class", r"^[ \t]*+(?:pub(?:\([^)]*+\))?+\s++)?+(?:struct|union)\s++(?P<n>\w++)"), ("enum", r"^[ \t]*+(?:pub(?:\([^)]*+\))?+\s++)?+enum\s++(?P<n>\w++)"), ("interface", r"^[ \t]*+(?:pub(?:\([^)]*+\))?+\s++)?+trait\s++(?P<n>\w++)"),
        ("module", r"^[ \t]*+(?:pub(?:\([^)]*+\))?+\s++)?+mod\s++(?P<n>\w++)\s*+\{"), ("type", r"^[ \t]*+(?:pub(?:\([^)]*+\))?+\s++)?+type\s++(?P<n>\w++)"),
        ("function", r"^[ \t]*+(?:pub(?:\([^)]*+\))?+\s++)?+(?:(?:const|async|unsafe)\s++)*+fn\s++(?P<n>\w++)"), ("constant", r"^[ \t]*+(?:pub(?:\([^)]*+\))?+\s++)?+(?:const|static)\s++(?P<n>\w++)\s*+:"),
    ), r"\bpub\b"),
    "php": Spec(rf"{_COMMENT}|\#(?!\[)[^\n]*+|{_QUOTED}", (
        ("class", r"^[ \t]*+(?:(?:abstract|final|readonly)\s++)*+(?:class|trait)\s++(?P<n>\w++)"), ("interface", r"^[ \t]*+interface\s++(?P<n>\w++)"), ("enum", r"^[ \t]*+enum\s++(?P<n>\w++)"),
        ("function", r"^[ \t]*+(?:(?:public|private|protected|static|abstract|final)\s++)*+function\s++&?+(?P<n>\w++)"), ("constant", r"^[ \t]*+(?:(?:public|private|protected|final)\s++)*+const\s++(?P<n>\w++)\s*+="),
    ), r"^(?!.*\b(?:private|protected)\b)"),
    "csharp": Spec(rf"{_COMMENT}|@\"(?:[^\"]|\"\")*+\"|{_QUOTED}", (
        ("module", r"^[ \t]*+namespace\s++(?P<n>[\w.]++)"), ("class", r"^[ \t]*+(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly)\s++)*+(?:class|struct|record)\s++(?P<n>\w++)"),
        ("interface", r"^[ \t]*+(?:(?:public|internal|partial)\s++)*+interface\s++(?P<n>\w++)"), ("enum", r"^[ \t]*+(?:(?:public|internal|private)\s++)*+enum\s++(?P<n>\w++)"),
        ("method", rf"^[ \t]++(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|partial)\s++)++(?:[\w.]++(?:\s*+<(?:[^;{{}}()=<>]++|<[^;{{}}()=<>]*+>)*+>)?+(?:\[\])?+\??+\s++)?+(?P<n>\w++)\s*+(?:<[^>]*+>)?+\s*+{_PAREN}\s*+(?:where\b[^{{;]++)?+(?:[{{;]|=>)"),
    ), r"\bpublic\b"),
    "c": Spec(rf"{_COMMENT}|{_QUOTED}", (
        ("class", r"^(?:typedef\s++)?+(?:struct|union|class)\s++(?P<n>\w++)[^;{()]*+\{"), ("enum", r"^(?:typedef\s++)?+enum\s++(?:class\s++)?+(?P<n>\w++)[^;{]*+\{"), ("module", r"^[ \t]*+namespace\s++(?P<n>[\w:]++)\s*+\{"),
        ("function", rf"^(?!(?:typedef|return|else|struct|enum|union|class|using|namespace)\b)(?:[\w:<>,~*&]++[ \t*&]++)*+(?P<n>[\w:~]++)\s*+{_PAREN}\s*+(?:const\s*+|noexcept\s*+|override\s*+)*+(?:\n[ \t]*+)?+\{{"), ("constant", r"^\#define\s++(?P<n>[A-Z_][A-Z0-9_]*+)\s"),
    ), r"^(?!static\b)"),
}
SPECS["cpp"] = SPECS["c"]
_COMPILED = {k: (re.compile(s.skip, re.S), [(kind, re.compile(p, re.M)) for kind, p in s.patterns], s.exported) for k, s in SPECS.items()}
CONTAINERS = {"class", "interface", "enum", "module"}


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    line_start: int
    line_end: int
    signature: str
    doc: str
    exported: bool
    path: str = ""
    parent: str | None = None


def _squeeze(s: str, most: int) -> str:
    s = re.sub(r"\s+", " ", s).strip()
    s = re.sub(r"\( ", "(", s)
    s = re.sub(r",? \)", ")", s)
    s = re.sub(r"[{:;]\s*$", "", s).strip()
    return s if len(s) <= most else s[:most] + "…"


def _comment_text(s: str) -> str:
    lines = [re.sub(r"^\s*(?:/\*+!?|//+!?|#+!?|\*(?!/))\s?|\s*\*+/\s*$", "", x).strip() for x in s.split("\n")]
    return "\n".join(x for x in lines if x)[:DOC_MAX]


def braces(text: str, lang: str) -> list[Symbol]:
    """Symbols of a brace language, nested by range."""
    skip, patterns, exported = _COMPILED[lang]
    comments: dict[int, tuple[int, int]] = {}

    def blank(m: re.Match) -> str:
        t = m[0]
        if t.startswith(("//", "/*")):
            comments[m.end()] = m.span()
        return re.sub(r"[^\n]", " ", t) if "\n" in t else " " * len(t)

    bare = skip.sub(blank, text)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    import bisect

    line = lambda at: bisect.bisect_right(lines, at)
    found: dict[tuple[int, int], Symbol] = {}
    for kind, pattern in patterns:
        for m in pattern.finditer(bare):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            end = _close(bare, m.end() - 1 if bare[m.end() - 1 : m.end()] in ("{", ";") else m.end(), kind)
            head = m.end() if kind in CONTAINERS or kind in ("constant", "type") else _head_end(bare, m.end())
            k = (at, end)
            if k in found and KINDS.index(found[k].kind) <= KINDS.index(kind):
                continue
            name = m["n"]
            sig = _squeeze(text[at:head], SIGNATURE_MAX)
            export = name[:1].isupper() if exported == "upper" else bool(re.search(exported, text[at:head]))
            found[k] = Symbol(name, kind, at, end, line(at), line(max(at, end - 1)), sig, _doc_above(text, lines, comments, line(at)), export)
    return nest(list(found.values()))


def _close(bare: str, at: int, kind: str) -> int:
    depth = paren = 0
    for m in re.compile(r"[{}();\n]").finditer(bare, at):
        c = m[0]
        if c == "(":
            paren += 1
        elif c == ")":
            paren -= 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif c == ";" and not depth and paren <= 0:
            return m.end()
        elif c == "\n" and not depth and paren <= 0 and kind in ("constant", "type"):
            return m.start()
    return len(bare)


def _head_end(bare: str, at: int) -> int:
    m = re.compile(r"\{|;|=>").search(bare, max(0, at - 1))
    return m.start() if m else at


def _doc_above(text: str, lines: list[int], comments: dict, first: int) -> str:
    """The comment that ends on the line above, over annotations and attributes; line comments join."""
    k = first - 2
    while k >= 0 and re.match(r"\s*(?:@\w|#\[)", text[lines[k] : lines[k + 1]]):
        k -= 1
    got = []
    while k >= 0:
        end = len(text[lines[k] : lines[k + 1]].rstrip()) + lines[k]
        if end not in comments:
            break
        a, b = comments[end]
        if text[text.rfind("\n", 0, a) + 1 : a].strip():
            break
        got.append(text[a:b])
        k -= text.count("\n", a, b) + 1
        if text.startswith("/*", a):
            break
    return _comment_text("\n".join(reversed(got)))


def nest(symbols: list[Symbol]) -> list[Symbol]:
    """Sets path and parent: the parent is the innermost other symbol around."""
    symbols.sort(key=lambda s: (s.start, -s.end))
    stack: list[Symbol] = []
    for s in symbols:
        while stack and stack[-1].end < s.end or stack and stack[-1].end <= s.start:
            stack.pop()
        if stack:
            s.parent, s.path = stack[-1].name, f"{stack[-1].path}.{s.name}"
            if s.kind == "function" and stack[-1].kind in ("class", "interface"):
                s.kind = "method"
        else:
            s.path = s.name
        stack.append(s)
    return symbols


def python(text: str) -> list[Symbol]:
    """Symbols of a Python file by its syntax tree; SyntaxError if there is none."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    out: list[Symbol] = []

    def visit(body: list[ast.stmt], path: str, parent: str | None, kind_in: str) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first, last = node.lineno, node.end_lineno
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if kind_in == "class" else "function"
                a = lines[first - 1] + node.col_offset
                body_line = node.body[0].lineno
                sig = _squeeze(text[a : lines[body_line - 1]] if body_line > first else text[a : lines[first] if first < len(lines) else len(text)], SIGNATURE_MAX)
                full = f"{path}.{node.name}" if path else node.name
                out.append(Symbol(node.name, kind, a, lines[last] if last < len(lines) else len(text), first, last, sig, (ast.get_docstring(node) or "")[:DOC_MAX], not path and not node.name.startswith("_"), full, parent))
                visit(node.body, full, node.name, "class" if is_class else "function")
            elif not path and isinstance(node, (ast.Assign, ast.AnnAssign)):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        a = lines[node.lineno - 1]
                        out.append(Symbol(t.id, "constant", a, lines[node.end_lineno] if node.end_lineno < len(lines) else len(text), node.lineno, node.end_lineno, _squeeze(text[a : a + 200].split("\n")[0], SIGNATURE_MAX), "", not t.id.startswith("_"), t.id, None))
            else:
                for inner in ("body", "orelse", "finalbody"):
                    visit([n for n in getattr(node, inner, []) if isinstance(n, ast.stmt)], path, parent, kind_in)
                for part in (*getattr(node, "handlers", []), *getattr(node, "cases", [])):
                    visit(part.body, path, parent, kind_in)

    visit(tree.body, "", None, "")
    return out


# -- registry

Extractor = Callable[[str, str], list[Symbol]]
_REGISTRY: list[tuple[str, Callable[[str], bool], Extractor, str]] = []


def register_extractor(ident: str, match: Callable[[str], bool], extract: Extractor, version: str = "1") -> None:
    row = (ident, match, extract, version)
    for i, r in enumerate(_REGISTRY):
        if r[0] == ident:
            _REGISTRY[i] = row
            return
    _REGISTRY.append(row)


def analyzer_version() -> str:
    """Changes when an extractor does, so that a scan analyses again."""
    return "+".join([VERSION, *(f"{i}:{v}" for i, _, _, v in _REGISTRY)])


def extract(rel: str, text: str, registry=None) -> tuple[list[Symbol], str | None]:
    """(symbols, reason); the reason is None for a file that could be analysed."""
    for _, match, fn, _ in _REGISTRY if registry is None else registry:
        try:
            if match(rel):
                return fn(rel, text), None
        except Exception as e:  # a broken extension disqualifies only itself
            return [], f"extension: {e}"[:200]
    lang = paths.LANG_OF_EXT.get((re.search(r"(\.[^./\\]+)$", rel) or [""])[0].lower(), "other")
    text = text.removeprefix("﻿")
    try:
        if lang == "python":
            return python(text), None
        if lang in SPECS:
            return braces(text, lang), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], f"syntax: {getattr(e, 'msg', e)} at {getattr(e, 'lineno', 0)}:{getattr(e, 'offset', 0)}"
    return [], None


SYMBOLS = (
    "ws string, file string, ord int, name string, kind string, line_start int, line_end int, start_off int, end_off int, "
    "path string, parent string, signature string, doc string, exported boolean, reason string"
)


def extract_files(files: DataFrame) -> DataFrame:
    """Symbol rows of every searchable file; a file that can not be analysed gives one row with its reason."""
    registry = list(_REGISTRY)
    names = [c.strip().split(" ")[0] for c in SYMBOLS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ws, rel, text in pdf.itertuples(index=False):
                found, reason = extract(rel, text, registry)
                for i, s in enumerate(found):
                    rows.append((ws, rel, i, s.name, s.kind, s.line_start, s.line_end, s.start, s.end, s.path, s.parent, s.signature, s.doc or None, s.exported, None))
                if reason:
                    rows.append((ws, rel, None, None, None, None, None, None, None, None, None, None, None, None, reason))
            out = pd.DataFrame(rows, columns=names)
            for c in ("ord", "line_start", "line_end", "start_off", "end_off"):
                out[c] = out[c].astype("Int32")
            yield out

    return spread(corpus.content(files)).mapInPandas(run, SYMBOLS).dropDuplicates(["ws", "file", "ord"])


def calls(files: DataFrame) -> DataFrame:
    """(ws, rel, ln, name) of every call site of code, by built-in expressions."""
    from ..functions import text as tx

    code = corpus.content(files).where(paths.lang_of(F.col("rel")).isin(["python", *SPECS]))
    lines = tx.with_lines(code).where(F.col("line").contains("(") & ~F.col("line").rlike(r"^\s*(?://|#|\*|/\*)"))
    names = F.regexp_extract_all("line", F.lit(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\("), F.lit(1))
    each = lines.where(~F.col("line").rlike(r"^\s*(?:async\s+)?(?:def|func|function|fn|class)\b")).select("ws", "rel", "ln", F.explode(F.array_distinct(names)).alias("name"))
    return each.where(~F.col("name").isin("if", "for", "while", "switch", "catch", "return", "function", "and", "or", "not", "in", "elif")).distinct()


# -- queries


def extracted_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return extract_files(table(spark, sf, "files")).where("reason IS NULL").drop("reason", "doc")


def extraction_check(spark: SparkSession, sf: str) -> DataFrame:
    """The index against what is extracted: functions and methods in both, by kind of the index."""
    mine = extract_files(table(spark, sf, "files")).where("kind IN ('function', 'method')").select("ws", "file", "name", "line_start", "line_end").distinct().withColumn("hit", F.lit(1))
    s = table(spark, sf, "symbols").where("kind IN ('function', 'method')").select("ws", "file", "name", "kind", "line_start", "line_end").distinct()
    bad = extract_files(table(spark, sf, "files")).where("reason IS NOT NULL").select("ws", "file").distinct()
    j = s.join(bad, ["ws", "file"], "left_anti").join(mine, ["ws", "file", "name", "line_start", "line_end"], "left")
    return j.groupBy("kind").agg(F.count("*").alias("indexed"), F.count("hit").alias("extracted"))


def call_sites(spark: SparkSession, sf: str) -> DataFrame:
    return calls(table(spark, sf, "files")).groupBy("name").agg(F.count("*").alias("calls"), F.countDistinct("ws", "rel").alias("files"))


QUERIES = {f.__name__: f for f in (extracted_symbols, extraction_check, call_sites)}
ORACLE = {
    "call_sites": f"""WITH {corpus.LINES_SQL}, D AS (SELECT DISTINCT ws, rel, ln, unnest(list_distinct(regexp_extract_all(replace(line, '(', '(('), '(?:^|[^\\w$.])([A-Za-z_$][\\w$]*)\\s*\\(', 1))) AS name FROM L
 WHERE regexp_matches(lower(rel), '\\.(py|m?js|ts|go|java|rs)$') AND contains(line, '(') AND NOT regexp_matches(line, '^\\s*(?://|#|\\*|/\\*)') AND NOT regexp_matches(line, '^\\s*(?:async\\s+)?(?:def|func|function|fn|class)\\b'))
 SELECT name, count(*) AS calls, count(DISTINCT ws || chr(1) || rel) AS files FROM D WHERE name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'function', 'and', 'or', 'not', 'in', 'elif') GROUP BY name""",
}
