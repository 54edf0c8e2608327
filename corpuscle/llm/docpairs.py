"""Functions paired with their documentation.

Strings and comments are found first and blanked, so that signatures inside them do not count. Signatures are then found
by regular expressions. One pass over the lines with a stack of indentations (Python), or over the braces with a stack of
those that are open (all others), gives the ends of all bodies at once. The comment that ends on the line before the
declaration, over decorators, annotations and attributes, is attached, as is a Python docstring. Documentation that says nothing is dropped, see ``prose``.

Cases: files that do not parse, that are no code or have no content give no pair. Repeated rows of a file give the same
pairs once each. Documentation may be in any language; two ideographs or kana count as a word. Very long files are read
whole. ``symbols`` is not needed. Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, table_lang
from ..syntax import syntax_errors

SCHEMA = "ws string, rel string, lang string, name string, line_start int, line_end int, signature string, doc string, code string"

_Q = r'"(?:[^"\\\n]|\\.)*"'
_A = r"'(?:[^'\\\n]|\\.)*'"
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?\*/"
_RX = r"(?:(?<=[=(,:\[!&|?{};+\n-])|(?<=[=(,:\[!&|?{};+-] )|(?<=return ))/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
SCAN = {
    "python": rf'#[^\n]*|"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|{_Q}|{_A}',
    "javascript": rf"{_LINE}|{_BLOCK}|{_Q}|{_A}|{_RX}|`",
    "typescript": rf"{_LINE}|{_BLOCK}|{_Q}|{_A}|{_RX}|`",
    "go": rf"{_LINE}|{_BLOCK}|{_Q}|'(?:[^'\\\n]|\\[^\n])+?'|`[^`]*`",
    "java": rf'{_LINE}|{_BLOCK}|"""(?:[^"\\]|\\.|"(?!""))*"""|{_Q}|{_A}',
    "rust": rf"{_LINE}|{_BLOCK}|r(?P<h>#*)\".*?\"(?P=h)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'",
}
SCAN = {k: re.compile(v, re.S) for k, v in SCAN.items()}

# possessive quantifiers: a line that is no signature costs one pass over it
_ARGS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_TYPE = r"(?:\s*+:[^{};=]++)?+\s*+"
_NO = r"(?!(?:if|for|while|switch|catch|with|return|new|else|throw|do|try|function|await|yield|case|super|this|assert|typeof|delete|void|let|const|var|import|export|class)\b)"
_FUNC = rf"(?:async\s++)?+(?:function\b|(?:<[^>]*+>\s*+)?+{_ARGS}(?:\s*+:[^{{}};=]++)?+\s*+=>|[\w$]++\s*+=>)"
_JS = (
    rf"^[ \t]*+(?:(?:(?:export\s++)?+(?:default\s++)?+(?:declare\s++)?+(?:async\s++)?+function\b\s*+\*?+\s*+(?P<f>[\w$]++))"
    rf"|(?:export\s++)?+(?:const|let|var)\s++(?P<c>[\w$]++)(?:\s*+:[^=\n]++)?+\s*+=\s*+{_FUNC}"
    # bound to a field of a class, to a property of an object, or by an assignment
    rf"|(?:(?:public|private|protected|static|override|readonly|declare)\s++(?![(:=;?!]))*+{_NO}(?:[\w$]++\s*+\.\s*+|this\s*+\.\s*+)*+(?P<p>\#?+[\w$]++)\s*+(?:[?!]?+:\s*+(?:[^=;{{}}\n]++=(?!>)\s*+)?+|=\s*+){_FUNC}"
    rf"|{_NO}(?:(?:public|private|protected|static|override|readonly|abstract|async|get|set)\s++(?![(:=;]))*+\*?+\s*+{_NO}(?P<m>\#?+[\w$]++)\s*+\??+\s*+(?:<[^>{{}}]*+>)?+\s*+{_ARGS}{_TYPE}\{{)"
)
SIGNATURE = {
    "python": r"^[ \t]*+(?:async[ \t]++)?+def[ \t]++(?P<f>\w++)",
    "javascript": _JS, "typescript": _JS,
    "go": r"^func\s++(?:\([^()]*+\)\s*+)?+(?P<f>\w++)\s*+(?:\[[^\]]*+\])?+\s*+\(",
    "java": (
        rf"^[ \t]*+(?:@[\w.]++(?:{_ARGS})?+[ \t]++)*+{_NO}(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s++)*+(?:<[^;{{}}()]*?>\s*+)?+"
        rf"(?:(?:[\w.$]++(?:\s*+<(?:[^;{{}}()=<>]++|<(?:[^;{{}}()=<>]++|<[^;{{}}()=<>]*+>)*+>)*+>)?+(?:\s*+\[\s*+\])*+\s++)(?P<f>[\w$]++)\s*+{_ARGS}\s*+(?:\[\s*+\]\s*+)*+(?:throws\b[\w.,\s@]++)?+(?:default\b[^;]++)?+[{{;]|(?P<k>[A-Z][\w$]*+)\s*+{_ARGS}\s*+(?:throws\b[\w.,\s@]++)?+\{{)"
    ),
    "rust": r"^[ \t]*+(?:pub(?:\s*+\([^)]*+\))?+\s++)?+(?:(?:default|const|async|unsafe|extern(?:\s*+\"\s*+\")?+)\s++)*+fn\s++(?P<f>(?:r\#)?\w++)",
}
SIGNATURE = {k: re.compile(v, re.M) for k, v in SIGNATURE.items()}
NOT_NAMES = frozenset("if for while switch catch with return new else throw do try function await yield case super this assert synchronized typeof delete void in of".split())


# -- what documentation says

_TODO = re.compile(r"(?im)(?:^|(?<=[\s.;!?(]))@?(?:to-?do|fixme|xxx|tbd|hack|wip)\b[^\n]*")
_DIRECTIVE = re.compile(
    r"(?im)(?:^|(?<=\s))(?:eslint(?:-[\w-]+)?|prettier-ignore|noqa|type:\s*ignore|pylint:|pragma:|nolint|nosonar|istanbul|c8 ignore|v8 ignore|@ts-[\w-]+|ts-[\w-]+-error|fmt:|rustfmt|clippy|"
    r"noinspection|go:\w+|\+build|spdx-[\w-]+:|isort|mypy|yapf|ruff|flake8|bandit|nosec|pyright|black:|jshint|jslint|tslint|standard-disable|biome-ignore|flow(?:fixme|expect)?\b|jscs|checkstyle|"
    r"@?suppress(?:warnings|lint)|coverage:|cspell|codespell|region\b|endregion\b|vim:|-\*-|@jsx|@flow|@formatter|deno-lint|webpack\w+|lint:|allow\(|lgtm)[^\n]*"
)
_LICENCE = re.compile(r"(?i)\bcopyright\b|\(c\)\s*\d{4}|©|\ball rights reserved\b|\blicen[sc]ed under\b|\bspdx\b|\bsee (?:the )?licen[sc]e\b|\bno warranty\b|\bwithout warrant(?:y|ies)\b|\bpermission is hereby granted\b|\bredistribution and use\b")
_STUB = re.compile(
    r"(?im)^\W*(?:auto-?\s?generated\b[^\n]*|generated (?:code|by|method|file|from)\b[^\n]*|(?:this )?(?:code|file|method) (?:is|was) (?:auto-?)?generated\b[^\n]*|do not edit\b[^\n]*|@generated\b[^\n]*|"
    r"(?:please )?(?:add|insert|write|put|enter|fill in)\b[^\n.]{0,30}\b(?:description|documentation|docs?|comment|summary|text)\b[^\n.]{0,20}|"
    r"(?:description|documentation|docs?|comment|summary)\b[^\n.]{0,12}\b(?:goes|go|to come|to follow|missing|pending|needed|here)\b[^\n.]*|"
    r"(?:no|missing|without) (?:description|documentation|docs?|comment)\b[^\n.]*|describe\b[^\n.]{0,40}\bhere|document (?:this|me)\b[^\n.]*|lorem ipsum\b[^\n]*|placeholder\b[^\n.]*|"
    r"(?:to be|not yet|still to be|will be) (?:done|documented|written|defined|described|implemented|added|completed|filled)\b[^\n.]*|not (?:yet )?(?:implemented|documented)\b[^\n.]*|"
    r"(?:method |function )?stub\b[^\n.]*|"
    r"(?:documentation |docs? )?(?:is )?inherit(?:s|ed)?\b[^\n]*|see (?:the )?(?:super|base|parent|overridden|interface)[\s-]?(?:class|method|type|implementation|definition|declaration)?\b[^\n.]*|"
    r"(?:overrides?|implements)\b[^\n.]{0,60}$|same as (?:the )?(?:super|base|parent)\b[^\n.]*)"
)
_INHERIT = re.compile(r"(?i)\{?@inherit-?doc\}?|:inherit(?:ed)?:|@override\b|<inheritdoc\s*/?>")
_SEPARATOR = re.compile(r"(?m)^[ \t]*([=\-~#*_+.<>])\1{2,}[^\n]*?(?:\1{3,})?[ \t]*$|^[^\n]*?([=\-~#*_+])\2{3,}[ \t]*$")
_CODE_LINE = re.compile(
    r"(?m)^[ \t]*(?:[^\n]*[;{}][ \t]*|(?:const|let|var|return|import|from|if|for|while|def|func|fn|class|public|private|static|elif|else|use|package|raise|throw|await|yield|print)\b[^\n]*[=({;:\])][^\n]*|"
    r"[\w.\[\]$]+(?:[ \t]*:[ \t]*[\w\[\], .<>]+)?[ \t]*(?::=|=|\+=|-=|\*=|/=)[ \t]*[^\n]+|[\w.$]+\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)[ \t]*|[}\])]+[,;]?[ \t]*)$"
)
_TAG_PARAM = re.compile(r"(?m)@(?:param|arg|argument|property|prop|typeparam|template|tparam)\b[ \t]*(?:\{[^}\n]*\}[ \t]*)?(?:\[[^\]\n]*\]|[\w.$<>*]+)?[ \t]*(?:-(?=\s))?")
_TAG_RETURN = re.compile(r"(?m)@(?:returns?|yields?|throws|exception|raises|type|see|since|author|version|default|link|deprecated|example|memberof|async|static|private|public|protected|internal|override|api|group|category|module|class|function|method|name|kind|callback|this|implements|extends|readonly)\b[ \t]*(?:\{[^}\n]*\})?")
_TAG_NAMED = re.compile(r"@(?:throws|exception|see|since|author|version|memberof|type|name|module)\b[ \t]*[^\s]+")
_FIELD = re.compile(r"(?m):(?:param|arg|argument|key|keyword|type|raises|raise|except|exception|var|ivar|cvar)\b[^:\n]*:|:(?:returns?|rtype|yields?|meta)\b[^:\n]*:")
_SECTION = re.compile(r"(?im)^[ \t#*]*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|errors|panics|examples?|notes?|attributes|keyword args|other parameters|safety|see also)[ \t]*:?[ \t]*$\n?(?:[ \t]*-{3,}[ \t]*$)?")
_SECTION_INLINE = re.compile(r"(?im)^[ \t#*]*(?:args|arguments|parameters|params|returns?|yields?|raises|throws):")
_LIST_NAME = re.compile(r"(?m)^[ \t]*(?:[-*][ \t]+)?`?([\w$.]+)`?[ \t]*(?:\([^)\n]*\)[ \t]*)?(?::|[-–—](?=\s))")
_XML = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]+")


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    """One form for the inflections of an English word; crude but the same on both sides of a comparison."""
    w = word.lower()
    if len(w) > 3:
        for end in ("ings", "ing", "ies", "ied", "ers", "ed", "es", "er", "or", "s"):
            if w.endswith(end) and len(w) - len(end) >= 2:
                w = w[: -len(end)] + ("y" if end in ("ies", "ied") else "")
                break
    w = w.rstrip("e") if len(w) > 3 else w
    if w.endswith("y"):
        w = w[:-1] + "i"
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w


def name_words(name: str) -> list[str]:
    return [w.lower() for part in re.split(r"[\W_\d]+", name) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\WA-Z_\d]+|[A-Z]", part)]


def strip_marks(comment: str) -> str:
    """The text of a comment without its marks, line by line."""
    out = []
    for line in comment.split("\n"):
        line = line.strip()
        line = re.sub(r"^(?:/\*+!?|//+!?|#+!?)|\*+/$", "", line)
        line = re.sub(r"^[ \t]*\*(?!\*)[ \t]?", "", line)
        line = re.sub(r"\*+/$", "", line.rstrip())
        out.append(line.rstrip())
    return "\n".join(out).strip("\n")


def strip_quotes(literal: str) -> str:
    body = re.sub(r"^[rRuU]?(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')$", "", literal)
    return "\n".join(line.strip() for line in body.split("\n")).strip()


def prose(text: str, name: str, params: set[str] | None = None) -> int:
    """Words that ``text`` says beyond tags, their names and types, the function's own name, and what is no description:
    to-dos, placeholders, directives, stubs, inheritance remarks, licences, separators and disabled code."""
    paragraphs = [p for p in re.split(r"\n[ \t]*\n", text) if not _LICENCE.search(p)]
    text = "\n\n".join(paragraphs)
    for pattern in (_INHERIT, _TODO, _DIRECTIVE, _SEPARATOR):
        text = pattern.sub(" ", text)
    text = _STUB.sub(" ", text)
    text = _TAG_NAMED.sub(" ", text)
    text = _TAG_PARAM.sub(" ", text)
    text = _TAG_RETURN.sub(" ", text)
    text = _FIELD.sub(" ", text)
    text = _XML.sub(" ", text)
    text = _CODE_LINE.sub(" ", text)
    if _SECTION.search(text) or _SECTION_INLINE.search(text):
        text = _SECTION.sub("", text)
        text = _SECTION_INLINE.sub("", text)
        text = _LIST_NAME.sub(" ", text)
    elif params:
        text = _LIST_NAME.sub(lambda m: " " if m[1] in params else m[0], text)
    own = {stem(w) for w in name_words(name)} | {name.lower()}
    count = 0
    for run in _CJK.findall(text):
        count += len(run) // 2
    for w in _WORD.findall(_CJK.sub(" ", text)):
        if w.lower() not in own and stem(w) not in own:
            count += 1
    return count


LEAST_WORDS = 4


def says_something(text: str, name: str) -> bool:
    return prose(text, name) >= LEAST_WORDS


# -- finding functions and their comments


def blank(text: str, lang: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text with strings and comments blanked at equal length, and the spans of comments and of strings."""
    comments: list[tuple[int, int]] = []
    strings: list[tuple[int, int]] = []
    out, pos = [], 0
    scan = SCAN[lang]
    code = re.compile(r"[`{}]")
    while (m := scan.search(text, pos)) is not None:
        a, b = m.span()
        c = text[a]
        if c == "`" and lang in ("javascript", "typescript"):
            b = _template_end(text, b, scan, code)
            strings.append((a, b))
        elif c == "#" and lang == "python" or text[a : a + 2] in ("//", "/*") and lang != "python":
            comments.append((a, b))
        else:
            strings.append((a, b))
        piece = text[a:b]
        out.append(text[pos:a])
        out.append(re.sub(r"[^\n]", " ", piece) if "\n" in piece else " " * (b - a))
        pos = b
    out.append(text[pos:])
    return "".join(out), comments, strings


def _template_end(text: str, pos: int, scan: re.Pattern, code: re.Pattern) -> int:
    """Behind the template whose text begins at pos."""
    part = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
    while True:
        m = part.match(text, pos)
        if not m:
            return len(text)
        pos = m.end()
        if m[1] == "`":
            return pos
        depth = 0
        while True:
            c = re.compile(scan.pattern + r"|[{}]", re.S).search(text, pos)
            if not c:
                return len(text)
            pos = c.end()
            if c[0] == "`":
                pos = _template_end(text, pos, scan, code)
            elif c[0] == "{":
                depth += 1
            elif c[0] == "}":
                if not depth:
                    break
                depth -= 1


def brace_ends(bare: str) -> tuple[list[int], list[int]]:
    """Places of all braces and semicolons, and behind where each opened brace is closed; one pass, with a stack."""
    places, ends, open_ = [], [], []
    for m in re.finditer(r"[{};]", bare):
        places.append(m.start())
        ends.append(m.end())
        if m[0] == "{":
            open_.append(len(ends) - 1)
        elif m[0] == "}" and open_:
            ends[open_.pop()] = m.end()
    for k in open_:  # never closed
        ends[k] = len(bare)
    return places, ends


_CLOSERS = re.compile(r"[()\[\]{}]")


def indent_ends(bare: list[str], raw: list[str]) -> list[int]:
    """For each line of code the last line (1-based) of what is indented deeper than it; one pass, with a stack.

    Lines inside brackets or strings that go on indent nothing. Comments belong to what they are indented deeper than.
    """
    ends = list(range(1, len(bare) + 1))
    open_: list[tuple[int, int]] = []  # (indent, line) of the lines that may still have something below them
    tail: list[tuple[int, int]] = []  # comments behind the last code, and their indents
    last, depth = 0, 0

    def close(indent: int) -> None:
        while open_ and open_[-1][0] >= indent:
            deep, line = open_.pop()
            ends[line] = max([last, *(k for d, k in tail if d > deep)], default=last)

    for k, line in enumerate(bare):
        if not line.strip():
            if depth:
                last = k + 1
            elif raw[k].strip():
                tail.append((len(raw[k]) - len(raw[k].lstrip()), k + 1))
            continue
        if not depth:
            indent = len(line) - len(line.lstrip())
            close(indent)
            open_.append((indent, k))
        last = k + 1
        tail.clear()
        for c in _CLOSERS.findall(line):
            depth += 1 if c in "([{" else -1 if depth else 0
    close(-1)
    return ends


def _header_end_python(bare: str, at: int) -> int:
    """Behind the colon that ends the head of a definition."""
    depth = 0
    for m in re.compile(r"[()\[\]{}:]").finditer(bare, at):
        c = m[0]
        if c == ":" and not depth:
            return m.end()
        depth += (c in "([{") - (c in ")]}")
    return len(bare)


def functions(text: str, lang: str) -> Iterator[tuple[str, int, int, str, str, list[str]]]:
    """(name, line_start, line_end, signature, code, docs) of every function; docs are its comment and its docstring."""
    bare, comments, strings = blank(text, lang)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    lines = bare.split("\n")
    if lang == "python":
        raw = text.split("\n")
        code = list(lines)
        for a, b in strings:  # lines that a string goes on into are no lines of their own
            for k in range(bisect_right(starts, a), bisect_right(starts, b - 1)):
                code[k] = ""
        ends_of = indent_ends(code, raw)
    else:
        places, closed = brace_ends(bare)
    line_of = lambda off: bisect_right(starts, off)
    # a comment block: line comments on successive lines that hold nothing else, or one block comment
    ends: dict[int, tuple[int, int, bool]] = {}
    for a, b in comments:
        la, lb = line_of(a), line_of(max(a, b - 1))
        own = not text[starts[la - 1] : a].strip() and not lines[lb - 1].strip()
        if own:
            ends[lb] = (a, b, text[a : a + 2] != "/*")
    string_starts = [a for a, _ in strings]
    for m in SIGNATURE[lang].finditer(bare):
        name = next(g for g in m.groupdict().values() if g)
        if name in NOT_NAMES:
            continue
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        first = line_of(at)
        if lang == "python":
            head = _header_end_python(bare, m.end())
            last = ends_of[first - 1]
            end = starts[last] if last < len(starts) else len(text)
        else:
            head = m.end()
            k = bisect_left(places, m.end() - 1 if bare[m.end() - 1] in "{;" else m.end())
            end = closed[k] if k < len(closed) else len(bare)
            last = line_of(max(at, end - 1))
        docs = []
        comment = _comment_above(text, lines, ends, starts, first)
        if comment:
            docs.append(strip_marks(comment))
        if lang == "python":
            j = bisect_left(string_starts, head)
            if j < len(strings):
                a, b = strings[j]
                before = bare[head:a]
                if not before.strip() and text[a] in "\"'" or not before.strip(" \t\n\\rRuU") and before.strip() in ("r", "R", "u", "U"):
                    if _DOCSTRING_END.match(bare, b):
                        docs.append(strip_quotes(text[a:b]))
        signature = " ".join(text[at:head].split())
        yield name, first, last, signature.rstrip("{:; "), text[at:end].rstrip(), docs


_DOCSTRING_END = re.compile(r"[ \t]*(?:[\n;\r]|\Z)")


def _comment_above(text: str, lines: list[str], ends: dict, starts: list[int], first: int) -> str | None:
    """The comment that ends on the line before ``first``, over decorators, annotations and attributes."""
    k = first - 1
    while k >= 1:
        if k in ends:
            break
        line = lines[k - 1].strip()
        if not line:
            return None
        # up to the line that opens the bracket closed last; a decorator of one line is its own
        j, depth = k, [0, 0, 0]
        while True:
            for n, (o, c) in enumerate(("()", "[]", "{}")):
                depth[n] += lines[j - 1].count(c) - lines[j - 1].count(o)
            if j == 1 or max(depth) <= 0:
                break
            j -= 1
        if any(depth) or not re.match(r"@\w|#!?\[", lines[j - 1].strip()):
            return None
        k = j - 1
    if k < 1 or k not in ends:
        return None
    a, b, by_line = ends[k]
    if by_line:
        while k - 1 in ends and ends[k - 1][2]:
            k -= 1
            a = ends[k][0]
    return text[a:b]


def documented(text: str, lang: str) -> list[tuple]:
    """Documented functions of a file, for valid ones only."""
    text = text.removeprefix("﻿")
    found = []
    for name, first, last, signature, code, docs in functions(text, lang):
        good = [d for d in docs if says_something(d, name)]
        if good:
            found.append((name, first, last, signature, "\n\n".join(good), code))
    return found if found and not syntax_errors(lang, text) else []


def documented_functions(files: DataFrame) -> DataFrame:
    """Code–description pairs of all code files. A narrow map over three columns."""
    todo = files.select("ws", "rel", table_lang(F.col("rel")).alias("lang"), "content").where("lang NOT IN ('*', 'json') AND content IS NOT NULL")
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ws, rel, lang, text in pdf.itertuples(index=False):
                for name, first, last, signature, doc, code in documented(text, lang):
                    rows.append((ws, rel, lang, name, first, last, signature, doc, code))
            yield pd.DataFrame(rows, columns=names)

    return spread(todo).mapInPandas(run, SCHEMA)
