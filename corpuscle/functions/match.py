"""Matchers of lines, and the terms that an index can vouch for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
STOPWORDS = (
    "a an and are as at be but by can do does for from get how i if in into is it its of on or that the their then there these this "
    "to was we what when where which why will with you your"
).split()
META = re.compile(r"[\\^$.*+?()\[\]{}|]")


class BadPattern(ValueError):
    """An empty pattern, one over several lines, or one that does not compile."""


def script_regex(pattern: str) -> str:
    """A regular expression in the script dialect as one for the JVM."""
    out, i, cls = [], 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\":
            m = re.match(r"\\u\{([0-9a-fA-F]+)\}", pattern[i:])
            if m:
                out.append(rf"\x{{{m[1]}}}")
                i += len(m[0])
                continue
            if two == "\\/" or two == "\\-" and not cls:
                out.append(two[1])
            elif two == "\\d":
                out.append("0-9" if cls else "[0-9]")
            else:
                out.append(two)
            i += 2
            continue
        if cls:
            if c == "]":
                cls = False
            elif c == "[":
                c = r"\["
            elif two == "&&":
                c, i = r"&\&", i + 1
            out.append(c)
        elif pattern.startswith("[^]", i):
            out.append(r"[\s\S]")
            i += 3
            continue
        elif pattern.startswith("[]", i):
            out.append("(?!)")
            i += 2
            continue
        elif c == "[":
            cls = True
            out.append(c)
        elif c == ".":
            out.append(r"[^\n\r\u2028\u2029]")
        elif c == "{" and not re.match(r"\{\d+(?:,\d*)?\}", pattern[i:]):
            out.append(r"\{")
        elif c == "}" and not re.search(r"(?<!\\)\{\d+(?:,\d*)?$", pattern[:i]):
            out.append(r"\}")
        else:
            out.append(c)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Matcher:
    """A compiled line predicate. ``literal`` is set if the pattern is one, so that plain string functions serve."""

    pattern: str
    literal: str | None
    ignore_case: bool
    regex: str

    def test(self, line: Column) -> Column:
        if self.literal is not None:
            return (F.lower(line) if self.ignore_case else line).contains(self.literal.lower() if self.ignore_case else self.literal)
        return line.rlike(self.regex)

    def column(self, line: Column) -> Column:
        """1-based place of the first match in code points."""
        if self.literal is not None:
            return F.instr(F.lower(line) if self.ignore_case else line, self.literal.lower() if self.ignore_case else self.literal)
        # no group is added around the pattern, so back references keep their numbers
        return F.when(line.rlike(rf"\A(?:{self.regex})"), 1).otherwise(F.length(F.split(line, self.regex, 2)[0]) + 1)

    def all(self, line: Column) -> Column:
        """Every match as a string."""
        return F.regexp_extract_all(line, F.lit(self.regex), F.lit(0))


def compile_matcher(pattern: str, regex: bool = False, case: bool | str = False) -> Matcher:
    """``case``: False ignores it (the default of grep), True does not, 'smart' heeds it if there is a capital."""
    if not pattern or "\n" in pattern or "\r" in pattern:
        raise BadPattern("empty or more than one line")
    heed = any(c.isupper() for c in pattern) if case == "smart" else bool(case)
    plain = not regex or not META.search(pattern)
    body = re.sub(r"([\\^$.*+?()\[\]{}|])", r"\\\1", pattern) if plain else script_regex(pattern)
    if not plain:
        try:
            re.compile(re.sub(r"\\x\{[0-9a-fA-F]+\}", "x", body))
        except re.error as e:
            raise BadPattern(str(e)) from e
    flags = "" if heed else "(?iu)" if not pattern.isascii() else "(?i)"
    return Matcher(pattern, pattern if plain else None, not heed, flags + body)


def index_terms(literal: str, least: int = 2, most: int = 64) -> list[str]:
    """Terms that every text holding ``literal`` must have as whole terms or as their beginnings."""
    out: list[str] = []
    for m in re.finditer(r"[^\W]+", literal):
        run = m[0]
        if not m.start() or not run.isascii():
            continue
        term = run.lower()[:most]
        open_right = m.end() == len(literal)
        if len(term) < least or term in STOPWORDS or open_right and any(s != term and s.startswith(term) for s in STOPWORDS):
            continue
        if term not in out:
            out.append(term)
    return out


def query_terms(query: str) -> list[str]:
    words = [w for w in re.split(r"[^0-9a-z_$]+", query.lower()) if len(w) > 1 and w not in STOPWORDS]
    return list(dict.fromkeys(words))


def term_array(text: Column) -> Column:
    """Index terms of a text, repeats kept: runs of letters, digits and underscores in lower case, cut at 64."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(F.transform(words, lambda w: F.substring(w, 1, 64)), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))
