"""Text: lines, line ends, hashes, offsets, comments in JSON, hunks."""

from __future__ import annotations

import bisect
import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha1_upper(c: Column) -> Column:
    return F.upper(F.sha1(c))


def decode(content: Column) -> tuple[Column, Column]:
    """(text, lossless) of bytes; broken sequences become replacement characters."""
    s = content.cast("string")
    return F.make_valid_utf8(s), F.is_valid_utf8(s)


def dominant_eol(text: Column) -> Column:
    """'\\r\\n' if most line ends are, else '\\n'."""
    crlf, all_ = F.regexp_count(text, F.lit("\r\n")), F.regexp_count(text, F.lit("\n"))
    return F.when(crlf * 2 > all_, F.lit("\r\n")).otherwise(F.lit("\n"))


def normalise_eol(text: Column, eol: Column | str) -> Column:
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(lf, F.lit("\n"), eol if isinstance(eol, Column) else F.lit(eol))


def with_lines(df: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row per line: ``ln`` from 1 and ``line`` without its line end; no phantom line behind the last line end.

    The explosion is a narrow generator inside codegen; callers filter texts before it.
    """
    keep = keep or [c for c in df.columns if c != text]
    bare = F.when(F.col(text).endswith("\n"), F.substring(F.col(text), F.lit(1), F.length(text) - 1)).otherwise(F.col(text))
    out = df.where(F.length(text) > 0).select(*keep, F.posexplode(F.split(bare, "\n")).alias("_p", "line"))
    line = F.when(F.col("line").endswith("\r"), F.substring("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    return out.select(*keep, (F.col("_p") + 1).alias("ln"), line.alias("line"))


def clip_line(line: Column, col: Column, width: int = 300, lead: int = 80) -> Column:
    """Long lines as a window around the match, with an ellipsis where text was cut off."""
    start = F.greatest(F.lit(1), col - lead)
    window = F.substring(line, start, F.lit(width))
    cut = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), window, F.when(start + width <= F.length(line), F.lit("…")).otherwise(F.lit("")))
    return F.when(F.length(line) > width, cut).otherwise(line)


def slug(c: Column) -> Column:
    """Lower-case name of letters, digits and underscores, at most 40, with a hash if that changed it."""
    s = F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), 1, 40)
    return F.when(s == c, s).otherwise(F.concat(s, F.lit("_"), F.substring(F.sha1(c), 1, 8)))


# -- on single texts, for the driver and inside Arrow functions


class Offsets:
    """Line and column of offsets and back, in code points; lines and columns from 1."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line_col(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def offset(self, line: int, col: int = 1) -> int:
        return min(len(self.text), self.starts[min(line, len(self.starts)) - 1] + col - 1)

    def line_range(self, first: int, last: int) -> tuple[int, int]:
        """Offsets of whole lines, without the line end of the last."""
        a = self.starts[first - 1]
        b = self.starts[last] - 1 if last < len(self.starts) else len(self.text)
        return a, b - 1 if b > a and self.text[b - 1 : b] == "\r" else b

    def widen(self, a: int, b: int, lines: int) -> tuple[int, int]:
        """A span widened to whole lines with some more around."""
        first, last = max(1, self.line_col(a)[0] - lines), min(len(self.starts), self.line_col(b)[0] + lines)
        return self.line_range(first, last)


def utf16(text: str, at: int) -> int:
    """Code points as UTF-16 units, for callers that count in those."""
    return at + sum(ord(c) > 0xFFFF for c in text[:at])


def sha1_text(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest().upper()


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    parts = re.split(r'("(?:[^"\\]|\\.)*")|(//[^\n]*|/\*.*?\*/)', text, flags=re.S)
    kept = "".join(p for i, p in enumerate(parts) if p and i % 3 != 2)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], kept)


def jsonc(text: str):
    try:
        return json.loads(strip_jsonc(text))
    except ValueError:
        return None


def hunks(text: str, edits: list[tuple[int, int, str]], context: int = 3) -> list[dict]:
    """A hunk per edit (start, end, new text) from the known offsets; no diff is computed."""
    at, out, shift = Offsets(text), [], 0
    for a, b, new in sorted(edits):
        lo, hi = at.widen(a, b, context)
        first = at.line_col(lo)[0]
        out.append({"line": first, "new_line": first + shift, "old": text[lo:hi], "new": text[lo:a] + new + text[b:hi]})
        shift += new.count("\n") - text[a:b].count("\n")
    return out
