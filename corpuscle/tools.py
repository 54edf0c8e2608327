"""Text answers under a budget: verbs rendered for readers that take a limited number of characters, cut at whole lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import ordered

BUDGET = 12_000


def within_budget(lines: DataFrame, order: list[str], line: str = "line", budget: int = BUDGET, by: list[str] | None = None) -> DataFrame:
    """The first lines whose lengths with their ends sum up to at most the budget, per group ``by``; groups of any size."""
    n = F.length(line) + 1
    return ordered.before(lines, by or [], order, n, "_sum").where(F.col("_sum") + n <= budget).drop("_sum")


def render(rows: Iterable, show: Callable[[object], str], total: int, offset: int = 0, budget: int = BUDGET) -> str:
    """Lines of a page up to the budget, with the exact place to go on from; never an exception for odd rows."""
    out, used, n = [], 0, 0
    for r in rows:
        try:
            line = show(r)
        except Exception as e:
            line = f"? {e}"
        if used + len(line) + 1 > budget:
            break
        out.append(line)
        used += len(line) + 1
        n += 1
    end = offset + n
    out.append(f"{total} in all" + (f"; go on with offset {end}" if end < total else ""))
    return "\n".join(out)


def hit_line(r) -> str:
    place = f"{r['file']}" + (f":{r['line_start']}-{r['line_end']}" if r["line_start"] else f":{r['line']}" if r["line"] else "")
    return f"{place} {r['kind'] or 'file'} {r['path'] or ''} [{r['score']}]" + (f" | {r['quote']}" if r["quote"] else "")


def match_line(r) -> str:
    return f"{r['rel']}:{r['ln']}:{r['col']}: {r['text']}"
