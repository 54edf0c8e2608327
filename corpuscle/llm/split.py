"""Splitting oversized items at natural boundaries, by pointer doubling.

Every boundary of an item (symbol starts, line starts, blanks and a grid inside lines that alone are too long) is
joined to its farthest legal successor: the last boundary that a piece beginning ``overlap`` code points before it can
reach within the limit. The successor table is then squared again and again; after k squarings the set of cuts has
2**k members, so all greedy cuts of an item with m boundaries come out of about log2(m) array operations.

Cases: null content is not split and gives no row; content of exactly the limit is not too large. A limit that is null
or below one means no limit. An overlap that is null or negative counts as 0; one that is not below its limit is refused
with an error, as no piece could advance. A cut falls between CR and LF only where limit less overlap is below 3. ``symbols`` may be null, empty or wrong: line numbers
outside the file are ignored. Equal (ws, rel, content) rows count once. Limits beyond one row for a language: the
smallest holds. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows, table_lang

PIECES = (
    "ws string, rel string, n_chars bigint, piece_no int, n_pieces int, start_off bigint, end_off bigint, "
    "cut_at bigint, cut_kind string, text string, long_lines array<int>"
)
KINDS = ["symbol", "line", "blank", "hard"]


def line_starts(cp: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(cp == 10) + 1])


def long_lines(cp: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """1-based numbers of lines that alone, without LF or CR LF, exceed the limit."""
    ends = np.concatenate([starts[1:] - 1, [len(cp)]])
    inner = starts[:-1]
    cr = np.zeros(len(starts), bool)
    if len(inner):
        last = ends[:-1] - 1
        cr[:-1] = (last >= inner) & (cp[np.maximum(last, 0)] == 13)
    return np.flatnonzero(ends - cr - starts > limit) + 1


def boundaries(cp: np.ndarray, starts: np.ndarray, symbol_lines, step: int) -> list[np.ndarray]:
    """Positions by kind, most natural first. No gap between neighbours of all kinds together exceeds ``step``."""
    n = len(cp)
    sym = np.unique(np.asarray([s for s in symbol_lines if s is not None and 1 <= s <= len(starts)], dtype=np.int64))
    symbol = starts[sym - 1] if len(sym) else np.zeros(0, np.int64)
    lines = starts[starts < n]
    ends = np.concatenate([starts[1:], [n]])
    wide = np.flatnonzero(ends - starts > step)
    blank, hard = [], []
    for i in wide:
        a, b = starts[i], ends[i]
        blank.append(a + 1 + np.flatnonzero((cp[a : b - 1] == 32) | (cp[a : b - 1] == 9)))
        grid = np.arange(a + step, b, step)
        if step > 2:
            grid -= (cp[grid] == 10) & (cp[grid - 1] == 13)  # not between CR and LF
        hard.append(grid)
        if b - a > step:  # a grid of half steps lets every blank reach a successor
            half = np.arange(a + max(1, step // 2), b, step)
            hard.append(half - ((cp[half] == 10) & (cp[half - 1] == 13)) if step > 2 else half)
    cat = lambda xs: np.unique(np.concatenate(xs)) if xs else np.zeros(0, np.int64)
    return [symbol[symbol > 0], lines[lines > 0], cat(blank), cat(hard)]


def greedy_cuts(n: int, kinds: list[np.ndarray], limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the greedy path from 0 to n, and the kind of each (len(kinds) for the end)."""
    every = np.unique(np.concatenate([[0, n], *kinds]))
    reach = np.maximum(every - overlap, 0) + limit  # where the piece that follows this boundary must end
    succ = np.full(len(every), -1, np.int64)
    kind = np.full(len(every), len(kinds), np.int8)
    # natural ones are taken if they leave the piece at least half full, then any that advance
    half = every + (reach - every) // 2
    for floor, use in ((half, kinds), (every, kinds)):
        for k, pos in enumerate(use):
            if not len(pos):
                continue
            j = np.searchsorted(pos, reach, "right") - 1
            to = pos[np.maximum(j, 0)]
            ok = (succ < 0) & (j >= 0) & (to > floor)
            succ[ok] = np.searchsorted(every, to[ok])
            kind[succ[ok]] = np.minimum(kind[succ[ok]], k)
    end = len(every) - 1
    succ[reach >= n] = end
    succ[end] = end
    if (succ < 0).any():  # can not happen with boundaries()
        raise ValueError("a boundary has no legal successor")
    path, hop = np.zeros(1, np.int64), succ
    while path[-1] != end:
        path = np.concatenate([path, hop[path]])
        hop = hop[hop]
    path = np.unique(path)
    return every[path], kind[path]


def split_one(text: str, symbol_lines, limit: int, overlap: int) -> tuple[list[tuple[int, int, int, str]], np.ndarray]:
    """(start, end, cut, kind of the cut at the end) of each piece, and the lines that alone are too long."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    overlap = max(0, overlap)
    if overlap >= limit:
        raise ValueError(f"an overlap of {overlap} is not below the limit of {limit}")
    starts = line_starts(cp)
    step = max(1, limit - overlap)
    cuts, kinds = greedy_cuts(len(cp), boundaries(cp, starts, symbol_lines, step), limit, overlap)
    names = [*KINDS, "end"]
    out = []
    for i in range(len(cuts) - 1):
        a = int(cuts[i])
        out.append((max(0, a - overlap), int(cuts[i + 1]), a, names[kinds[i + 1]] if cuts[i + 1] < len(cp) else "end"))
    return out, long_lines(cp, starts, limit)


def read_limits(limits: DataFrame, item: str, unit: str) -> dict[str, tuple[int, int]]:
    """Limits by language; a table of settings, at most 1,000 rows."""
    rows = bounded_rows(limits.where((F.col("item") == item) & (F.col("unit") == unit)), 1000, "size limits")
    out: dict[str, tuple[int, int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"] or "*", -(r["max_size"] or 0))):
        if r["max_size"] is not None and r["max_size"] >= 1:
            if (r["overlap"] or 0) >= r["max_size"]:
                raise ValueError(f"size limit of {r['lang']}: an overlap of {r['overlap']} is not below {r['max_size']}")
            out[r["lang"] or "*"] = (int(r["max_size"]), int(r["overlap"] or 0))
    return out


def split_oversized(files: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every file whose content exceeds the limit of its language; other files give no row.

    The size test runs in the JVM, so only oversized content is shuffled (to drop repeated rows and to spread large
    files) and reaches Python. ``text`` of a piece is content[start_off:end_off]; ``cut_at`` is where the part that no
    earlier piece holds begins; ``long_lines`` are the lines that alone exceed the limit, given with piece 0 only.
    """
    by_lang = read_limits(limits, "file", "chars")
    size = lap = F.lit(None).cast("bigint")
    lang = table_lang(F.col("rel"))
    if "*" in by_lang:
        size, lap = F.lit(by_lang["*"][0]).cast("bigint"), F.lit(by_lang["*"][1]).cast("bigint")
    for k, (m, o) in sorted(by_lang.items()):
        if k != "*":
            size = F.when(lang == k, F.lit(m).cast("bigint")).otherwise(size)
            lap = F.when(lang == k, F.lit(o).cast("bigint")).otherwise(lap)
    big = (
        files.select(
            "ws", "rel", "content",
            (F.transform("symbols", lambda s: s["line_start"]) if "symbols" in files.columns else F.lit(None).cast("array<int>")).alias("symbol_lines"),
            size.alias("max_size"), lap.alias("overlap"),
        )
        .where(F.length("content") > F.col("max_size"))
        .dropDuplicates(["ws", "rel", "content"])
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in PIECES.split(",")]
        for pdf in batches:
            rows = []
            for ws, rel, text, sym, limit, overlap in pdf.itertuples(index=False):
                found, wide = split_one(text, [] if sym is None else list(sym), int(limit), int(overlap))
                wide = wide.astype(np.int32)
                for i, (a, b, cut, kind) in enumerate(found):
                    rows.append((ws, rel, len(text), i, len(found), a, b, cut, kind, text[a:b], wide if i == 0 else None))
            yield pd.DataFrame(rows, columns=names)

    return big.mapInPandas(pieces, PIECES)
