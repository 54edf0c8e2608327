"""Guarded edits of a folder, on the driver: one snapshot, no overlap, no new diagnostics, compare-and-swap, read back."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

from ..functions import text
from . import validate


class EditRefused(ValueError):
    """The edit was not made; nothing was written."""


@dataclass(frozen=True)
class Edit:
    """Replace text[start:end] by ``new``."""

    start: int
    end: int
    new: str


def anchor(source: str, old: str, within: str | None = None) -> tuple[int, int]:
    """Where a text stands that occurs exactly once, in the whole or behind a landmark that occurs once."""
    lo = 0
    if within is not None:
        if source.count(within) != 1:
            raise EditRefused("the landmark is not unique")
        lo = source.index(within)
    n = source.count(old, lo)
    if n != 1:
        raise EditRefused("not found" if not n else f"found {n} times; the shortest unique text is {smallest_anchor(source, old)!r}")
    at = source.index(old, lo)
    return at, at + len(old)


def smallest_anchor(source: str, old: str) -> str | None:
    """The first occurrence with as many following lines as make it unique."""
    at = source.find(old)
    end = at + len(old)
    while at >= 0 and end < len(source):
        nxt = source.find("\n", end + 1)
        end = len(source) if nxt < 0 else nxt
        if source.count(source[at:end]) == 1:
            return source[at:end]
    return None


def compose(source: str, edits: list[Edit]) -> str:
    """All edits on one snapshot, applied from the highest offset; line ends become those of the text."""
    ordered = sorted(edits, key=lambda e: (e.start, e.end))
    for a, b in zip(ordered, ordered[1:]):
        if b.start < a.end:
            raise EditRefused("edits overlap")
    crlf = source.count("\r\n") * 2 > source.count("\n")
    for e in reversed(ordered):
        if not 0 <= e.start <= e.end <= len(source):
            raise EditRefused("outside the text")
        new = e.new.replace("\r\n", "\n")
        source = source[: e.start] + (new.replace("\n", "\r\n") if crlf else new) + source[e.end :]
    return source


def compare(before: str, after: str, rel: str) -> dict[str, list]:
    """Diagnostics as new, resolved and remaining, keyed by what they say, not where."""
    key = lambda d: (d[0], d[1], d[3])
    a, b = [key(d) for d in validate.diagnose(rel, before)], [key(d) for d in validate.diagnose(rel, after)]
    new = list(b)
    for k in a:
        if k in new:
            new.remove(k)
    gone = list(a)
    for k in b:
        if k in gone:
            gone.remove(k)
    rest = list(a)
    for k in gone:
        rest.remove(k)
    return {"new": new, "resolved": gone, "remaining": rest}


def write(path: str, data: bytes, expected: str | None = None, create: bool = False) -> str:
    """Compare-and-swap: 'ok', 'stale', 'exists', 'missing' or 'symlink'. A reader sees the old file or the new one."""
    if os.path.islink(path):
        return "symlink"
    there = os.path.isfile(path)
    if create and there:
        return "exists"
    if not create and not there:
        return "missing"
    if expected is not None and there:
        with open(path, "rb") as f:
            import hashlib

            if hashlib.sha1(f.read()).hexdigest().upper() != expected:
                return "stale"
    fd, tmp = tempfile.mkstemp(prefix=".corpuscle-tmp-", dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if create:
            os.link(tmp, path)  # fails if another made it meanwhile
            os.unlink(tmp)
        else:
            os.replace(tmp, path)
    except FileExistsError:
        os.unlink(tmp)
        return "exists"
    return "ok"


def edit_file(root: str, rel: str, edits: list[Edit], at: str, force: bool = False) -> dict:
    """Edits of one file under the hash ``at`` of what the caller saw: a receipt with hunks, or EditRefused."""
    if rel.startswith("/") or ".." in rel.split("/"):
        raise EditRefused("outside the folder")
    path = os.path.join(root, rel)
    with open(path, "rb") as f:
        raw = f.read()
    try:
        source = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise EditRefused("the file is not lossless text") from e
    if text.sha1_text(source) != at:
        raise EditRefused("stale")
    made = compose(source, edits)
    diff = compare(source, made, rel)
    if diff["new"] and not force:
        raise EditRefused(f"new diagnostics: {diff['new'][:3]}")
    outcome = write(path, made.encode("utf-8"), at)
    if outcome != "ok":
        raise EditRefused(outcome)
    with open(path, encoding="utf-8", newline="") as f:
        back = f.read()
    return {"rel": rel, "outcome": "written" if back == made else "changed by another", "at": text.sha1_text(back), "diagnostics": diff, "hunks": text.hunks(source, [(e.start, e.end, e.new) for e in edits])}
