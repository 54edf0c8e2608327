"""Syntax checkers: recursive descent with precedence climbing and panic-mode recovery, one for each language."""

from __future__ import annotations

import sys

LANGUAGES = ("python", "javascript", "typescript", "go", "java", "rust", "json")


def syntax_errors(lang: str, text: str) -> list[tuple[int, str]]:
    """(line, cause) of every error, in order; empty for a valid text. Nesting of any depth is parsed."""
    from . import golang, java, json_, python, rust, script

    if lang != "json":
        text = text.removeprefix("﻿").replace("\r\n", "\n")
        if lang in ("python", "javascript", "typescript") and "\r" in text:
            text = text.replace("\r", "\n")
    check = {
        "python": python.check, "json": json_.check, "go": golang.check, "java": java.check, "rust": rust.check,
        "javascript": lambda t: script.check(t, False), "typescript": lambda t: script.check(t, True),
    }[lang]
    before = sys.getrecursionlimit()
    try:
        while True:
            try:
                return sorted(check(text))
            except RecursionError:
                if sys.getrecursionlimit() > 20 * len(text) + 10_000:  # no rule calls itself that often without reading on
                    raise
                sys.setrecursionlimit(sys.getrecursionlimit() * 10)
    finally:
        sys.setrecursionlimit(before)
