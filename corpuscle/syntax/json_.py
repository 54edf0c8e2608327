"""Strict JSON by recursive descent."""

from __future__ import annotations

import re

from .base import BAD, Bad, Kinds, Parser, lines_of

_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
PATTERN = re.compile(rf'{_STRING}|"(?:[^"\\\n]|\\.)*"|[-+.\w]+|[^ \t\r\n]', re.S)


def _classify(t: str) -> str:
    if t in ("{", "}", "[", "]", ",", ":"):
        return t
    if t[0] == '"':
        return '"' if re.fullmatch(_STRING, t) else BAD
    return "0" if t in ("true", "false", "null") or re.fullmatch(_NUMBER, t, re.A) else BAD


KINDS = Kinds(_classify)


class Json(Parser):
    def value(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == '"' or c == "0":
            return i + 1
        if c == "{":
            i += 1
            if s[i] == "}":
                return i + 1
            while True:
                i = self.need(i, '"', "expected a name")
                i = self.value(self.need(i, ":", "expected ':'"))
                if s[i] == ",":
                    i += 1
                    continue
                return self.need(i, "}")
        if c == "[":
            i += 1
            if s[i] == "]":
                return i + 1
            while True:
                i = self.value(i)
                if s[i] == ",":
                    i += 1
                    continue
                return self.need(i, "]")
        raise Bad(i, "invalid token" if c == BAD else "expected a value")


def check(text: str) -> list[tuple[int, str]]:
    kinds = "".join(map(KINDS.__getitem__, PATTERN.findall(text)))
    p = Json(kinds)
    errors = []
    try:
        i = p.value(0)
        if i < len(kinds):
            errors.append((i, "more than one value"))
    except Bad as e:
        errors.append((e.at, e.what))
    if not errors:
        return []
    at = [m.start() for m in PATTERN.finditer(text)]
    return list(zip(lines_of(text, [at[i] if i < len(at) else len(text) for i, _ in errors]), [w for _, w in errors]))
